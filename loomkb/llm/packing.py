"""Packing documents' token ids into sequences of a fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, slices
from .cutting_stock import plan
from .tokens import encoded, encoder, word_units

CAPACITY = 4096


def _token_rows(path: str, end_id: int, capacity: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, ranks = TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
        for rows, ids in encoded(batches, encoder(path, word_units), text_col, end_id):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            rest, full = sizes % capacity, sizes // capacity
            rank, first = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for i, (r, f) in enumerate(zip(rest.tolist(), full.tolist(), strict=True)):
                rank[i], first[i] = ranks[r], ranks[capacity]
                ranks[r] += r > 0
                ranks[capacity] += f
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int64)),
                    pa.array(np.arange(pos, pos + n)),
                    rows.column(id_col).cast(pa.int64()),
                    pa.array(sizes),
                    pa.array(rest),
                    pa.array(rank),
                    pa.array(full),
                    pa.array(first),
                    pa.array([x.tobytes() for x in ids] if len(ids) and max(int(x.max()) for x in ids) > 65535 else [x.astype("<u2").tobytes() for x in ids], pa.binary()),
                ],
                names=["part", "pos", "doc_id", "n", "rest", "rank", "full", "first", "ids"],
            )
            pos += n

    return run


def _placed(plan_of, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan_of.value
        for b in batches:
            rest = b.column("rest").to_numpy()
            rank = b.column("rank").to_numpy() + b.column("offset").to_numpy() + p["by_length"][rest]
            at = np.searchsorted(p["start"], rank, side="right") - 1
            r = rank - p["start"][at]
            yield pa.RecordBatch.from_arrays(
                [b.column("part"), b.column("pos"), b.column("rest"), pa.array(p["base"][at] + r // p["per"][at]), pa.array(p["slot"][at] + r % p["per"][at])],
                names=["part", "pos", "rest", "sequence_id", "slot"],
            )

    return run


def _pieces(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "ids"):
                rows = []
                for doc, n, rest, full, first, raw, seq, off in zip(*[b.column(c).to_pylist() for c in ("doc_id", "n", "rest", "full", "full_from", "ids", "sequence_id", "offset")], strict=True):
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                    for j in range(full):
                        rows.append((doc, j * capacity, capacity, ids[j * capacity : (j + 1) * capacity].tobytes(), n, first + j, 0))
                    if rest:
                        rows.append((doc, n - rest, rest, ids[n - rest :].tobytes(), n, seq, off))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(
    spark: SparkSession, docs: DataFrame, *, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` token ids.

    Returns (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids
    are little-endian unsigned 32-bit. A document longer than the capacity
    gives full sequences and a rest; rests and shorter documents are packed
    uncut. The driver holds the histogram of lengths (``capacity`` numbers at
    most), from which column generation makes patterns; documents, ranked by
    length over the whole corpus, are assigned to the patterns' places in the
    executors. The rank of a document is its rank among its task's documents
    of the same length plus those of the tasks before, so a length that a third
    of all rows share is never gathered. Ids are written once and joined once.

    Null and empty texts give one piece with the end id alone. Null ids and
    repeated rows are packed like any others; other columns are ignored. No
    rows in, none out.
    """
    scratch = Scratch(spark, "packing")
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    tokens = scratch.write(
        narrow.mapInArrow(_token_rows(tokenizer, end_id, capacity, id_col, text_col), "part long, pos long, doc_id long, n long, rest long, rank long, full long, first long, ids binary"), "tokens"
    )
    rests = tokens.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("size"))
    fulls = tokens.groupBy("part").agg(F.sum("full").alias("size")).select("part", F.lit(capacity).cast("long").alias("rest"), "size")
    sizes = scratch.write(rests.union(fulls), "sizes")
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "rest", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))

    counts = {r[0]: r[1] for r in sizes.groupBy("rest").agg(F.sum("size")).collect()}
    counts.pop(capacity, 0)
    lengths = np.array(sorted(counts), np.int64)
    found = plan(lengths, np.array([counts[x] for x in lengths.tolist()], np.int64), capacity)
    by_length = np.zeros(capacity + 1, np.int64)
    by_length[lengths] = found.pop("before")
    plan_of = spark.sparkContext.broadcast(found | {"by_length": by_length})

    thin = tokens.where("rest > 0").select("part", "pos", "rest", "rank").join(offsets.where(F.col("rest") < capacity), ["part", "rest"])
    placed = thin.mapInArrow(_placed(plan_of, capacity), "part long, pos long, rest long, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("part", "pos", "sequence_id", F.coalesce(F.sum("rest").over(ahead), F.lit(0)).alias("offset"))
    full_from = offsets.where(F.col("rest") == capacity).select("part", F.col("offset").alias("full_offset"))
    sequences = int(found["sequences"][0])
    rows = tokens.join(placed, ["part", "pos"], "left").join(broadcast_if_small(full_from), "part", "left")  # one row a scan task
    rows = rows.withColumn("full_from", F.coalesce(F.col("full_offset"), F.lit(0)) + F.col("first") + F.lit(sequences))
    return rows.select("doc_id", "n", "rest", "full", "full_from", "ids", "sequence_id", "offset").mapInArrow(
        _pieces(capacity), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
