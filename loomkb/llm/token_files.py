"""Token-id files: documents' ids in ascending id order, entropy-coded in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import SLICE_BYTES, Scratch, broadcast_if_small, slices
from .tokens import spaced_table

#: Ids of a block.
BLOCK_IDS = 1 << 18


def _tokens(path: str, end_id: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spaced_table(path)
        for batch in batches:
            for part in slices(batch, text_col, 2 * SLICE_BYTES):
                ids, ends = table(part.column(text_col), [end_id])
                raw = ids if ids.max(initial=0) > 65535 else ids.astype("<u2")
                sizes = np.diff(ends, prepend=0)
                offsets = pa.py_buffer((np.concatenate([[0], ends]) * raw.itemsize).astype("<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col).cast(pa.int64()), pa.array(sizes), pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(raw)])],
                    names=["doc_id", "n", "ids"],
                )

    return run


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for whole in batches:
        for b in slices(whole, "ids"):
            raw, sizes = b.column("ids"), b.column("n").to_numpy()
            narrow = pc.binary_length(raw).to_numpy() == 2 * sizes
            for kind, own in (("<u2", narrow), ("<u4", ~narrow)):
                ids = np.frombuffer(b"".join(raw.filter(pa.array(own)).to_pylist()), kind)
                found = np.bincount(ids, minlength=len(total))
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)]) + found
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int64)), pa.array(total[met])], names=["id", "size"])


def _blocks(table_of, block_ids: int):
    """Blocks of whole documents where they fit; a longer document goes on in further blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table.unpack(table_of.value)
        part, block, done = TaskContext.get().partitionId(), 0, 0
        docs, starts, sizes, lasts, held, room = [], [], [], [], [], block_ids

        def flush():
            nonlocal block, room
            raw = rans.encode_block(np.concatenate(held), table)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([lasts], pa.list_(pa.bool_())), pa.array([raw], pa.binary())],
                names=["part", "block", "docs", "starts", "sizes", "whole", "payload"],
            )
            for x in (docs, starts, sizes, lasts, held):
                x.clear()
            block, room = block + 1, block_ids
            return out

        for b in batches:
            for doc, n, raw in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids = _ids(raw, n)
                if held and n > room:
                    yield flush()
                for at in range(0, n, block_ids):
                    own = ids[at : at + block_ids]
                    docs.append(doc)
                    starts.append(done + at)
                    sizes.append(len(own))
                    lasts.append(n <= block_ids)
                    held.append(own)
                    room -= len(own)
                    if room <= 0:
                        yield flush()
                done += n
        if held:
            yield flush()

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write all documents' ids to ``path``: /table (shared frequencies), /blocks and /parts.

    Documents stand in ascending id order: part by part (ranges of ids, dealt by
    Spark), block by block. Frequencies count every id of the corpus, so each
    has a code; the table is bounded by the vocabulary. Blocks are independent
    and bounded. Null and empty texts give the end id alone, null ids come
    first, equal ids stand in the order of their ids' bytes; other columns are
    ignored.
    """
    scratch = Scratch(spark, "token-ids")
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    tokens = scratch.write(narrow.mapInArrow(_tokens(tokenizer, end_id, id_col, text_col), "doc_id long, n long, ids binary"), "tokens")
    counts = sorted(tokens.select("n", "ids").mapInArrow(_counts, "id long, size long").groupBy("id").agg(F.sum("size")).collect())
    table = rans.Table(np.array([x for x, _ in counts], np.int64), np.array([x for _, x in counts], np.int64)).pack()
    table_of = spark.sparkContext.broadcast(table)
    spark.createDataFrame([(bytearray(table),)], "frequencies binary").write.parquet(f"{path}/table")
    parts = max(1, tokens.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = ranged.mapInArrow(_blocks(table_of, block_ids), "part long, block long, docs array<long>, starts array<long>, sizes array<long>, whole array<boolean>, payload binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sizes.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).write.parquet(f"{path}/parts")
    scratch.clear()


def _decoded(table_of, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table.unpack(table_of.value)
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                raw, base = row.column("payload")[0].as_py(), row.column("base")[0].as_py()
                sizes = np.array(row.column("sizes")[0].as_py(), np.int64)
                ends = np.cumsum(sizes)
                low, high = 0, int(ends[-1])
                if segments > 1:
                    point, rows, low, high = rans.segment_of(raw, row.column("segment")[0].as_py(), segments)
                    if low >= high:
                        continue
                    ids = rans.decode_block(raw, table, checkpoint=point, rows=rows)
                else:
                    ids = rans.decode_block(raw, table)
                first, last = np.maximum(ends - sizes, low), np.minimum(ends, high)
                some = np.flatnonzero(first < last)
                first, last = first[some], last[some]
                whole = np.array(row.column("whole")[0].as_py(), bool)
                starts = np.array(row.column("starts")[0].as_py(), np.int64)[some] + base + first - (ends - sizes)[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column("docs").flatten().take(pa.array(some)),
                        pa.array(starts),
                        pa.array(last - first),
                        pa.array(whole[some] & (last - first == sizes[some])),
                        pa.array([ids[s - low : e - low].tobytes() for s, e in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n", "whole", "ids"],
                )

    return run


def read_token_files(spark: SparkSession, path: str, *, segments: int = 1) -> DataFrame:
    """Runs of ids (doc_id, start, n, whole, ids); ``whole`` is false for the runs of a document of several blocks or segments.

    Blocks are decoded apart from each other and held against their checksums;
    with ``segments`` over 1, each in so many tasks' rows that begin at
    checkpoints, for files of fewer blocks than there are cores.
    """
    table_of = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/table").first()[0]))
    blocks = spark.read.parquet(f"{path}/blocks").join(broadcast_if_small(spark.read.parquet(f"{path}/parts").select("part", "base")), "part")
    if segments > 1:
        blocks = blocks.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))).repartition("part", "block", "segment")
    else:
        blocks = blocks.withColumn("segment", F.lit(0))
    blocks = blocks.select("docs", "starts", "sizes", "whole", "payload", "base", "segment")
    return blocks.mapInArrow(_decoded(table_of, segments), "doc_id long, start long, n long, whole boolean, ids binary")


def _joined(runs: pd.DataFrame) -> pd.DataFrame:
    """Documents from the checksums of their consecutive runs."""
    out, runs = [], runs.sort_values("start")
    for start, n, crc in zip(runs["start"], runs["n"], runs["crc"], strict=True):
        if out and out[-1][4] != start:  # a further row with the same id
            out.append([runs["doc_id"].iloc[0], start, n, crc, start + n])
        elif out:
            last = out[-1]
            last[3], last[2], last[4] = rans.crc32_join(int(last[3]), int(crc), 4 * int(n)), last[2] + n, start + n
        else:
            out.append([runs["doc_id"].iloc[0], start, n, crc, start + n])
    return pd.DataFrame([x[:4] for x in out], columns=["doc_id", "start", "n_tokens", "ids_crc32"])


def document_checksums(runs: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the runs read back; only runs of split documents are gathered, by document."""
    runs = Scratch(runs.sparkSession, "token-runs").write(runs.select("doc_id", "start", "n", "whole", F.crc32("ids").alias("crc")), "runs")
    whole = runs.where("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    split = runs.where("NOT whole").drop("whole").groupBy("doc_id").applyInPandas(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return whole.union(split)


