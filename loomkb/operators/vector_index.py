"""A stored vector index: inverted lists around centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stored import Folder
from .vectors import cosine, page_size

#: Vectors that centroids and codebooks are fitted on at most (the smallest by hash of the id); every vector is indexed.
SAMPLE = 20_000
#: Lists for each square root of the sample, pieces of a residual, codewords of a piece.
LIST_SHARE, PIECES, WORDS = 1.0, 16, 256
#: Rows of a list that one task scores; longer lists are dealt to several.
PART_ROWS = 50_000
#: The share of the lists that a query looks into, and vectors that are compared exactly for each one asked for.
PROBED, RERANKED = 0.8, 6
#: Queries that are sent to tasks at once.
QUERY_BLOCK = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Each row's nearest centre, in blocks."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[at : at + 4096] @ centres.T, axis=1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """At most ``k`` centres of the rows of ``x``; a centre that loses its rows stays where it was."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=len(centres))
        met = sizes > 0
        centres[met] = sums[met] / sizes[met, None]
    return centres


@dataclass
class Quantiser:
    """Centroids of the lists (lists x dim) and a codebook for each piece of a residual (pieces x words x dim / pieces)."""

    centroids: np.ndarray
    books: np.ndarray

    @staticmethod
    def fit(x: np.ndarray) -> Quantiser:
        x = _unit(np.asarray(x, np.float64))
        dim = x.shape[1]
        pieces = next(p for p in range(min(PIECES, dim), 0, -1) if dim % p == 0)
        centroids = k_means(x, max(1, int(LIST_SHARE * len(x) ** 0.5)))
        rest = (x - centroids[_nearest(x, centroids)]).reshape(len(x), pieces, -1)
        books = [k_means(rest[:, p], WORDS, seed=6 + p) for p in range(pieces)]
        return Quantiser(centroids, np.stack(books))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists and codes (a byte a piece) of the rows' directions."""
        x = _unit(x)
        lists = _nearest(x, self.centroids)
        rest = (x - self.centroids[lists]).reshape(len(x), len(self.books), -1)
        return lists, np.stack([_nearest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of the queries' pieces with all codewords (queries x pieces x words)."""
        return np.einsum("qpd,pwd->qpw", q.reshape(len(q), len(self.books), -1), self.books)


@dataclass
class StoredVectors:
    """entries (list, part, vec_id, code, further columns), vectors (vec_id, embedding), parts (list, parts); quantiser."""

    entries: DataFrame
    vectors: DataFrame
    parts: DataFrame
    quantiser: Quantiser


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), np.float64).reshape(-1, dim)


def _encoded(quantiser_of, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, codes = quantiser_of.value.encode(_matrix(b.column("embedding"), dim))
            kept = [n for n in b.schema.names if n != "embedding"]
            raw = [c.tobytes() for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *[b.column(n) for n in kept], pa.array(raw, pa.binary())], names=["list", *kept, "code"])

    return run


def write_index(vectors: DataFrame, folder: Folder, *filters: str) -> StoredVectors:
    """Index ``vectors`` (vec_id, embedding, and the columns ``filters`` that searches may filter by) into ``folder``.

    Vectors that are null, of another than the most frequent length, zero, or not
    finite take no part. Entries lie in one folder for each list, so a search
    reads the lists it looks into and no vectors but those it compares exactly.
    A list with many vectors is dealt to parts of bounded size.
    """
    spark = folder.spark
    norm = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, b: a + b)
    good = vectors.where(F.col("embedding").isNotNull()).where(norm.isNotNull() & (norm > 0) & (norm < float("inf")))
    sizes = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 1
    good = good.where(F.size("embedding") == dim)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column("embedding")
    x = _matrix(pa.chunked_array(sample).combine_chunks(), dim) if len(sample) else np.zeros((1, dim))
    quantiser = Quantiser.fit(x)
    quantiser_of = spark.sparkContext.broadcast(quantiser)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in good.select("vec_id", *filters).schema]
    entries = good.select("vec_id", *filters, "embedding").mapInArrow(_encoded(quantiser_of, dim), ", ".join(["list int", *kept, "code binary"]))
    entries = folder.write(entries, "flat")
    parts = folder.write(entries.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")), "parts")  # a row a list
    dealt = entries.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    dealt = folder.write(dealt.hint("rebalance", "list"), "entries", "list")
    whole = folder.write(good.select("vec_id", "embedding"), "vectors")
    return StoredVectors(dealt, whole, parts, quantiser)


def _probes(quantiser_of, dim: int, probed: int):
    """(query_id, list, query) of the lists nearest to each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _unit(_matrix(b.column("query"), dim))
            lists = np.argsort(-(q @ quantiser_of.value.centroids.T), axis=1, kind="stable")[:, :probed]
            n = lists.shape[1]
            rows = np.repeat(np.arange(len(q)), n)
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(rows)), pa.array(lists.ravel().astype(np.int32)), pa.array([v.tobytes() for v in q[rows]], pa.binary())], names=["query_id", "list", "unit"])

    return run


def _estimated(quantiser_of, most: int):
    """The ``most`` best of a part's entries by estimated cosine, for each query that looks into its list."""

    def run(key: tuple, asked: pa.Table, entries: pa.Table) -> pa.Table:
        quantiser, out = quantiser_of.value, []
        ids = np.asarray(entries.column("vec_id"), np.int64)
        if len(ids) and len(asked):
            codes = np.frombuffer(b"".join(entries.column("code").to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.int64)
            centre, pieces = quantiser.centroids[key[0].as_py()], np.arange(codes.shape[1])
            rows = asked.column("query_id").to_pylist()
            for at, raw in enumerate(asked.column("unit").to_pylist()):
                q = np.frombuffer(raw, np.float64)[None]
                score = q[0] @ centre + quantiser.tables(q)[0][pieces, codes].sum(axis=1)
                own = ids != rows[at]
                best = np.lexsort((ids[own], -score[own]))[:most] if own.sum() <= most else np.argpartition(-score[own], most - 1)[:most]
                out.append((np.full(len(best), rows[at]), ids[own][best], score[own][best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "estimate": pa.array(columns[2], pa.float64())})

    return run


def candidates(spark: SparkSession, index: StoredVectors, queries: DataFrame, k: int, *, keep: Column | None = None, probed: float = PROBED, reranked: int = RERANKED) -> DataFrame:
    """(query_id, vec_id, estimate) of the vectors that are compared exactly: ``reranked`` times ``k`` of each query."""
    quantiser_of = spark.sparkContext.broadcast(index.quantiser)
    dim, n_lists = index.quantiser.centroids.shape[1], len(index.quantiser.centroids)
    asked = queries.where(F.size("query") == dim).select(F.col("query_id").cast("long").alias("query_id"), "query")
    asked = asked.mapInArrow(_probes(quantiser_of, dim, max(1, round(probed * n_lists))), "query_id long, list int, unit binary")
    asked = asked.join(F.broadcast(index.parts), "list").select("query_id", "list", "unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    entries = index.entries if keep is None else index.entries.where(keep)
    most = reranked * page_size(k)
    found = asked.groupBy("list", "part").cogroup(entries.select("list", "part", F.col("vec_id").cast("long").alias("vec_id"), "code").groupBy("list", "part")).applyInArrow(
        _estimated(quantiser_of, most), "query_id long, vec_id long, estimate double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("estimate"), "vec_id")
    return found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most).drop("nth")


def search(spark: SparkSession, index: StoredVectors, queries: DataFrame, k: int = 10, *, keep: Column | None = None, probed: float = PROBED, reranked: int = RERANKED) -> DataFrame:
    """(query_id, vec_id, score, rank) of each query's ``k`` nearest (10 if not positive, 100 at most), itself aside.

    A query (query_id, query) looks into the lists nearest to it, estimates all
    their cosines from the codes, and compares the best of these exactly.
    ``keep`` filters the lists' entries by the indexed columns before anything
    is estimated, so a filtered search still finds ``k`` where there are.
    """
    found = candidates(spark, index, queries, k, keep=keep, probed=probed, reranked=reranked)
    rows = found.join(index.vectors, "vec_id").join(queries.select("query_id", "query"), "query_id")
    rows = rows.select("query_id", "vec_id", cosine(F.col("embedding"), F.col("query")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= page_size(k))
