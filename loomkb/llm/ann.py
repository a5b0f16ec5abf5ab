"""Nearest neighbours by inner product through cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Hash tables.
TABLES = 8
#: Vectors for each bucket from which on a second function is joined to a table's hash.
BUCKET_VECTORS = 2048
#: Share of a sample's true neighbours that the probed buckets must hold, and the most vectors and queries of that sample.
RECALL, SAMPLE, SAMPLE_QUERIES = 0.93, 4096, 256
#: Vectors and queries that one task compares with each other at most.
INDEX_BLOCK, QUERY_BLOCK = 4096, 2048
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """Pseudo-rotations (three rounds of random signs and Hadamard transforms) for each table and function."""

    def __init__(self, dim: int, tables: int, functions: int, seed: int = SEED):
        self.size = 1 << max(0, dim - 1).bit_length()
        self.tables, self.functions = tables, functions
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, functions, 3, self.size))

    def rotated(self, x: np.ndarray, table: int, function: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for signs in self.signs[table, function]:
            y = hadamard(y * signs)
        return y

    def buckets(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The ``probes`` best buckets of each row (n x probes), the nearest signed axis first."""
        codes, marks = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for f in range(self.functions):
            y = self.rotated(x, table, f)
            both = np.concatenate([y, -y], axis=1)  # axis j, or size + j for its opposite
            few = min(probes, both.shape[1])
            best = np.argsort(-both, axis=1, kind="stable")[:, :few]
            gain = np.take_along_axis(both, best, axis=1)
            marks = (marks[:, :, None] + gain[:, None, :]).reshape(len(x), -1)
            codes = (codes[:, :, None] * (2 * self.size) + best[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(-marks, axis=1, kind="stable")[:, :probes]
            marks, codes = np.take_along_axis(marks, keep, axis=1), np.take_along_axis(codes, keep, axis=1)
        return codes


    def ranks(self, asked: np.ndarray, near: np.ndarray, table: int) -> np.ndarray:
        """How many buckets come before that of each vector of ``near`` (n x k x dim) in its query's order of probes."""
        n, k, dim = near.shape
        marks, own = [], []
        for f in range(self.functions):
            y, z = self.rotated(asked, table, f), self.rotated(near.reshape(n * k, dim), table, f)
            marks.append(np.concatenate([y, -y], axis=1))
            own.append(np.take_along_axis(marks[f], np.concatenate([z, -z], axis=1).argmax(axis=1).reshape(n, k), axis=1))
        if self.functions == 1:
            return (marks[0][:, None, :] > own[0][:, :, None] + 1e-12).sum(axis=2)
        out, total = np.zeros((n, k), np.int64), own[0] + own[1] + 1e-12
        for q in range(n):
            second = np.sort(marks[1][q])
            out[q] = (len(second) - np.searchsorted(second, total[q][:, None] - marks[0][q][None, :], side="right")).sum(axis=1)
        return out


def _unit(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """What is hashed for each row; ``top`` is the largest norm if norms differ, else 0."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    if top and not query:  # the added component makes all norms equal and leaves products with queries alone
        return np.concatenate([x, np.sqrt(np.maximum(top * top - norms * norms, 0))], axis=1) / top
    return x / norms


def fitted_probes(vectors: np.ndarray, asked: np.ndarray, k: int, family: CrossPolytope, top: float, recall: float = RECALL) -> int:
    """The fewest probes in each table with which ``recall`` of the sample's true neighbours are found.

    A sample's neighbours lie farther off than those among all vectors, so that
    these are found more often still.
    """
    if not len(vectors) or not len(asked):
        return 1
    scores = asked @ vectors.T
    scores[(asked[:, None, :1] == vectors[None, :, :1])[:, :, 0] & (np.abs(scores - (asked * asked).sum(axis=1)[:, None]) < 1e-9)] = -np.inf  # the query itself
    k = min(k, len(vectors))
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    found, known = _unit(asked, top, True), np.isfinite(np.take_along_axis(scores, near, axis=1))
    hashed = _unit(vectors, top, False)[near]
    least = np.min([family.ranks(found, hashed, t) for t in range(family.tables)], axis=0)[known]
    return int(np.quantile(least, recall, method="higher")) + 1 if len(least) else 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _hashed(dim: int, top: float, tables: int, functions: int, probes: int, query: bool, with_vectors: bool):
    """Rows (tab, bucket, key, vec) of each vector in each table; ``top`` is the largest norm if norms differ, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = CrossPolytope(dim + (top > 0), tables, functions)
        few = min(probes if query else 1, 2 * family.size) ** functions
        step = max(1, min(2000, 2_000_000 // (few + dim)))  # rows whose probes fit in memory
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                b = whole.slice(k, step)
                raw = _matrix(b.column("vec"), dim)
                x = _unit(raw.astype(np.float64), top, query)
                rows = [r.tobytes() for r in np.ascontiguousarray(raw)] if with_vectors else None
                keys = b.column("key").to_numpy()
                for t in range(tables):
                    codes = family.buckets(x, t, probes if query else 1)
                    n = codes.shape[1]
                    out = [pa.array(np.full(codes.size, t, np.int32)), pa.array(codes.ravel()), pa.array(np.repeat(keys, n))]
                    names = ["tab", "bucket", "key"]
                    if with_vectors:
                        out.append(pa.array([r for r in rows for _ in range(n)], pa.binary()))
                        names.append("vec")
                    yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _packed(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r.tobytes() for r in np.ascontiguousarray(_matrix(b.column("vec"), dim))]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(rows, pa.binary())], names=["key", "vec"])

    return run


def _nearest(dim: int, kind: str, most: int):
    """One bucket block: each query's best ``most`` vectors with exact products, packed."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(index) and len(queries):
            x = np.frombuffer(b"".join(index.column("vec").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
            q = np.frombuffer(b"".join(queries.column("vec").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
            ids, keys = index.column("key").to_numpy(), queries.column("key").to_numpy()
            few = min(len(x), most + 11)
            for at in range(0, len(q), 256):
                own = q[at : at + 256]
                near = np.argpartition(-(own @ x.T), few - 1, axis=1)[:, :few]
                # again in one order of summation, so that equal vectors get equal scores anywhere
                scores = (own[:, None, :] * x[near]).sum(axis=2)
                for k, key in enumerate(keys[at : at + 256].tolist()):
                    order = np.lexsort((ids[near[k]], -scores[k]))[:most]
                    out.append((key, ids[near[k]][order].tobytes(), scores[k][order].tobytes()))
        return pa.table({"key": pa.array([x[0] for x in out], pa.int64()), "near": pa.array([x[1] for x in out], pa.binary()), "scores": pa.array([x[2] for x in out], pa.binary())})

    return run


def _merged(most: int):
    def run(group: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(group.column("near").to_pylist()), np.int64)
        scores = np.frombuffer(b"".join(group.column("scores").to_pylist()), np.float64)
        ids, first = np.unique(ids, return_index=True)
        order = np.lexsort((ids, -scores[first]))[:most]
        n = len(order)
        return pa.table({"key": pa.array(np.full(n, group.column("key")[0].as_py(), np.int64)), "near": pa.array(ids[order]), "score": pa.array(scores[first][order])})

    return run


def nearest_neighbours(
    spark: SparkSession,
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = TABLES,
    functions: int | None = None,
    probes: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` vectors with the largest inner products for each query but its own row.

    Every vector is indexed in every table under its nearest signed axis after
    a pseudo-rotation, or under two axes (``functions``) where buckets of one would be
    large; a query visits the buckets of its ``probes`` nearest axes and all it
    finds there is ranked by the exact inner product in double precision, ties
    to the smaller id. Unless given, probes are as many as find RECALL of the
    neighbours within a sample of at most SAMPLE vectors for SAMPLE_QUERIES
    queries, the first by hash of the id. Where norms differ, a component is
    added for hashing that makes them equal. Equal vectors are one class, of
    which the smallest k + 1 ids can be among anyone's nearest; classes of any
    size cost one index row. Large buckets are split into blocks, so none is
    capped. Queries whose buckets hold too few are compared with all vectors,
    in blocks too, so that each gets ``k`` rows, or all other vectors where there are fewer.

    Vectors that are null, empty, zero or hold null or non-finite components,
    rows with a null id and vectors of another length than most have (of
    lengths as frequent, the longest) take no part. Numbers of any kind are taken;
    all but floats as doubles. Repeated ids of a query are ranked once. No rows in, none out.
    """
    scratch = Scratch(spark, "ann")
    v = F.col(vec_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col(id_col).isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    value = v if kind == "<f4" else v.cast("array<double>")
    own = vectors.where(fit).select(F.col(id_col).cast("long").alias("id"), value.alias("vec"))
    asked = queries.where(fit).select(F.col(id_col).cast("long").alias("query_id"), value.alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    by_length = own.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.min(norm).alias("low"), F.max(norm).alias("high"))
    most = by_length.orderBy(F.desc("n"), F.desc("dim")).first()
    dim, low, high = (most["dim"], most["low"], most["high"]) if most else (1, 1.0, 1.0)
    top = float(high) if high > low * 1.001 else 0.0
    own, asked = own.where(F.size("vec") == dim), asked.where(F.size("vec") == dim)

    first = Window.partitionBy("vec").orderBy("id")
    few = own.distinct().withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= k + 1)
    classes = few.groupBy("vec").agg(F.min("id").alias("key"), F.sort_array(F.collect_set("id")).alias("members"))
    classes = scratch.write(classes, "classes")
    heads = scratch.write(asked.groupBy("vec").agg(F.min("query_id").alias("key")), "heads")
    of_head = asked.join(heads, "vec").select("query_id", "key").distinct()

    if functions is None:
        axes = 2 * CrossPolytope(dim + (top > 0), 1, 1).size
        functions = 2 if classes.count() >= BUCKET_VECTORS * axes * axes else 1
    if probes is None:
        some = lambda df, n: np.array([r[0] for r in df.orderBy(F.xxhash64("key"), "key").limit(n).select("vec").collect()], np.float64).reshape(-1, dim)
        probes = fitted_probes(some(classes, SAMPLE), some(heads, SAMPLE_QUERIES), k, CrossPolytope(dim + (top > 0), tables, functions), top)
    args = (dim, top, tables, functions, probes)
    thin, wide = "tab int, bucket long, key long", "tab int, bucket long, key long, vec binary"
    count = lambda df, query, name: df.select("key", "vec").mapInArrow(_hashed(*args, query, False), thin).groupBy("tab", "bucket").agg(F.count("*").alias(name))
    sizes = count(classes, False, "vectors").join(count(heads, True, "asked"), ["tab", "bucket"])
    sizes = sizes.select("tab", "bucket", F.ceil(F.col("vectors") / INDEX_BLOCK).cast("int").alias("ni"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("nq"))
    sizes = scratch.write(sizes, "sizes")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    index = classes.select("key", "vec").mapInArrow(_hashed(*args, False, True), wide).join(sizes, ["tab", "bucket"])
    index = index.withColumn("i", F.pmod(F.xxhash64("key"), F.col("ni")).cast("int")).withColumn("j", F.explode(every(F.col("nq"))))
    wanted = heads.select("key", "vec").mapInArrow(_hashed(*args, True, True), wide).join(sizes, ["tab", "bucket"])
    wanted = wanted.withColumn("j", F.pmod(F.xxhash64("key"), F.col("nq")).cast("int")).withColumn("i", F.explode(every(F.col("ni"))))
    by = ["tab", "bucket", "i", "j"]
    found = index.select(*by, "key", "vec").groupBy(*by).cogroup(wanted.select(*by, "key", "vec").groupBy(*by))
    found = found.applyInArrow(_nearest(dim, kind, k + 1), "key long, near binary, scores binary")
    best = scratch.write(found.groupBy("key").applyInArrow(_merged(k + 1), "key long, near long, score double"), "best")

    def members_of(best: DataFrame) -> DataFrame:
        members = best.join(classes.select(F.col("key").alias("near"), "members"), "near").select("key", "score", F.explode("members").alias("vec_id"))
        nearest = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
        return members.withColumn("_at", F.row_number().over(nearest)).where(F.col("_at") <= k + 1).drop("_at")

    members = members_of(best)
    have = members.groupBy("key").agg(F.count("*").alias("n"))
    lacking = scratch.write(heads.join(have, "key", "left").where(F.coalesce("n", F.lit(0)) <= k).select("key", "vec"), "lacking")
    if short := lacking.count():
        ni, nq = max(1, -(-classes.count() // INDEX_BLOCK)), -(-short // QUERY_BLOCK)
        block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
        packed = lambda df: df.select("key", "vec").mapInArrow(_packed(dim), "key long, vec binary")
        index = packed(classes).withColumn("i", block(ni)).withColumn("j", F.explode(every(F.lit(nq))))
        wanted = packed(lacking).withColumn("j", block(nq)).withColumn("i", F.explode(every(F.lit(ni))))
        found = index.groupBy("i", "j").cogroup(wanted.groupBy("i", "j")).applyInArrow(_nearest(dim, kind, k + 1), "key long, near binary, scores binary")
        whole = scratch.write(found.groupBy("key").applyInArrow(_merged(k + 1), "key long, near long, score double"), "whole")
        members = members.join(lacking.select("key"), "key", "left_anti").unionByName(members_of(whole))
    out = of_head.join(members, "key").where("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
