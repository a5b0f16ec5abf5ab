"""Exact cosine search and semantic duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import broadcast_if_small


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def clean_vector(v: Column) -> Column:
    """NaN and infinite components become 0, others are rounded to 8 digits."""
    return F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.round(x.cast("double"), 8)))


def parse_vector(text: Column) -> Column:
    """Components of a [a,b,...] literal."""
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    return F.when(inner == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("double")))


def page_size(k: int) -> int:
    """k, 10 if not positive, 100 at most."""
    return 10 if k <= 0 else min(k, 100)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int = 10, *, keep: Column | None = None) -> DataFrame:
    """(vec_id, score, rank) of the ``k`` vectors nearest to one query vector.

    The filter comes before the ranking; a top-k is kept in each task, so only k rows a task move.
    """
    rows = vectors if keep is None else vectors.where(keep)
    v = F.array(*[F.lit(float(x)) for x in query])
    best = rows.select("vec_id", cosine(F.col("embedding"), v).alias("score")).orderBy(F.desc("score"), "vec_id").limit(page_size(k))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "vec_id")))


def nearest_of_queries(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score, rank) for a stated table of queries (query_id, query), each against all vectors.

    Queries are broadcast if they are few, and meet the vectors in blocks otherwise. Lengths are found once for each vector.
    """
    own = vectors.select("vec_id", "embedding", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("_v"))
    asked = queries.select("query_id", "query", F.sqrt(dot(F.col("query"), F.col("query"))).alias("_q"))
    pairs = own.crossJoin(broadcast_if_small(asked)).where("query_id <> vec_id")
    hits = pairs.select("query_id", "vec_id", (dot(F.col("embedding"), F.col("query")) / (F.col("_v") * F.col("_q"))).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= page_size(k))


def semantic_duplicates(vectors: DataFrame, candidates: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(candidate_id, vec_id, score) of stored vectors that a stated table of new ones (candidate_id, query) repeats, themselves aside."""
    pairs = vectors.crossJoin(broadcast_if_small(candidates)).where("candidate_id <> vec_id")
    return pairs.select("candidate_id", "vec_id", cosine(F.col("embedding"), F.col("query")).alias("score")).where(F.col("score") >= threshold)
