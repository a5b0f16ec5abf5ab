"""Retrieval metrics over ranked lists (query_id, doc_id, rank) and relevance (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_seen(hits: DataFrame, owner: str) -> DataFrame:
    """Owners of ranked chunks, each at the place of its first chunk."""
    first = hits.groupBy("query_id", owner).agg(F.min("rank").alias("at"))
    return first.select("query_id", F.col(owner).alias("doc_id"), F.row_number().over(Window.partitionBy("query_id").orderBy("at", owner)).alias("rank"))


def metrics(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, reciprocal_rank, ndcg) of every query with relevant documents.

    The ideal of nDCG is as long as the list retrieved, k at most. Queries without hits have zeros.
    """
    rel = relevant.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    totals = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    rows = hits.join(rel, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    discount = 1.0 / F.log2(F.col("rank") + 1)
    own = rows.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias("found"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), discount).otherwise(0.0)).alias("dcg"),
        F.least(F.lit(k), F.count("*")).alias("kk"),
    )
    out = totals.join(own, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("kk", "n_rel").cast("int")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1))
    return out.select(
        "query_id",
        F.coalesce(F.col("found") / F.col("n_rel"), F.lit(0.0)).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.when(F.col("kk") > 0, F.col("dcg") / ideal), F.lit(0.0)).alias("ndcg"),
    )


def macro_average(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])
