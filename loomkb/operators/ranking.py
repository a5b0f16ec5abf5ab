"""From two ranked lists to a packed context. Lists carry query_id, chunk_id and rank or pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, token_estimate

#: Fusion constant, verdict thresholds, value of a flat list, context budget, least room for a cut item.
RRF_K, AMBIGUOUS, STRONG, FLAT, BUDGET, LEAST_ROOM = 30, 0.40, 0.70, 0.8, 2000, 100


def rrf_fuse(vector: DataFrame, bm25: DataFrame, k: int, *, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two lists (query_id, chunk_id, rank, score), best ``k`` of each query.

    A query with hits from one list alone keeps that list's raw scores.
    """
    both = vector.select("query_id", "chunk_id", "rank", "score", F.lit("vector").alias("leg")).unionByName(
        bm25.select("query_id", "chunk_id", "rank", "score", F.lit("bm25").alias("leg"))
    )
    legs = Window.partitionBy("query_id")
    both = both.withColumn("legs", F.size(F.collect_set("leg").over(legs)))
    gain = F.when(F.col("legs") == 1, F.col("score")).otherwise(1.0 / (constant + F.col("rank")))
    fused = both.groupBy("query_id", "chunk_id").agg(F.sum(gain).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def content_dedup(hits: DataFrame) -> DataFrame:
    """One hit for each content: the best score, at the place of the first."""
    same = Window.partitionBy("query_id", "content")
    best = same.orderBy(F.desc("score"), "rank")
    rows = hits.withColumn("first", F.min("rank").over(same)).withColumn("at", F.row_number().over(best)).where("at = 1")
    return rows.drop("at", "rank").withColumnRenamed("first", "rank")


def minmax(hits: DataFrame, name: str = "confidence", value: str = "score") -> DataFrame:
    """``value`` scaled to 0 .. 1 within a query; 0.8 for all where it is flat."""
    own = Window.partitionBy("query_id")
    low, high = F.min(value).over(own), F.max(value).over(own)
    return hits.withColumn(name, F.when(high == low, F.lit(FLAT)).otherwise((F.col(value) - low) / (high - low)))


def confidence(hits: DataFrame) -> DataFrame:
    """The clamped rerank score where the query has one, else the scaled score."""
    own = Window.partitionBy("query_id")
    ran = F.max(F.col("rerank_score").isNotNull()).over(own)
    scaled = minmax(hits, "scaled").withColumn("ran", ran)
    return scaled.withColumn("confidence", F.when(F.col("ran"), clamp(F.coalesce("rerank_score", F.lit(0.0)))).otherwise(F.col("scaled"))).drop("scaled", "ran")


def rerank(hits: DataFrame) -> DataFrame:
    """Places by rerank score; hits without one follow in their old order."""
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return hits.withColumn("rank", F.row_number().over(best))


def verdict_value() -> Column:
    """What a hit counts for in the verdict: its confidence, or its score where that is 0."""
    return F.when(F.col("confidence") == 0, F.col("score")).otherwise(F.col("confidence"))


def verdict_of(best: Column) -> Column:
    return F.when(best >= STRONG, "strong").when(best >= AMBIGUOUS, "ambiguous").otherwise("weak")


def verdicts(hits: DataFrame) -> DataFrame:
    """(query_id, verdict): by the best confidence, or its score where confidence is 0; weak without hits."""
    best = hits.groupBy("query_id").agg(F.max(verdict_value()).alias("best"))
    return best.select("query_id", verdict_of(F.col("best")).alias("verdict"))


def sandwich(hits: DataFrame) -> DataFrame:
    """``pos`` from 0: even ranks in order, then odd ranks backwards, so the best stand at both ends."""
    own = Window.partitionBy("query_id")
    r = F.row_number().over(own.orderBy("rank")) - 1
    rows = hits.withColumn("_r", r).withColumn("_n", F.count("*").over(own))
    pos = F.when(F.col("_n") <= 2, F.col("_r")).when(F.col("_r") % 2 == 0, F.floor(F.col("_r") / 2)).otherwise(F.col("_n") - 1 - F.floor((F.col("_r") - 1) / 2))
    return rows.withColumn("pos", pos.cast("long")).drop("_r", "_n")


def pack_context(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Items in ``pos`` order while their token estimates fit the budget.

    The first item always stays. The first that doesn't fit is cut to as many
    characters as tokens are left if those are over 100, else left out; nothing
    follows it. No budget (0 or less) keeps all.
    """
    if budget <= 0:
        return hits
    order = Window.partitionBy("query_id").orderBy("pos")
    rows = hits.withColumn("_t", token_estimate(F.col("content")))
    rows = rows.withColumn("_sum", F.sum("_t").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_i", F.row_number().over(order))
    rows = rows.withColumn("_left", budget - (F.col("_sum") - F.col("_t")))
    fits = (F.col("_sum") <= budget) | (F.col("_i") == 1)
    spilt = F.sum((~fits).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_fits", fits).withColumn("_spilt", spilt)
    rows = rows.where(F.col("_fits") & (F.col("_spilt") == 0) | ~F.col("_fits") & (F.col("_spilt") == 1) & (F.col("_left") > LEAST_ROOM))
    cut = F.concat(F.left("content", F.col("_left").cast("int")), F.lit("..."))
    cut = F.when(F.char_length("content") > F.col("_left"), cut).otherwise(F.col("content"))
    return rows.withColumn("content", F.when(F.col("_fits"), F.col("content")).otherwise(cut)).drop("_t", "_sum", "_i", "_left", "_fits", "_spilt")
