"""The hybrid search pipeline: two legs, fusion, dedup, confidence, verdict, order, packing, limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import ranking
from ..operators.sizes import broadcast_if_few


def lexical_reranker(query: Column, content: Column) -> Column:
    """An offline reranker: the share of the query's tokens that the content holds."""
    asked = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(asked, tokens(content))) / F.greatest(F.size(asked), F.lit(1))


def with_contents(hits: DataFrame, contents: DataFrame, most: int | None = None) -> DataFrame:
    """``hits`` with their contents; if there are ``most`` hits at most and those are few, they are sent to where the contents are read."""
    return broadcast_if_few(hits, most).join(contents.select("chunk_id", "content"), "chunk_id")


def hybrid_search(
    vector: DataFrame,
    bm25: DataFrame,
    contents: DataFrame,
    *,
    limit: int = 5,
    pool: int = 30,
    budget: int = ranking.BUDGET,
    order: str = "sandwich",
    queries: DataFrame | None = None,
    reranker: Callable[[Column, Column], Column] | None = None,
    most_queries: int | None = None,
) -> DataFrame:
    """(query_id, place, chunk_id, content, score, confidence, verdict) from two ranked lists (query_id, chunk_id, rank, score).

    Order and packing come before the limit: of many hits the limit keeps the
    even ranks (order "confidence" keeps the best instead). Without a reranker, or for a
    single hit, confidence is the scaled fusion score, so the verdict of any hits is strong.
    With a known number of queries (``most_queries``), hits of few queries go to
    the contents rather than the contents to them.
    """
    hits = with_contents(ranking.rrf_fuse(vector, bm25, max(pool, limit)), contents, most_queries and most_queries * max(pool, limit))
    if reranker is not None and queries is not None:
        several = F.count("*").over(Window.partitionBy("query_id")) > 1
        hits = hits.join(queries.select("query_id", "query"), "query_id").withColumn("rerank_score", F.when(several, reranker(F.col("query"), F.col("content")))).drop("query")
        hits = ranking.rerank(hits)
    else:
        hits = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    hits = ranking.confidence(ranking.content_dedup(hits))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("confidence", 12)), "rank")
    hits = hits.withColumn("rank", F.row_number().over(best))
    hits = hits.withColumn("verdict", ranking.verdict_of(F.max(ranking.verdict_value()).over(Window.partitionBy("query_id"))))
    hits = ranking.sandwich(hits) if order == "sandwich" else hits.withColumn("pos", (F.col("rank") - 1).cast("long"))
    hits = ranking.pack_context(hits, budget)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    out = hits.withColumn("place", place).where(F.col("place") <= limit)
    return out.select("query_id", "place", "chunk_id", "content", "score", "confidence", "verdict")


def rendered(results: DataFrame) -> DataFrame:
    """(query_id, text): the verdict and the numbered results of each query."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("content"))
    rows = results.groupBy("query_id", "verdict").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "\n").alias("body"))
    return rows.select("query_id", F.concat(F.lit("[sufficiency: "), "verdict", F.lit("]\n"), "body").alias("text"))
