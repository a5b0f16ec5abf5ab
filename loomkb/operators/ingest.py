"""Incremental ingestion: chunk, hash, embed what is new, replace what changed."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import chunk_documents
from ..functions.text import chunk_hash, front_matter, tokens


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """A deterministic offline embedding: token counts hashed to ``dim`` signed components, of unit length."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for words in s:
                codes = np.array([zlib.crc32(w.encode()) for w in (words if words is not None else ())], np.int64)
                v = np.bincount(codes % dim, weights=1.0 - 2 * (codes >> 16 & 1), minlength=dim)
                out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
            yield pd.Series(out)

    def embed(text: Column) -> Column:
        return vectors(tokens(text))

    return embed


def hashed_chunks(articles: DataFrame, size: int = 500, overlap: int = 100, mode: str = "compat") -> DataFrame:
    """(article_id, chunk_index, content, chunk_hash) of articles (article_id, content), front matter stripped."""
    body = articles.select("article_id", front_matter(F.col("content"))[1].alias("content"))
    chunks = chunk_documents(body, id_col="article_id", text_col="content", size=size, overlap=overlap, mode=mode)
    return chunks.withColumn("chunk_hash", chunk_hash(F.col("article_id"), F.col("content")))


def incremental_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks with ``state`` reused (their hash is there) or changed, and old hashes that go (gone)."""
    there = old.select("article_id", "chunk_hash").distinct()
    rows = new.join(there.withColumn("_old", F.lit(True)), ["article_id", "chunk_hash"], "left")
    rows = rows.select("article_id", "chunk_hash", F.when(F.col("_old"), "reused").otherwise("changed").alias("state"))
    gone = there.join(new, ["article_id", "chunk_hash"], "left_anti").select("article_id", "chunk_hash", F.lit("gone").alias("state"))
    return rows.unionByName(gone)


def reindex(articles: DataFrame, old: DataFrame, embed: Callable[[Column], Column], size: int = 500, overlap: int = 100) -> DataFrame:
    """All chunks of ``articles`` with embeddings, computed for unknown hashes alone and taken from ``old`` (article_id, chunk_hash, embedding) otherwise."""
    chunks = hashed_chunks(articles, size, overlap)
    known = old.groupBy("article_id", "chunk_hash").agg(F.first("embedding").alias("embedding"))
    keys = ["article_id", "chunk_hash"]
    reused = chunks.join(known, keys)
    fresh = chunks.join(known, keys, "left_anti").withColumn("embedding", embed(F.col("content")))
    return reused.unionByName(fresh.select(reused.columns))


def replace_article_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Write chunks partitioned by article bucket, replacing the buckets that are written and leaving the others.

    Rows of other articles in the same bucket must be among ``chunks`` (see ``merged_buckets``).
    """
    rows = chunks.withColumn("bucket", F.pmod(F.xxhash64("article_id"), F.lit(buckets)).cast("int"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def merged_buckets(new: DataFrame, stored: DataFrame, buckets: int = 64) -> DataFrame:
    """``new`` chunks and the stored ones of other articles in the buckets that they touch."""
    bucket = F.pmod(F.xxhash64("article_id"), F.lit(buckets)).cast("int")
    touched = new.select(bucket.alias("bucket")).distinct()
    others = stored.withColumn("bucket", bucket).join(touched, "bucket", "left_semi").drop("bucket")
    return others.join(new.select("article_id").distinct(), "article_id", "left_anti").unionByName(new)
