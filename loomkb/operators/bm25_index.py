"""A stored BM25 index: blocks of postings with their greatest score, and top-k that reads only blocks that can matter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens as default_tokens
from ..stored import Folder, delete
from .bm25 import B, K1, build_index, top_k

#: Tokens are dealt to so many buckets (folders), chunks of one block share their id but for so many bits.
#: Wider ranges have fewer blocks but looser bounds: at sf0.1, 200 questions of some 70 tokens read 5 % of their
#: tokens' blocks with 2 bits, 27 % with 3, 58 % with 4 and 70 % with 5.
BUCKETS, BLOCK_BITS = 32, 2
#: Ranges that each query scores first, to learn what its k-th best is worth.
SEEDS = 12
#: Narrow rows up to which a query-side table is sent to all executors (some 10 MB).
SENT_ROWS = 200_000


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def saturated(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a frequency counts in a chunk of a length, before the token's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass
class StoredIndex:
    """blocks (kb_id, token, range, best, size, postings, bucket), dictionary (kb_id, token, df, bucket), stats (kb_id, n_docs, avgdl).

    A block has a token's postings (chunk_id, tf, dl) among the chunks of a range of
    ids, and the most that any of them counts before the token's weight.
    """

    blocks: DataFrame
    dictionary: DataFrame
    stats: DataFrame


def write_index(chunks: DataFrame, folder: Folder, tokenizer: Callable[[Column], Column] = default_tokens) -> StoredIndex:
    """Index ``chunks`` (see ``bm25.build_index``) into ``folder``; texts are split once.

    Blocks lie in one folder for each bucket of tokens, ordered by token and
    range, so that a query reads the buckets and row groups of its own tokens.
    A hot token's blocks are spread by range before they are written.
    """
    index = build_index(chunks, tokenizer)
    words = folder.write(index.words.groupBy("kb_id", "token", "chunk_id").agg(F.sum("times").alias("tf"), F.max("dl").alias("dl")), "words")
    stats = folder.write(_stats(chunks, words), "stats")
    rows = words.join(stats, "kb_id").withColumn("range", F.shiftright("chunk_id", BLOCK_BITS))
    blocks = rows.groupBy("kb_id", "token", "range").agg(
        F.max(saturated(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("best"),
        F.count("*").cast("int").alias("size"),
        F.sort_array(F.collect_list(F.struct("chunk_id", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl")))).alias("postings"),
    )
    blocks = blocks.withColumn("bucket", bucket_of(F.col("token"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "kb_id", "token", "range")
    blocks = folder.write(blocks, "blocks", "bucket")
    dictionary = folder.write(blocks.groupBy("kb_id", "token", "bucket").agg(F.sum("size").alias("df")), "dictionary", "bucket")
    delete(folder.spark, f"{folder.path}/words")
    return StoredIndex(blocks, dictionary, stats)


def _stats(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """Chunks, and their mean length, of each knowledge base; lengths come with the words, chunks without any have none."""
    lengths = words.groupBy("kb_id", "chunk_id").agg(F.max("dl").alias("dl")).groupBy("kb_id").agg(F.sum("dl").alias("total"))
    sizes = chunks.groupBy("kb_id").agg(F.count("*").alias("n_docs"))
    return sizes.join(lengths, "kb_id", "left").select("kb_id", "n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avgdl"))


def _sent(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast behind a count of its rows."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


class Search:
    """One set of queries (query_id, kb_id, query) against a stored index; its steps are written to ``folder``.

    ``bounds`` (query_id, kb_id, range, bound) has the most that a chunk of each range
    can score: the sum of its blocks' bests. A few ranges with the highest
    bounds are scored first; their k-th best score is what a range's bound must
    reach to be read at all. So every skipped block belongs to chunks that
    cannot be among the best, and results equal those of scoring everything.
    """

    def __init__(self, index: StoredIndex, queries: DataFrame, folder: Folder, k: int = 10, keep: DataFrame | None = None, tokenizer: Callable[[Column], Column] = default_tokens):
        self.k, self.keep, self.folder = (k if k > 0 else 10), keep, folder
        terms = queries.select("query_id", "kb_id", F.explode(F.array_distinct(tokenizer(F.col("query")))).alias("token")).distinct()
        terms = terms.withColumn("bucket", bucket_of(F.col("token")))
        asked = [r[0] for r in terms.select("bucket").distinct().collect()]  # BUCKETS at most
        self.blocks = index.blocks.where(F.col("bucket").isin(asked)).drop("bucket")
        idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        known = index.dictionary.where(F.col("bucket").isin(asked)).join(terms, ["kb_id", "token", "bucket"]).join(index.stats, "kb_id")
        self.terms = _sent(folder.write(known.select("query_id", "kb_id", "token", idf.alias("idf"), "avgdl"), "terms"))
        heads = self.blocks.select("kb_id", "token", "range", "best").join(self.terms, ["kb_id", "token"])
        bounds = heads.groupBy("query_id", "kb_id", "range").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"), F.count("*").alias("n_blocks"))
        self.bounds = folder.write(bounds, "bounds")

    def scored(self, ranges: DataFrame) -> DataFrame:
        """(query_id, kb_id, chunk_id, score) of the chunks of ``ranges`` (query_id, kb_id, range) that ``keep`` keeps."""
        hits = self.blocks.join(self.terms, ["kb_id", "token"]).join(ranges, ["query_id", "kb_id", "range"])
        hits = hits.select("query_id", "kb_id", "idf", "avgdl", F.explode("postings").alias("p"))
        gain = F.col("idf") * saturated(F.col("p.tf"), F.col("p.dl"), F.col("avgdl"))
        found = hits.groupBy("query_id", "kb_id", F.col("p.chunk_id").alias("chunk_id")).agg(F.sum(gain).alias("score")).where("score > 0")
        return found if self.keep is None else found.join(self.keep, ["kb_id", "chunk_id"], "left_semi")

    def ranges(self) -> DataFrame:
        """(query_id, kb_id, range, n_blocks) of the ranges that are read."""
        first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "kb_id", "range")
        seeds = self.bounds.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SEEDS).select("query_id", "kb_id", "range")
        seeds = _sent(self.folder.write(seeds, "seeds"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        kth = self.scored(seeds).withColumn("nth", F.row_number().over(best)).where(F.col("nth") == self.k).select("query_id", F.col("score").alias("least"))
        reach = F.col("least").isNull() | (F.col("bound") >= F.col("least") * (1 - 1e-9))
        return self.folder.write(self.bounds.join(kth, "query_id", "left").where(reach).select("query_id", "kb_id", "range", "n_blocks"), "ranges")

    def top(self) -> DataFrame:
        """(query_id, kb_id, chunk_id, score, rank) of each query's k best."""
        self.read = self.ranges()
        return top_k(self.scored(_sent(self.read.drop("n_blocks"))), self.k)

    def shares(self) -> tuple[int, int, int]:
        """(query, block) pairs that were scored, all such pairs of the asked tokens, and the index's blocks times the queries."""
        n = self.terms.select("query_id").distinct().count()
        return (self.read.agg(F.sum("n_blocks")).first()[0] or 0, self.bounds.agg(F.sum("n_blocks")).first()[0] or 0, self.blocks.count() * n)


def search(spark: SparkSession, index: StoredIndex, queries: DataFrame, k: int = 10, *, keep: DataFrame | None = None, tokenizer: Callable[[Column], Column] = default_tokens) -> DataFrame:
    """Each query's best ``k`` chunks (10 if not positive), equal to ``bm25.retrieve``; ``keep`` (kb_id, chunk_id) filters before the cut."""
    return Search(index, queries, Folder(spark, "bm25-search"), k, keep, tokenizer).top()
