"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; ``run`` writes each stage's rows as Parquet to the shared folder
and reads them back. All but the last stage return the columns of documents.

In every stage null texts count as empty and long ones are taken whole; rows
repeated with their id and text go or stay together, and several texts of one
id are judged each by itself; without rows, none come out; further columns pass
through. Rows with a null id stay in the stages that
compare documents (no other row can name them), and empty texts stay but in
``exact``, where they equal each other, and ``quality``, which scores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.llm.common import Scratch
from loomkb.llm.exact_dedup import digest, exact_dedup
from loomkb.llm.jaccard_join import shingle_components
from loomkb.llm.packing import pack_documents
from loomkb.llm.quality import fit_quality, score_quality
from loomkb.llm.queries import held_out, table, tokenizer_path
from loomkb.llm.substrings import substring_dedup

#: Near duplicates: shingles of so many words, similarity in hundredths.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Words of a window whose repetition is removed.
WINDOW_WORDS = 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels not held out, does not reject."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = score_quality(spark, docs, fit_quality(spark, docs, labels))
    return scored.where("predicted = 1").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (A-Z lower-cased), the one with the largest id."""
    gone = exact_dedup(spark, docs).where("NOT kept").select("doc_id", F.col("digest").alias("_digest"))
    return docs.withColumn("_digest", digest("text")).join(gone, ["doc_id", "_digest"], "left_anti").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Of an id with several texts, the text with the least digest goes by the id and
    each other one by a hash of id and digest, so that the id links no two texts.
    """
    digests = docs.select("doc_id", digest("text").alias("digest")).where("doc_id IS NOT NULL")
    several = digests.groupBy("doc_id").agg(F.min("digest").alias("_first"), F.max("digest").alias("last"))
    # written, so that Spark knows how few these are when it plans the join
    several = Scratch(spark, "several-texts").write(several.where("_first <> last").drop("last"), "ids")
    other = F.col("_first") != digest("text")
    key = F.when(other, F.xxhash64("doc_id", digest("text")).bitwiseAND(F.lit(2**63 - 1))).otherwise(F.col("doc_id").cast("long"))
    keyed = docs.join(several, "doc_id", "left").withColumn("_key", key)
    groups = shingle_components(spark, keyed.select(F.col("_key").alias("doc_id"), "text"), size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_key"))
    return keyed.join(gone, "_key", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of words that began earlier; texts that lose nothing stay as they are."""
    cut = substring_dedup(spark, docs.withColumn("_whole", F.col("text")), width=WINDOW_WORDS)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("_whole"))
    cut = cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 4096."""
    return pack_documents(spark, docs, tokenizer=tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substrings", substrings), ("packing", packing)]

#: The classifier and the tokenizer are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
