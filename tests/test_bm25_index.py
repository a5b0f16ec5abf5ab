"""The stored keyword index against scoring everything."""

import random

import pytest
from pyspark.sql import functions as F

from loomkb.operators import bm25, bm25_index
from loomkb.stored import Folder, built_once

ROWS = "kb_id string, chunk_id long, content string, title string, tags array<string>, article_type string"


def rows(n=400, seed=3):
    rng = random.Random(seed)
    names = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    out = []
    for i in range(n):
        content = " ".join(rng.choices(names, k=rng.randint(0, 60)))
        if i % 50 == 7:
            content = "needle haystack " * 3 + content
        out.append((rng.choice("ab"), i, content, rng.choice([None, "needle", "w1 w2"]), rng.choice([None, [], ["w3", "tag word"]]), rng.choice(["guide", "faq"])))
    return [*out, ("a", n, None, None, None, "guide"), ("c", n + 1, "", None, [], "faq")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(rows(), ROWS).cache()


@pytest.fixture(scope="module")
def index(spark, chunks):
    return bm25_index.write_index(chunks, Folder(spark, "test-index"))


@pytest.fixture(scope="module")
def asked(spark):
    texts = ["needle haystack", "w1 w2 w3 w4 w5", "w9 tag", "nothing of it", "", "word needle w1 w1", "w7"]
    return spark.createDataFrame([(q, kb, t) for q, t in enumerate(texts) for kb in "abc"], "query_id long, kb_id string, query string")


def shown(df):
    return sorted((r["query_id"], r["kb_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [0, 1, 3, 25])
def test_equal_to_scoring_everything(spark, chunks, index, asked, k):
    assert shown(bm25_index.search(spark, index, asked, k)) == shown(bm25.retrieve(bm25.build_index(chunks), chunks, asked, k))


def test_filter_comes_before_the_cut(spark, chunks, index, asked):
    keep = bm25.matches_meta("faq", ["tag word"])
    found = bm25_index.search(spark, index, asked, 5, keep=chunks.where(keep).select("kb_id", "chunk_id"))
    assert shown(found) == shown(bm25.retrieve(bm25.build_index(chunks), chunks, asked, 5, keep=keep))


def test_statistics(spark, chunks, index):
    plain = bm25.build_index(chunks)
    assert sorted(map(tuple, index.stats.collect())) == sorted(map(tuple, plain.corpus_stats.select("kb_id", "n_docs", "avgdl").collect()))
    assert sorted(map(tuple, index.dictionary.select("kb_id", "token", "df").collect())) == sorted(map(tuple, plain.document_frequencies().collect()))


def test_few_blocks_are_read(spark, index):
    asked = spark.createDataFrame([(1, "a", "needle haystack w1 w2"), (2, "b", "haystack w3")], "query_id long, kb_id string, query string")
    search = bm25_index.Search(index, asked, Folder(spark, "test-search"), 3)
    assert search.top().count() == 6
    read, met, _ = search.shares()
    assert 0 < read < 0.3 * met


def test_one_token_reads_one_bucket(spark, index):
    asked = spark.createDataFrame([(1, "a", "haystack")], "query_id long, kb_id string, query string")
    search = bm25_index.Search(index, asked, Folder(spark, "test-search"))
    plan = search.blocks._jdf.queryExecution().toString()
    assert search.blocks.select(F.input_file_name().alias("f")).distinct().where(~F.col("f").contains("bucket=")).count() == 0
    assert search.blocks.select(F.regexp_extract(F.input_file_name(), r"bucket=(\d+)", 1).alias("b")).distinct().count() == 1 and "PartitionFilters" in plan


def test_empty_tables(spark, chunks, index, asked):
    nothing = bm25_index.write_index(chunks.limit(0), Folder(spark, "test-empty"))
    assert bm25_index.search(spark, nothing, asked).count() == 0
    assert bm25_index.search(spark, index, asked.limit(0)).count() == 0


def test_built_once_for_each_state_of_the_files(spark, tmp_path):
    made = []

    def build(folder):
        made.append(folder.write(spark.range(3), "t"))
        return made[-1]

    path = str(tmp_path / "source")
    spark.range(5).write.parquet(path)
    for _ in range(2):
        assert built_once(spark, "x", spark.read.parquet(path), build).count() == 3
    assert len(made) == 1
    spark.range(6).write.mode("append").parquet(path)
    built_once(spark, "x", spark.read.parquet(path), build)
    assert len(made) == 2
