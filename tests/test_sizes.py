"""Queries against their SQL, and how their work grows, on small tables made to show what the given ones don't."""

import datetime
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from loomkb.operators import bm25, publishing


def rows_and_sql(spark, folder, name, tables):
    """A query's rows and its SQL's, columns in the query's order, floats as text."""
    df = __spark_entry__.queries()[name](spark, str(folder))
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    at = [[x[0] for x in found.description].index(c) for c in df.columns]
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v
    return sorted(repr([plain(v) for v in r]) for r in df.collect()), sorted(repr([plain(r[k]) for k in at]) for r in found.fetchall())


def test_compacted_history_keeps_long_results_whole(spark, tmp_path):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "é" * 1400), (1, 2, "user", "r"), (1, 3, "assistant", "long " * 420), (2, 0, "user", "q"), (2, 1, "assistant", "z" * 2001)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found, want = rows_and_sql(spark, tmp_path, "compacted_history", ["conversations"])
    assert len(found) == 5 and found == want


def shuffled(spark, run):
    """MB that the jobs of ``run`` shuffle, spill and write."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (stages.apply(k) for k in range(stages.size())))

    before = total()
    run()
    return (total() - before) / 1e6


def test_keyword_search_shuffles_no_words(spark, tmp_path):
    rng = random.Random(5)
    names, moved, hits = [f"w{k}" for k in range(3000)], [], []
    benchmark = spark.createDataFrame([(q, " ".join(rng.choices(names, k=40))) for q in range(20)], "item_id long, text string")
    for n in (500, 2000):
        folder = tmp_path / str(n)
        docs = [(i, rng.choice([None, "", " ".join(rng.choices(names, k=80))]), rng.choice(["en", "de"]), rng.choice(["src3", "src4"])) for i in range(n)]
        docs += [(n + i, docs[7][1] or "w1 w2", "en", "src3") for i in range(40)]  # more copies than are asked for
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(f"{folder}/documents.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        moved.append(shuffled(spark, lambda: hits.append(rows_and_sql(spark, folder, "bm25_topk", ["documents", "benchmark"]))))  # noqa: B023
        found, want = rows_and_sql(spark, folder, "bm25_filtered_topk", ["documents", "benchmark"])
        assert len(found) == 200 and found == want
    assert all(len(found) == 200 and found == want for found, want in hits)
    assert moved[1] < 2 * moved[0]


def test_keyword_search_equals_the_joins(spark, monkeypatch):
    rng, names = random.Random(7), [f"w{k}" for k in range(60)]
    rows = [(rng.choice(["a", "b", None]), i, " ".join(rng.choices(names, k=rng.randint(0, 30))), rng.choice([None, "w1 w2"]), rng.choice([None, ["w3", "w4 w5"]]), rng.choice(["guide", None])) for i in range(300)]
    chunks = spark.createDataFrame(rows, "kb_id string, chunk_id long, content string, title string, tags array<string>, article_type string")
    asked = spark.createDataFrame([(q, kb, t) for q, t in enumerate(["w1 w2 w3", "w9 w9 w50", "none of it", "", "w5"]) for kb in ("a", "c", None)], "query_id long, kb_id string, query string")
    show = lambda df: sorted((r["query_id"], r["kb_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in df.collect())
    for keep in (None, bm25.matches_meta("guide", ["w3"])):
        want = show(bm25.retrieve(bm25.build_index(chunks), chunks, asked, 7, keep=keep))
        assert want and show(bm25.search(spark, chunks, asked, 7, keep=keep)) == want
    assert bm25.search(spark, chunks.limit(0), asked).count() == bm25.search(spark, chunks, asked.limit(0)).count() == 0
    monkeypatch.setattr(bm25, "SENT_TERMS", 2)
    assert show(bm25.search(spark, chunks, asked, 7)) == show(bm25.retrieve(bm25.build_index(chunks), chunks, asked, 7))


def test_vocabulary_moves_no_row_for_each_chunk(spark, tmp_path):
    rng, moved = random.Random(3), []
    names = [f"w{k}" for k in range(500)]
    for n in (400, 1600):
        docs = [(i, rng.choice([None, "", " ".join(rng.choices(names, k=80))]), rng.choice(["en", "de"])) for i in range(n)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).repartition(2).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        for name in ("bm25_postings", "bm25_index_stats"):
            run = lambda: found.append(rows_and_sql(spark, tmp_path / str(n), name, ["documents"]))  # noqa: B023, E731
            spark.createDataFrame([(0, "w1")], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
            found = []
            moved.append(shuffled(spark, run))
            assert found[0][0] and found[0][0] == found[0][1]
    assert moved[2] < 1.5 * moved[0]


def test_publishing_meets_no_pairs_row_by_row(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).tolist()
    v[7], v[8], v[9] = v[200], None, [2 * x for x in v[200]]
    rows = spark.createDataFrame([(i, i % 2, f"t{i}", v[i]) for i in range(300)], "article_id long, kb_id int, title string, embedding array<double>")
    asked, old = rows.where("article_id < 100"), rows.where("article_id >= 100")
    plan = publishing.refusals(old, asked, 0.9)
    assert "CartesianProduct" not in (text := plan._jdf.queryExecution().toString()) and "aggregate(zip_with" not in text
    unit = np.array([x or [np.nan] * 8 for x in v])
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    want = {i for i in range(100) if any(i % 2 == k % 2 and unit[i] @ unit[k] > 0.9 for k in range(100, 300))}
    assert {r["article_id"] for r in plan.where("reason = 'meaning'").collect()} == want and len(want) > 1
