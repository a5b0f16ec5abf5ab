"""The stages of the corpus pipeline on a small corpus, each against what it must keep."""

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_their_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = corpus_pipeline.quality(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids for i in clean) >= 0.97 * len(clean)
    once = corpus_pipeline.exact(spark, docs, FOLDER)
    assert once.columns == docs.columns and once.count() == docs.selectExpr("lower(text) AS t").distinct().count()
    cut = corpus_pipeline.substrings(spark, docs, FOLDER)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_pipeline_packs_what_is_left(spark):
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.count() > 0 and pieces.select("doc_id").distinct().count() <= 200
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_texts_of_one_id_are_judged_each_by_itself(spark):
    long = " ".join(f"word{i}" for i in range(60))
    alike = long + " end"
    rows = [(1, "only here"), (1, "twice"), (2, "twice"), (3, long), (5, alike), (5, "another text that nobody else has at all"), (5, alike), (None, long), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.exact(spark, docs, FOLDER)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in once.collect()) == sorted((i or 0, t or "") for i, t in rows if (i, t) != (1, "twice"))
    near = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, FOLDER).collect()}
    assert (5, "another text that nobody else has at all") in near and (1, "only here") in near and (6, None) in near and (None, long) in near
    assert len(near & {(3, long), (5, alike)}) == 1 and len(near & {(1, "twice"), (2, "twice")}) == 1
