"""The registered queries and the pipeline's stages on small tables with nulls, repeats, long texts and further columns."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import crc, edge_texts, library_ids, plain_components, plain_substrings, prose

from loomkb.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars int, score double, lists int"
STAGES = ("quality", "exact", "near", "substrings")


def rows():
    texts = [*edge_texts(), (900, "w " * 30_000 + prose(200, 900)), (901, "x" * 200_000)]
    return [(i, t, "en", "src", len(t or ""), 0.5, 1) for i, t in texts]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    own = rows()
    spark.createDataFrame([*own, *own[:9]], DOCS).write.parquet(f"{where}/documents.parquet")  # some rows twice
    spark.createDataFrame([(i, int(k % 3 > 0), 0) for k, (i, *_) in enumerate(own)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    rng = np.random.default_rng(5)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))] + [(60, None), (7, [0.0] * 8)], "vec_id long, embedding array<float>").write.parquet(f"{where}/embeddings.parquet")
    pages = [(1, "http://example.org/es/1", "<article><p>One and the other</p></article>"), (2, "http://q.net/", "<link rel=canonical href='http://x.com/de/1'>"), (3, None, None), (1, "http://example.org/es/1", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    spark.createDataFrame([(1, prose(60, 900)), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    where = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "embeddings", "pages", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{where}/{t}.parquet")
    return str(where)


def plain_texts():
    return [(i, t) for i, t, *_ in rows()]


def twice():
    return [*plain_texts(), *plain_texts()[:9]]


def test_op1(spark, folder):
    found = queries.op1_packing(spark, folder).collect()
    _, ids = library_ids("word_bpe_49k.json", [t or "" for _, t in plain_texts()])
    want = {i: [*x, 2] for (i, _), x in zip(plain_texts(), ids, strict=True)}
    ends, seen = {}, {}
    for r in found:
        own = want[r["doc_id"]]
        assert r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(own)
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    for own in ends.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 4096
    often = {i: sum(j == i for j, _ in twice()) for i in want}
    assert seen == {i: len(x) * often[i] for i, x in want.items()}


def test_op2(spark, folder):
    found = queries.op2_quality(spark, folder).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(i for i, _ in twice())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)


def test_op3(spark, folder):
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in queries.op3_html_text(spark, folder).collect()) == [(1, "", 0), (1, "One and the other", 17), (2, "", 0), (3, "", 0)]


def test_op4(spark, folder):
    want = plain_components(plain_texts(), 3, 90)
    found = queries.op4_jaccard_join(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted((i, *want[i]) for i, _ in twice())


def test_op5(spark, folder):
    t, ids = library_ids("byte_bpe_50k.json", [t or "" for _, t in plain_texts()])
    want = {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(plain_texts(), ids, strict=True)}
    found = queries.op5_bpe(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == sorted((i, *want[i]) for i, _ in twice())


def test_op6(spark, folder):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in twice():
        groups.setdefault(lower(t), []).append(i)
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted(map(tuple, queries.op6_exact_dedup(spark, folder).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want


def test_op7(spark, folder):
    _, ids = library_ids("byte_bpe_50k.json", [t or "" for _, t in plain_texts()])
    own, at, want = {i: [*x, 2] for (i, _), x in zip(plain_texts(), ids, strict=True)}, 0, []
    for i in sorted(i for i, _ in twice()):
        want.append((i, at, len(own[i]), crc(own[i])))
        at += len(own[i])
    assert sorted(map(tuple, queries.op7_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_op8(spark, folder):
    found = queries.op8_nearest(spark, folder).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40} and all(sum(r["query_id"] == q for r in found) == 20 for q in (0, 20, 40))


def test_op9(spark, folder):
    want = plain_substrings(plain_texts(), 20)
    found = queries.op9_substring_dedup(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == sorted((i, want[i][0], want[i][1], hashlib.sha256(want[i][2].encode()).hexdigest()) for i, _ in twice())


def test_op10(spark, folder):
    found = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in queries.op10_url_filter(spark, folder).collect())
    assert found == [(1, "example.org", "/es/1", "example.org/es/", "block")] * 2 + [(2, "q.net", "/", "", "block"), (3, "", "", "", "allow")]


def test_queries_of_empty_tables_have_no_rows(spark, empty):
    for name, run in queries.queries().items():
        assert run(spark, empty).count() == 0, name
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_ids_with_several_texts_and_null_ids(spark):
    one, two = prose(30, 70), prose(300, 71)
    odd = [(1, one), (1, two), (2, two), (None, two), (3, prose(40, 72) + " " + " ".join(two.split()[50:90])), (None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in queries.substring_dedup(spark, docs, width=20).collect())
    assert found == [(0, 0, 0), (0, 300, 0), (1, 30, 0), (1, 300, 0), (2, 300, 300), (3, 80, 40)]
    linked = [(r["doc_id"], r["component_id"]) for r in queries.shingle_components(spark, docs, size=3, percent=90).collect()]
    assert sorted(linked, key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (None, None), (None, None)], key=str)
    assert queries.exact_dedup(spark, docs).where("keep_id = 2").count() == 3
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    assert queries.score_quality(spark, docs, queries.fit_quality(spark, docs, labels)).count() == 6
    packed = queries.pack_documents(spark, docs, tokenizer=queries.tokenizer_path("word_bpe_49k.json"))
    assert packed.count() == 6 and queries.bpe_round_trip(spark, docs, tokenizer=queries.tokenizer_path("byte_bpe_50k.json")).count() == 6


@pytest.mark.parametrize("name", STAGES)
def test_stages_take_odd_rows(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.union(docs.limit(1).select(F.lit(None).cast("long"), F.lit("a null id"), *docs.columns[2:]))
    kept = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    if name == "exact":
        assert kept.select("doc_id").distinct().count() == docs.select(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).distinct().count()
    if name == "near":
        want = plain_components(plain_texts(), 5, 80)
        assert {r["doc_id"] for r in kept.collect()} == {None, *[i for i, (_, c) in want.items() if i == c]}
    if name == "substrings":
        want = plain_substrings(plain_texts(), 20)
        found = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert all(found[i] == (want[i][2] if want[i][1] else t) for i, t in plain_texts())
