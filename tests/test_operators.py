"""Operators on small hand-made inputs and against plain versions."""

import datetime
import io
import json
import random
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomkb.functions import chunking, text
from loomkb.operators import bm25, conversation, evaluation, ingest, lifecycle, ranking, relational, vectors
from loomkb.plans.hybrid import hybrid_search
from loomkb.sources import files
from loomkb.streaming import events as streams
from loomkb.streaming import logins


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, score double")


def test_fusion_prefers_what_both_legs_found(spark):
    vector = hits(spark, [(1, 1, 1, 0.95), (1, 2, 2, 0.8), (1, 3, 3, 0.6)])
    words = hits(spark, [(1, 2, 1, 0.9), (1, 3, 2, 0.7), (1, 4, 3, 0.5)])
    found = [r["chunk_id"] for r in ranking.rrf_fuse(vector, words, 10).orderBy("rank").collect()]
    assert found == [2, 3, 1, 4]


def test_fusion_keeps_raw_scores_of_a_single_leg(spark):
    vector, none = hits(spark, [(1, 1, 1, 0.95), (1, 2, 2, 0.8)]), hits(spark, [])
    assert [r["score"] for r in ranking.rrf_fuse(vector, none, 5).orderBy("rank").collect()] == [0.95, 0.8]
    assert ranking.rrf_fuse(none, none, 5).count() == 0


def test_sandwich_puts_the_best_at_both_ends(spark):
    for n in (0, 1, 2, 3, 5, 8):
        rows = hits(spark, [(1, k, k + 1, 1.0 - k / 10) for k in range(n)])
        found = [r["chunk_id"] for r in ranking.sandwich(rows).orderBy("pos").collect()]
        want = list(range(n)) if n <= 2 else [k for k in range(n) if k % 2 == 0] + [k for k in range(n) if k % 2][::-1]
        assert found == want


def tokens_of(s):
    na = sum(ord(c) > 127 for c in s)
    return na + (len(s.encode()) - na) // 4


def packed(items, budget):
    if budget <= 0:
        return items
    out, used = [], 0
    for k, s in enumerate(items):
        t = tokens_of(s)
        if used + t <= budget or k == 0:
            out.append(s)
            used += t
            continue
        left = budget - used
        if left > 100:
            out.append(s[:left] + "..." if len(s) > left else s)
        break
    return out


def test_packing_like_the_plain_loop(spark):
    rng = random.Random(3)
    for budget in (0, 1, 150, 400):
        items = ["".join(rng.choice("abcé中😀 ") for _ in range(rng.choice([0, 10, 300, 900]))) for _ in range(8)]
        rows = spark.createDataFrame([(1, k, s) for k, s in enumerate(items)], "query_id int, pos int, content string")
        assert [r["content"] for r in ranking.pack_context(rows, budget).orderBy("pos").collect()] == packed(items, budget)


def test_confidence_and_verdicts(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0.9, None), (1, 2, 2, 0.1, None), (2, 1, 1, 0.5, None), (3, 1, 1, 0.5, 0.2), (3, 2, 2, 0.4, 1.7)], "query_id int, chunk_id int, rank int, score double, rerank_score double")
    found = {(r["query_id"], r["chunk_id"]): r["confidence"] for r in ranking.confidence(rows).collect()}
    assert found == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 0.8, (3, 1): 0.2, (3, 2): 1.0}
    edge = spark.createDataFrame([(1, 0.7, 0.0), (2, 0.4, 0.0), (3, 0.39, 0.0), (4, 0.0, 0.05)], "query_id int, confidence double, score double")
    assert {r["query_id"]: r["verdict"] for r in ranking.verdicts(edge).collect()} == {1: "strong", 2: "ambiguous", 3: "weak", 4: "weak"}


def test_search_without_hits(spark):
    none = hits(spark, [])
    assert hybrid_search(none, none, spark.createDataFrame([], "chunk_id int, content string")).count() == 0


def test_titles_count_twice_and_tags_three_times(spark):
    rows = spark.createDataFrame([(1, 1, "alpha beta", "gamma", ["delta"])], "kb_id int, chunk_id int, content string, title string, tags array<string>")
    index = bm25.build_index(rows)
    assert {r["token"]: r["tf"] for r in index.postings.collect()} == {"alpha": 1, "beta": 1, "gamma": 2, "delta": 3}
    assert index.doc_stats.first()["dl"] == 4


def test_knowledge_bases_are_apart(spark):
    rows = spark.createDataFrame([(1, 1, "vpn connection fails"), (1, 2, "mail login"), (2, 3, "vpn connection")], "kb_id int, chunk_id int, content string")
    asked = spark.createDataFrame([(7, 1, "VPN vpn connection"), (8, 3, "vpn")], "query_id int, kb_id int, query string")
    found = bm25.retrieve(bm25.build_index(rows), rows, asked, 3).collect()
    assert [(r["query_id"], r["chunk_id"]) for r in found] == [(7, 1)]


def test_metrics_against_plain_versions(spark):
    rows = hits(spark, [(1, 5, 1, 1.0), (1, 6, 2, 0.9), (1, 7, 3, 0.8)]).withColumnRenamed("chunk_id", "doc_id")
    rel = spark.createDataFrame([(1, 6), (1, 7), (1, 9), (2, 1)], "query_id int, doc_id int")
    found = {r["query_id"]: r for r in evaluation.metrics(rows, rel, 10).collect()}
    import math

    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert abs(found[1]["recall"] - 2 / 3) < 1e-12 and found[1]["reciprocal_rank"] == 0.5 and abs(found[1]["ndcg"] - dcg / ideal) < 1e-12
    assert found[2]["recall"] == found[2]["reciprocal_rank"] == found[2]["ndcg"] == 0.0


def test_vector_literals(spark):
    assert one(spark, vectors.parse_vector(F.col("v")), v="[1, 2.5,-3]") == [1.0, 2.5, -3.0]
    assert one(spark, vectors.clean_vector(F.col("v")), v=[float("nan"), float("inf"), 0.123456789]) == [0.0, 0.0, 0.12345679]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab中。!\n #`-", max_size=300), st.integers(5, 60), st.integers(0, 20))
def test_chunks_are_bounded(body, size, overlap):
    for path, own in chunking.sections(chunking.normalise(body)):
        assert all(len(p) <= size for p in chunking.split(own, size, overlap))
    clean = chunking.chunk(body, size, 0, mode="clean")
    assert all(c.strip() for c in clean)


def test_chunk_cases():
    assert chunking.chunk("") == [] and chunking.chunk(None) == []
    assert chunking.chunk("x" * 10, 10, 0) == ["x" * 10]
    assert chunking.normalise("a！\r\n\n\n\nb\n```\n！\n```") == "a!\n\nb\n```\n！\n```"
    opened = chunking.chunk("# A\n" + "word " * 40, 50, 0)
    assert opened[0] == "" and all(c.startswith("# A\n") for c in opened[1:])
    nested = [("# A", "x"), ("# A\n### C", "y"), ("# A\n## B", "z")]
    assert list(chunking.sections("# A\nx\n### C\ny\n## B\nz")) == [("", ""), *nested]
    assert list(chunking.sections("# A\nx\n### C\ny\n## B\nz", "clean")) == nested
    assert chunking.windows("abcdefgh", 4, 2) == ["abcd", "cdef", "efgh"]


def test_front_matter_cases(spark):
    cases = ["plain", "---\ntype: guide\nnote: a:b\n---\nbody", "---\r\ntype: x\r\n---", "---\nunended"]
    want = [({}, "plain"), ({"type": "guide", "note": "a:b"}, "body"), ({"type": "x"}, ""), ({}, "---\nunended")]
    fields, body = text.front_matter(F.col("s"))
    found = spark.createDataFrame([(k, s) for k, s in enumerate(cases)], "k int, s string").select("k", fields.alias("f"), body.alias("b")).orderBy("k").collect()
    assert [(r["f"], r["b"]) for r in found] == want


def test_permissions_and_urls(spark):
    for held, asked, want in ((["*"], ["a"], True), (["doc:*"], ["doc:read"], True), (["doc:*"], ["user:read"], False), (["a"], [], False), ([], ["a"], False)):
        row = spark.createDataFrame([(held, asked)], "h array<string>, r array<string>")
        assert row.select(text.has_permission(F.col("h"), F.col("r")).alias("x")).first()["x"] is want
    for url, want in (("https://a.org/x", True), ("ftp://a.org", False), ("http://127.0.0.1/", False), ("http://10.1.2.3", False), ("http://172.20.0.1", False), ("http://169.254.169.254/", False), ("nothing", False)):
        assert one(spark, text.public_url(F.col("u")), u=url) is want
    assert one(spark, text.valid_password(F.col("p")), p="Abcdefg1") and not one(spark, text.valid_password(F.col("p")), p="abcdefg1")
    assert one(spark, text.tag_list(F.col("t")), t="[a, 'b' ,]") == ["a", "b"]


def test_search_page_links(spark):
    page = '<a class="result__a" href="//x/l/?uddg=https%3A%2F%2Fa.org%2Fb&amp;r=1">A &amp; <b>B</b></a>'
    assert [tuple(r) for r in one(spark, text.search_results(F.col("p")), p=page)] == [("https://a.org/b", "A & B")]


def test_conversation_stages(spark):
    rows = [(1, 0, "system", "s")] + [(1, k, "tool" if k % 3 == 0 else "user", "same" * 80 if k % 3 == 0 else f"m{k}") for k in range(1, 20)]
    m = spark.createDataFrame(rows, "thread_id int, seq int, role string, content string")
    zones = [r["zone"] for r in conversation.with_zones(m).orderBy("seq").collect()]
    assert zones == ["head"] + ["middle"] * 9 + ["tail"] * 10
    deduped = [r["content"] for r in conversation.dedup_results(m).where("role = 'tool'").orderBy("seq").collect()]
    assert deduped[0] == "same" * 80 and set(deduped[1:]) == {conversation.REPEATED}
    blanked = conversation.blank_old_results(m, F.col("role") == "tool").where("role = 'tool'").orderBy("seq").collect()
    assert [r["content"] == conversation.BLANKED for r in blanked] == [True, True, True, False, False, False]
    assert conversation.snip(m, 100).count() == 17 and conversation.snip(m, 10**6).count() == 20
    long = spark.createDataFrame([(1, 1, "tool", "x" * 2500)], "thread_id int, seq int, role string, content string")
    assert conversation.cap_results(long).first()["content"] == "x" * 2000 + conversation.CUT


def test_lifecycle_and_bridges(spark):
    queue = spark.createDataFrame([("processing", "2024-01-01 00:00:00"), ("processing", "2024-01-01 00:01:30"), ("done", None)], "status string, t string")
    queue = queue.select("status", F.to_timestamp("t").alias("lease_at"))
    assert sorted(r["status"] for r in lifecycle.expire_leases(queue, F.lit("2024-01-01 00:02:00").cast("timestamp")).collect()) == ["done", "pending", "processing"]
    counts = spark.createDataFrame([(1, 2), (2, 3)], "id int, c int")
    assert [r["c"] for r in lifecycle.bounded_increment(counts, "c", F.lit(True), 3).orderBy("id").collect()] == [3, 3]
    bridge, new = spark.createDataFrame([(1, 1), (2, 1)], "u int, r int"), spark.createDataFrame([(1, 5), (1, 6)], "u int, r int")
    assert sorted(map(tuple, relational.replace_links(bridge, new, "u").collect())) == [(1, 5), (1, 6), (2, 1)]
    pictures, articles = spark.createDataFrame([("ab.png",), ("cd.png",)], "name string"), spark.createDataFrame([("![x](image/ab.png)",)], "content string")
    assert [r["name"] for r in relational.unreferenced_images(pictures, articles).collect()] == ["cd.png"]


def test_reindex_embeds_only_what_changed(spark, tmp_path):
    articles = spark.createDataFrame([(1, "one text"), (2, "two text")], "article_id long, content string")
    embed = ingest.hashing_embedder(8)
    none = spark.createDataFrame([], "article_id long, chunk_hash string, embedding array<float>")
    first = ingest.reindex(articles, none, embed)
    ingest.replace_article_chunks(first, str(tmp_path / "chunks"), buckets=4)
    stored = spark.read.parquet(str(tmp_path / "chunks")).drop("bucket")
    marked = stored.withColumn("embedding", F.array(F.lit(9.0).cast("float")))
    again = ingest.reindex(spark.createDataFrame([(1, "one text"), (2, "changed")], "article_id long, content string"), marked, embed)
    assert {r["article_id"]: len(r["embedding"]) for r in again.collect()} == {1: 1, 2: 8}
    merged = ingest.merged_buckets(again.where("article_id = 2"), stored, buckets=1)
    assert {r["article_id"] for r in merged.collect()} == {1, 2} and merged.count() == 2


def test_office_files(spark, tmp_path):
    def packed_zip(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in members.items():
                z.writestr(name, body)
        return out.getvalue()

    w = 'xmlns:w="http://x"'
    (tmp_path / "a.docx").write_bytes(packed_zip({"word/document.xml": f"<w:d {w}><w:p><w:t>Hi</w:t><w:t> all</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:d>", "word/media/i.png": "x"}))
    (tmp_path / "b.docx").write_bytes(packed_zip({"word/document.xml": "<w:p><w:t>odd</w:t>"}))
    slide = '<s xmlns:a="http://a"><a:p><a:t>{0}</a:t></a:p></s>'
    (tmp_path / "c.pptx").write_bytes(packed_zip({"ppt/slides/slide10.xml": slide.format("ten"), "ppt/slides/slide2.xml": slide.format("two")}))
    (tmp_path / "d.xlsx").write_bytes(packed_zip({"xl/sharedStrings.xml": "<s><si><t>h</t></si></s>", "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c></row><row><c/></row><row><c><v>5</v></c></row></w>'}))
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "f.txt").write_text("plain")
    found = {r["path"].rsplit("/", 1)[1]: r for r in files.parse_files(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")).collect()}
    assert found["a.docx"]["markdown"] == "Hi all\na | b" and found["b.docx"]["markdown"] == "odd"
    assert found["c.pptx"]["markdown"] == "two\n\n---\n\nten" and found["d.xlsx"]["markdown"] == "| h |\n| --- |\n| 5 |"
    assert found["e.pdf"]["error"] and found["f.txt"]["markdown"] == "plain"
    assert files.images_of((tmp_path / "a.docx").read_bytes(), "docx") == {"i.png": b"x"}
    assert files.list_files(spark, str(tmp_path), "*.docx").count() == 2


def test_ir_corpus(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text(json.dumps({"_id": "1", "title": "t", "text": "x"}))
    (tmp_path / "queries.jsonl").write_text("\n".join(json.dumps({"_id": k, "text": "q"}) for k in "ab"))
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\na\t1\t1\n")
    docs, asked, rel = files.read_ir_corpus(spark, str(tmp_path))
    assert (docs.count(), [r["query_id"] for r in asked.collect()], rel.first()["score"]) == (1, ["a"], 1)


EVENTS = [("r", 1, "reasoning", "th", "m"), ("r", 2, "reasoning", "ink", "m"), ("r", 3, "token", "a", "m"), ("r", 3, "token", "a", "m"), ("r", 4, "tool_call", "f", "t"), ("r", 5, "tool_args", "{", "t"), ("r", 6, "tool_args", "}", "t"), ("r", 7, "tool_result", "ok", "t")]
EVENT_SCHEMA = "run_id string, seq long, type string, content string, id string"


def test_fold_in_batch_and_stream(spark, tmp_path):
    want = [("reasoning", "think", "m"), ("token", "a", "m"), ("tool_call", "f", "t"), ("tool_args", "{}", "t"), ("tool_result", "ok", "t")]
    batch = streams.fold_events(spark.createDataFrame(EVENTS, EVENT_SCHEMA)).first()
    assert [tuple(p) for p in batch["parts"]] == want and batch["seq"] == 7
    for k, part in enumerate((EVENTS[:4], EVENTS[2:])):  # the second file replays two events
        spark.createDataFrame(part, EVENT_SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = streams.fold_events(source).writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("SELECT parts FROM folded ORDER BY seq DESC, size(parts) DESC LIMIT 1").first()["parts"]
    assert [tuple(p) for p in last] == want


def test_login_limit_in_batch_and_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("u", at(s), False) for s in (0, 10, 20, 30, 40, 50)] + [("u", at(179), True), ("u", at(181), False), ("v", at(1), True)]
    attempts = spark.createDataFrame(rows, "user string, ts timestamp, ok boolean")
    allowed = [r["allowed"] for r in logins.limit_logins(attempts).where("user = 'u'").orderBy("ts").collect()]
    assert allowed == [True] * 5 + [False, False, True]
    attempts.coalesce(1).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema("user string, ts timestamp, ok boolean").json(str(tmp_path / "in"))
    q = logins.limit_logins(source).writeStream.outputMode("append").format("memory").queryName("limited").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["allowed"] for r in spark.sql("SELECT * FROM limited WHERE user = 'u' ORDER BY ts").collect()] == allowed


def test_queue_is_consumed_once(spark, tmp_path):
    items = spark.createDataFrame([(42, 1, "a.md", "index")], "article_id long, kb_id long, file_path string, action string")
    for c, t in (("ts", "timestamp"), ("status", "string"), ("lease_at", "timestamp")):
        items = items.withColumn(c, F.lit(None).cast(t))
    files.append_queue(items, str(tmp_path / "queue"))
    (tmp_path / "queue" / "bad.json").write_text("{broken\n")
    assert files.read_queue(spark, str(tmp_path / "queue")).where("status = 'pending' AND ts IS NOT NULL").count() == 1
    seen = []
    for _ in range(2):
        q = streams.consume_queue(spark, str(tmp_path / "queue"), str(tmp_path / "ck"), lambda df, k: seen.extend(r["article_id"] for r in df.collect()))
        q.awaitTermination()
    assert seen == [42]
