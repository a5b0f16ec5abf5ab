"""Labels, memory, sinks and the later conversation stages."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomkb.functions import misc
from loomkb.operators import conversation, memory
from loomkb.sources import sinks


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_labels_and_answers(spark):
    assert value(spark, misc.label(F.lit(4), misc.TICKET_STATES)) == "已解决" and value(spark, misc.label(F.lit(99), misc.TICKET_STATES)) == "未知"
    assert value(spark, misc.label(F.lit("system"), misc.MESSAGE_KINDS, None)) == "系统通知" and value(spark, misc.label(F.lit("x"), misc.MESSAGE_KINDS, None)) == "x"
    assert value(spark, misc.media_type(F.lit("a.JPG"))) == "image/jpeg" and value(spark, misc.media_type(F.lit("x"))) == "application/octet-stream"
    assert tuple(value(spark, misc.verdict_of(F.lit('```json\n{"level": "weak", "reason": "r"}\n```')))) == ("weak", "r")
    assert tuple(value(spark, misc.verdict_of(F.lit("no json")))) == ("ambiguous", "")
    assert value(spark, misc.completed_type(F.lit("faq"), F.lit(""))) == "faq" and value(spark, misc.completed_type(F.lit(""), F.lit('x {"type": "note"} y'))) == "note"
    assert value(spark, misc.completed_type(F.lit("odd"), F.lit("{broken"))) == "guide"
    assert value(spark, misc.ticket_number(F.lit("2024-03-05").cast("date"), F.lit(42))) == "TK-20240305-000042"
    assert value(spark, misc.masked(F.lit("sk-1234567890"))) == "sk-1****7890" and value(spark, misc.masked(F.lit("short"))) == "****"
    assert value(spark, misc.valid_phone(F.lit("13812345678"))) and not value(spark, misc.valid_phone(F.lit("12812345678")))


def test_images(spark):
    names = F.create_map(F.lit("p/a.png"), F.lit("ff.png"))
    text = F.lit('![x](p/a.png) <img src="p/a.png"> ![y](https://z/p/a.png)')
    assert value(spark, misc.rewritten_images(text, names)) == '![x](image/ff.png) <img src="image/ff.png"> ![y](https://z/p/a.png)'
    assert value(spark, misc.image_name(F.lit("p/a.png"), F.lit("abc"))) == "ba7816bf8f01cfea.png"


def test_memory(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [("user", "", "b", "likes tea", "x", False, at), ("user", "", "a", "d", "Tea at five", False, at), ("user", "", "c", "tea", "", True, at)]
    entries = spark.createDataFrame(rows, "scope string, session_id string, key string, description string, body string, disabled boolean, updated_at timestamp")
    assert [(r["key"], r["score"]) for r in memory.recall(entries, "TEA", "user", 5).collect()] == [("a", 1.0), ("b", 0.5)]
    newer = entries.where("key = 'a'").withColumn("body", F.lit("new")).withColumn("updated_at", F.lit("2025-01-01").cast("timestamp"))
    assert {r["key"]: r["body"] for r in memory.remember(entries, newer).collect()} == {"a": "new", "b": "x", "c": ""}
    assert memory.index_page(entries).first()["page"] == "# Memory\n\n- a: d\n- b: likes tea"
    assert memory.index_page(entries, 3).first()["page"] == "# Memory\n\n- a: d"
    tokens = spark.createDataFrame([("t1",), ("t2",)], "token string")
    black = spark.createDataFrame([("t1", datetime.datetime(2025, 1, 1)), ("t2", datetime.datetime(2020, 1, 1))], "token string, expires_at timestamp")
    assert [r["token"] for r in memory.revoked(tokens, black, F.lit("2024-06-01").cast("timestamp")).collect()] == ["t2"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, [1.0, 2.0]), (1, [3.0, 4.0])], "id int, embedding array<float>")
    sinks.append_vectors(rows, str(tmp_path / "v"), 2)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    with pytest.raises(Exception, match="should have 3"):
        sinks.append_vectors(rows, str(tmp_path / "w"), 3)
    sinks.export_csv(rows.select("id"), str(tmp_path / "c"), ["id"])
    (part,) = (tmp_path / "c").glob("part*.csv")
    assert part.read_text(encoding="utf-8") == "﻿id\n1\n2\n"
    for k in (1, 2):
        sinks.publish_version(rows.limit(k), str(tmp_path / "p"), k)
    assert sinks.read_published(spark, str(tmp_path / "p")).count() == 2


def test_later_stages(spark):
    m = spark.createDataFrame([(1, 0, "system", "s")] + [(1, k, "user", f"message {k}") for k in range(1, 16)], "thread_id int, seq int, role string, content string")
    short = conversation.autocompact(m, 20).orderBy("seq").collect()
    assert [r["seq"] for r in short] == [0, 1, *range(6, 16)] and short[1]["content"].startswith("[summary") and "message 5" in short[1]["content"]
    assert conversation.autocompact(m, 10**6).count() == 16
    deltas = spark.createDataFrame([(1, 0, 2, None, '"x"}'), (1, 0, 1, "f", '{"a":')], "message_id int, index int, seq int, name string, arguments string")
    assert tuple(conversation.merge_deltas(deltas).first()) == (1, 0, "f", '{"a":"x"}')
    parts = spark.createDataFrame([("r", "1", "tool_call", "f"), ("r", "1", "tool_result", "ok"), ("r", "2", "tool_call", "g")], "run_id string, id string, type string, content string")
    assert {r["id"]: r["result"] for r in conversation.paired_calls(parts).collect()} == {"1": "ok", "2": None}


def test_front_matter_query_covers_all_texts(spark, tmp_path):
    import hashlib

    from loomkb.queries import REGISTRY

    texts = {1: "a\r\nb", 2: "a\rb", 3: None, 4: "", 5: "a\nb"}
    spark.createDataFrame([(i, t, "en", "web") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: tuple(r)[1:] for r in REGISTRY["front_matter_round_trip"][0](spark, str(tmp_path)).collect()}
    assert found == {i: ("en", "web", hashlib.md5(("# web\n\n" + (t or "").replace("\r\n", "\n")).encode()).hexdigest()) for i, t in texts.items()}


def test_batches_of_events_are_dealt_by_islands(spark):
    import datetime
    import random

    import pandas as pd

    from loomkb.streaming import events as streams
    from loomkb.streaming import logins

    rng, start = random.Random(5), datetime.datetime(2024, 1, 1)
    at, rows = start, []
    for _ in range(400):
        at += datetime.timedelta(seconds=rng.choice([1, 5, 20, 60, 179, 180, 181, 182, 400]))
        rows.append(("u", at, rng.random() < 0.2))
    limited = logins.limit_logins(spark.createDataFrame(rows, "user string, ts timestamp, ok boolean"))
    want = logins.limit_step((0, 0), [(round((t - start).total_seconds() * 1e6), ok) for _, t, ok in rows])[1]
    assert [r["allowed"] for r in limited.orderBy("ts").collect()] == want
    kinds = ["token", "token", "reasoning", "tool_args", "tool_call", "tool_result", "error", "start"]
    events = [(r, n, rng.choice(kinds), f"c{n}", rng.choice(["a", "a", "b", None])) for r in ("x", "y") for n in range(200)] + [("z", 3, "start", "c", "a"), ("w", -1, "token", "c", "a")]
    folded = streams.fold_events(spark.createDataFrame(events + events[:50], "run_id string, seq long, type string, content string, id string"))
    found = {r["run_id"]: (r["seq"], [tuple(p) for p in r["parts"]]) for r in folded.collect()}
    for run in "xyzw":
        own = pd.DataFrame([e for e in events if e[0] == run], columns=["run_id", "seq", "type", "content", "id"]).astype({"id": object})
        own["id"] = own["id"].where(own["id"].notna(), None)
        assert found[run] == streams.fold_step((-1, []), own)
    assert "InPandas" not in folded._jdf.queryExecution().toString()  # no run is one task's group


def test_results_are_capped_by_bytes_at_whole_characters(spark):
    rows = [("t", 1, "tool", "中" * 700), ("t", 2, "tool", "x" * 2001), ("t", 3, "tool", "x" * 2000), ("t", 4, "user", "中" * 700)]
    found = {r["seq"]: r["content"] for r in conversation.cap_results(spark.createDataFrame(rows, "thread_id string, seq int, role string, content string")).collect()}
    assert found[1] == "中" * 666 + conversation.CUT and found[2] == "x" * 2000 + conversation.CUT
    assert found[3] == "x" * 2000 and found[4] == "中" * 700


def test_han_characters_are_tokens(spark):
    from loomkb.functions.text import tokens

    assert value(spark, tokens(F.lit("Go语言 v2 x 知识库"))) == ["go", "语", "言", "v2", "知", "识", "库"]
