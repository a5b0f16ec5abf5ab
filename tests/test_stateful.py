"""Limits, revocations and folds: batches against plain versions, streams against batches, state that goes."""

import datetime
import random

import pytest

from loomkb.streaming import events as streams
from loomkb.streaming import logins

START = datetime.datetime(2024, 1, 1, 0, 59)
ATTEMPT = "user string, ts timestamp, ok boolean"


def later(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain_limits(rows):
    """Each user's attempts one after the other, windows as lists of failures."""
    out = []
    for user in {r[0] for r in rows}:
        window = []
        for _, ts, ok in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2])):
            if window and (ts - window[0]).total_seconds() > 180:
                window = []
            allowed = len(window) < 5
            out.append((user, ts, ok, allowed))
            if allowed:
                window = [] if ok else [*window, ts]
    return sorted(out, key=repr)


def attempts_of(seed, n=1500):
    rng = random.Random(seed)
    rows = []
    for user, steps, share in (("hot", [0, 1, 7, 30], 0.1), ("bot", [1, 10], 0.0), ("calm", [30, 179, 180, 181, 400], 0.6), (None, [5, 90], 0.3)):
        at = 0
        for _ in range(n if user == "hot" else n // 4):
            at += rng.choice(steps)
            rows.append((user, later(at), rng.random() < share))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_limits_in_batch(spark, seed):
    rows = attempts_of(seed)
    made = logins.limit_logins(spark.createDataFrame(rows, ATTEMPT))
    assert sorted(map(tuple, made.collect()), key=repr) == plain_limits(rows)


def test_odd_attempts(spark):
    rows = [("u", later(0), None), ("u", None, True), ("u", later(180), False)] + [("u", later(k), False) for k in (1, 2, 3, 4, 5)] + [("u", later(181), False)]
    made = {(r["ts"], r["allowed"]) for r in logins.limit_logins(spark.createDataFrame(rows, ATTEMPT)).collect()}
    assert made == {(None, None), (later(5), False), (later(180), False), (later(181), True)} | {(later(k), True) for k in range(5)}
    assert logins.limit_logins(spark.createDataFrame([], ATTEMPT)).collect() == []


def run_stream(spark, tmp_path, parts, schema, make):
    source = str(tmp_path / "in")
    for rows in parts:  # a file each, and a run each, so that the clock and the watermark move in between
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        made = make(spark.readStream.schema(schema).json(source))
        q = made.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
        q.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()


def kept(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "ck"))


def test_limits_as_a_stream(spark, tmp_path):
    rows = sorted((r for r in attempts_of(3, 400) if r[0]), key=lambda r: (r[1], r[2]))
    cut = [0, 100, 350, len(rows)]
    while cut and any(rows[c - 1][1] == rows[c][1] for c in cut[1:-1]):
        cut = [0, cut[1] + 1, cut[2] + 2, len(rows)]
    parts = [rows[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    run_stream(spark, tmp_path, parts, ATTEMPT, lambda s: logins.limit_logins(s, late="1 day"))
    made = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, made.collect()), key=repr) == plain_limits(rows)
    assert kept(spark, tmp_path, "seen").count() > 0
    end = max(r[1] for r in rows) + datetime.timedelta(days=3)
    run_stream(spark, tmp_path, [[("other", end, True)], [("other", end, True)]], ATTEMPT, lambda s: logins.limit_logins(s, late="1 day"))
    assert kept(spark, tmp_path, "seen").count() == 0


TOKEN = "token string, ts timestamp, revoke boolean, expires_at timestamp"


def test_revocations_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(4)
    ends = {f"t{k}": later(rng.randint(100, 2000)) for k in range(20)}
    rows = sorted(((t, later(rng.randint(0, 2500)), rng.random() < 0.1, e) for t, e in ends.items() for _ in range(20)), key=lambda r: r[1])
    rows += [(None, later(3), False, later(9)), ("x", None, False, later(9)), ("y", later(2600), None, None)]
    first = {t: min((r[1] for r in rows if r[0] == t and r[2]), default=None) for t in ends}
    want = sorted((t, ts, ts < e and not (first[t] and ts >= first[t])) for t, ts, gone, e in rows if t in ends and not gone)
    made = logins.refuse_revoked(spark.createDataFrame(rows, TOKEN))
    assert sorted(map(tuple, made.collect())) == want
    run_stream(spark, tmp_path, [rows[:150], rows[150:300], rows[300:]], TOKEN, lambda s: logins.refuse_revoked(s, "1 day"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    assert kept(spark, tmp_path, "first").count() > 0
    end = ("z", later(10**6), False, later(10**7))
    run_stream(spark, tmp_path, [[end], [end]], TOKEN, lambda s: logins.refuse_revoked(s, "1 day"))
    assert kept(spark, tmp_path, "first").count() == 0


def test_fold_state_goes(spark, tmp_path):
    schema = "run_id string, seq long, type string, content string, id string, ts timestamp"
    rows = [("r", 1, "token", "a", "m"), ("r", 2, "token", None, "m"), ("r", 3, "tool_call", "f", "t"), ("r", 3, "tool_call", "f", "t"), ("r", 4, "tool_args", "{}", "t"), ("q", 0, "start", None, None)]
    rows = [(*r, later(k)) for k, r in enumerate(rows)]
    end = ("s", 1, "token", "z", "m", later(10**6))
    out = []

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        made = streams.fold_events(spark.readStream.schema(schema).json(str(tmp_path / "in")), 3600)
        q = made.writeStream.outputMode("update").foreachBatch(lambda df, k: out.extend(df.collect()))
        q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    run(rows[:3])
    run(rows[3:])
    shown = {r["run_id"]: (r["seq"], [tuple(p) for p in r["parts"]]) for r in out}
    assert shown == {"r": (4, [("token", "a", "m"), ("tool_call", "f", "t"), ("tool_args", "{}", "t")]), "q": (0, [])}
    whole = streams.fold_events(spark.createDataFrame(rows, schema))
    assert {r["run_id"]: (r["seq"], [tuple(p) for p in r["parts"]]) for r in whole.collect()} == shown
    assert kept(spark, tmp_path, "open").count() == 2
    run([end])
    run([end])
    assert [r["key"]["run_id"] for r in kept(spark, tmp_path, "open").collect()] == ["s"]
