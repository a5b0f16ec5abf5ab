"""Limits on logins and revoked tokens, as batches and as streams whose state goes when its time has passed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import keep_in_rocksdb

#: Failures allowed and their window in seconds.
FAILURES, WINDOW_SECONDS = 5, 180
DECIDED = "user string, ts timestamp, ok boolean, allowed boolean"
SECOND = 1_000_000


def limit_step(state: tuple[int, int], attempts: Iterable[tuple[int, bool]], failures: int = FAILURES, seconds: int = WINDOW_SECONDS) -> tuple[tuple[int, int], list[bool]]:
    """Whether each attempt (microseconds, success) in time order is let through.

    Not after ``failures`` failures until more than ``seconds`` have passed since the first of them;
    a success that is let through forgets them. The state is (time of the first, failures).
    """
    start, fails = state
    allowed = []
    for at, ok in attempts:
        if fails and at - start > seconds * SECOND:
            fails = 0
        allowed.append(fails < failures)
        if not allowed[-1]:
            continue
        if ok:
            fails = 0
        else:
            start, fails = (at, 1) if not fails else (start, fails + 1)
    return (start, fails), allowed


def _stretches(attempts: DataFrame, failures: int, seconds: int) -> DataFrame:
    """Attempts with ``_part``: stretches of a user's attempts before which nothing is remembered.

    One starts after a gap longer than the window, and after a success with less than ``failures`` failures in
    the window before it, which is let through whatever came before. Looked for in pieces of time that reach back two windows, so that
    a user with a third of all rows is spread; numbers of starts by piece join them.
    """
    near, width = seconds * SECOND, max(3600, 20 * seconds) * SECOND
    piece = F.floor(F.col("_at") / width)
    rows = attempts.select("user", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("ok", F.lit(False)).alias("ok"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    again = F.when(F.col("_at") >= (piece + 1) * width - 2 * near, F.array(piece, piece + 1)).otherwise(F.array(piece))
    rows = rows.select("*", piece.alias("_home"), F.explode(again).alias("_piece"))
    by = Window.partitionBy("user", "_piece")
    order = by.orderBy("_at", "ok")
    recent = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(by.orderBy("_at").rangeBetween(-near, 0))
    rows = rows.withColumn("_free", F.col("ok") & (recent < failures))
    fresh = F.coalesce((F.col("_at") - F.lag("_at").over(order) > near) | F.lag("_free").over(order), F.lit(True))
    rows = rows.withColumn("_new", F.when(fresh, 1).otherwise(0)).where("_home = _piece")
    rows = rows.withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    starts = rows.groupBy("user", "_piece").agg(F.sum("_new").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("user").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col("user").alias("_user"), F.col("_piece").alias("_of"), before.alias("_before"))
    rows = rows.join(starts, F.col("user").eqNullSafe(F.col("_user")) & (F.col("_piece") == F.col("_of")))
    return rows.select("user", "ts", "ok", "_at", (F.col("_before") + F.col("_k")).alias("_part"))


def _limited_batch(attempts: DataFrame, failures: int, seconds: int) -> DataFrame:
    """Stretches lie whole and in order in one partition each and are read through with a state of two numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple[Any, int] | None = None
        state = (0, 0)
        for rows in batches:
            told = []
            for user, ok, at, part in rows[["user", "ok", "_at", "_part"]].itertuples(index=False):
                if (user, part) != key:
                    key, state = (user, part), (0, 0)
                state, allowed = limit_step(state, [(at, ok)], failures, seconds)
                told += allowed
            yield rows[["user", "ts", "ok"]].assign(allowed=told)

    rows = _stretches(attempts.where("ts IS NOT NULL"), failures, seconds).repartition("user", "_part").sortWithinPartitions("user", "_part", "_at", "ok")
    timeless = attempts.where("ts IS NULL").select("user", F.lit(None).cast("timestamp").alias("ts"), F.coalesce("ok", F.lit(False)).alias("ok"), F.lit(None).cast("boolean").alias("allowed"))
    return rows.mapInPandas(run, DECIDED).unionByName(timeless)


class _Limiter(StatefulProcessor):
    """One user's (first failure, failures), dropped by a timer once the window has passed."""

    def __init__(self, failures: int, seconds: int):
        self.failures, self.seconds = failures, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "start long, fails long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        found = found.assign(ok=found["ok"].fillna(False).astype(bool)).sort_values(["at", "ok"], kind="stable")
        old = tuple(self.seen.get()) if self.seen.exists() else (0, 0)
        new, allowed = limit_step(old, zip(found["at"].tolist(), found["ok"].tolist(), strict=True), self.failures, self.seconds)
        if new != old:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if new[1]:
                self.seen.update(new)
                self.handle.registerTimer(new[0] // 1000 + self.seconds * 1000 + 1)
            else:
                self.seen.clear()
        yield found[["user", "ts", "ok"]].assign(allowed=allowed)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_logins(attempts: DataFrame, failures: int = FAILURES, seconds: int = WINDOW_SECONDS, late: str = "1 hour") -> DataFrame:
    """(user, ts, ok, allowed) of ``attempts`` (user, ts, ok), batch or stream; users are limited apart from each other.

    A null ``ok`` is a failure. An attempt without a time is not judged (allowed is null) and counts for nothing;
    a stream leaves it out, and with it attempts that come more than ``late`` after the newest, as every stream by event time.
    A stream judges a user's attempts in the order of their batches and sorts within one; it needs a
    state store with timers, which is set if the session has the default one.
    """
    if not attempts.isStreaming:
        return _limited_batch(attempts, failures, seconds)
    keep_in_rocksdb(attempts.sparkSession)
    rows = attempts.where("ts IS NOT NULL").select("user", F.col("ts").cast("timestamp").alias("ts"), "ok", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).withWatermark("ts", late)
    return rows.groupBy("user").transformWithStateInPandas(_Limiter(failures, seconds), DECIDED, "append", "EventTime")


class _Revoked(StatefulProcessor):
    """A token's first revocation, kept until the token expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        gone = found[found["revoke"]]
        old = self.first.get()[0] if self.first.exists() else None
        first = min([*gone["at"].tolist(), *([] if old is None else [old])], default=None)
        if first is not None and first != old:
            self.first.update((first,))
        if len(gone):
            ends = [*(int(x) for x in self.handle.listTimers()), *(int(x) // 1000 + 1 for x in gone["ends"].tolist())]
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(ends))
        uses = found[~found["revoke"]]
        allowed = (uses["at"] < uses["ends"]) & ((uses["at"] < first) if first is not None else True)
        yield uses[["token", "ts"]].assign(allowed=allowed)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def refuse_revoked(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(token, ts, allowed) of each use among ``events`` (token, ts, revoke, expires_at), batch or stream.

    A use is refused from the token's first revocation on, and from its end. Events that lack the token, the time or the end are left
    out; a null ``revoke`` is a use. A batch joins uses with one row a revoked token; a stream keeps that row until the token's end.
    """
    rows = events.where("token IS NOT NULL AND ts IS NOT NULL AND expires_at IS NOT NULL")
    rows = rows.select("token", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("revoke", F.lit(False)).alias("revoke"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.unix_micros(F.col("expires_at").cast("timestamp")).alias("ends"))
    if events.isStreaming:
        keep_in_rocksdb(events.sparkSession)
        return rows.withWatermark("ts", late).groupBy("token").transformWithStateInPandas(_Revoked(), "token string, ts timestamp, allowed boolean", "append", "EventTime")
    first = rows.where("revoke").groupBy("token").agg(F.min("at").alias("_first"))
    uses = rows.where("NOT revoke").join(first, "token", "left")
    return uses.select("token", "ts", ((F.col("at") < F.col("ends")) & F.coalesce(F.col("at") < F.col("_first"), F.lit(True))).alias("allowed"))
