"""Streams: folding run events into messages, ingesting a queue, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.files import QUEUE_SCHEMA
from .state import keep_in_rocksdb

#: Event types that extend the last part of their type.
EXTENDING = ("token", "reasoning", "tool_args")
FOLDED = "run_id string, seq long, parts array<struct<type:string,content:string,id:string>>"
PART = "type string, content string, id string"


def _joined(a: str | None, b: str | None) -> str | None:
    return a if b is None else b if a is None else a + b


def fold_step(state: tuple[int, list], events: pd.DataFrame) -> tuple[int, list]:
    """(last seq, parts) after further events in order; those up to the last seq are repeats."""
    last, parts = state
    for e in events.sort_values("seq", kind="stable").itertuples():
        if e.seq <= last:
            continue
        last = int(e.seq)
        if e.type in EXTENDING and parts and parts[-1][0] == e.type and parts[-1][2] == e.id:
            parts[-1] = (e.type, _joined(parts[-1][1], e.content), e.id)
        elif e.type == "tool_result":
            parts.append(("tool_result", e.content, e.id))
        elif e.type in (*EXTENDING, "tool_call", "error"):
            parts.append((e.type, e.content, e.id))
    return last, parts


def _folded(run_id: Any, state: tuple[int, list]) -> pd.DataFrame:
    rows = [{"type": t, "content": c, "id": i} for t, c, i in state[1]]
    return pd.DataFrame({"run_id": [run_id], "seq": [state[0]], "parts": [rows]})


def _folded_batch(events: DataFrame) -> DataFrame:
    """What fold_step gives for whole runs: parts are islands of events that extend each other, found by windows."""
    rows = events.where("seq >= 0").dropDuplicates(["run_id", "seq"])
    told = rows.where(F.col("type").isin(*EXTENDING, "tool_result", "tool_call", "error"))
    order = Window.partitionBy("run_id").orderBy("seq")
    extends = F.col("type").isin(*EXTENDING) & (F.lag("type").over(order) == F.col("type")) & F.lag("id").over(order).eqNullSafe(F.col("id"))
    told = told.withColumn("new", F.when(extends, 0).otherwise(1)).withColumn("part", F.sum("new").over(order))
    pieces = F.sort_array(F.collect_list(F.struct("seq", "content")))
    content = F.when(F.count("content") > 0, F.array_join(F.transform(pieces, lambda x: x["content"]), ""))
    parts = told.groupBy("run_id", "part").agg(F.first("type").alias("type"), content.alias("content"), F.first("id").alias("id"))
    listed = parts.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("part", "type", "content", "id"))).alias("parts"))
    listed = listed.select(F.col("run_id").alias("_run"), F.transform("parts", lambda x: F.struct(x["type"].alias("type"), x["content"].alias("content"), x["id"].alias("id"))).alias("parts"))
    last = events.groupBy("run_id").agg(F.greatest(F.max("seq"), F.lit(-1)).cast("long").alias("seq"))
    none = F.array().cast("array<struct<type:string,content:string,id:string>>")
    return last.join(listed, F.col("run_id").eqNullSafe(F.col("_run")), "left").select("run_id", "seq", F.coalesce("parts", none).alias("parts"))


class _Fold(StatefulProcessor):
    """A run's last seq and open part, and its finished parts, which only grow; with event times all go ``keep_ms`` after the last event."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"seq long, some boolean, {PART}")
        self.done = handle.getListState("done", PART)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).astype(object)
        events = events.where(events.notna(), None)
        last, some, *part = self.open.get() if self.open.exists() else (-1, False, None, None, None)
        last, parts = fold_step((last, [tuple(part)] if some else []), events)
        if len(parts) > 1:
            self.done.appendList(parts[:-1])
        self.open.update((last, bool(parts), *(parts[-1] if parts else (None, None, None))))
        if self.keep_ms is not None:
            old = [int(t) for t in self.handle.listTimers()]
            for t in old:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max([*old, int(events["at"].max()) + self.keep_ms]))
        yield _folded(key[0], (last, [tuple(p) for p in self.done.get()] + parts[-1:]))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.open.clear()
        self.done.clear()
        return iter(())

    def close(self) -> None:
        pass


def fold_events(events: DataFrame, keep_seconds: int = 86_400, late: str = "1 hour") -> DataFrame:
    """(run_id, seq, parts) of each run of ``events`` (run_id, seq, type, content, id and perhaps ts), batch or stream.

    A stream keeps each run's last seq and parts as state and gives the run's whole message after
    each batch that touched it, so replayed events change nothing. Where events have a time ``ts``, a
    run's state goes ``keep_seconds`` after its last event, by the watermark; events more than ``late`` behind or without a time are left out.
    Without ``ts`` state stays. It needs a state store with timers, which is set if the session has the default one.
    """
    if not events.isStreaming:
        return _folded_batch(events)
    keep_in_rocksdb(events.sparkSession)
    names = ["run_id", "seq", "type", "content", "id"]
    if "ts" not in events.columns:
        return events.select(names).groupBy("run_id").transformWithStateInPandas(_Fold(None), FOLDED, "update", "None")
    rows = events.where("ts IS NOT NULL").select(*names, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.select(*names, "ts", F.unix_millis("ts").alias("at"))
    return rows.groupBy("run_id").transformWithStateInPandas(_Fold(keep_seconds * 1000), FOLDED, "update", "EventTime")


def consume_queue(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], *, files: int = 1) -> StreamingQuery:
    """Give each micro-batch of new pending queue items to ``handle(items, batch_id)`` until none is left.

    The checkpoint remembers what was taken, so a restart goes on where it
    stopped; ``handle`` may see a batch again after a failure and must be
    idempotent by its id.
    """
    items = spark.readStream.schema(QUEUE_SCHEMA).option("maxFilesPerTrigger", files).json(folder).where("status = 'pending'")
    return items.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sum of values by event-time window and type (beyond what the back office asks for)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("bucket"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user's events that lie less than ``gap`` apart (beyond what the back office asks for)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
