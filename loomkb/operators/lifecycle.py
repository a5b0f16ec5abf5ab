"""State changes as transformations: each gives the rewritten rows, and which of them changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transitions of tickets and of articles (event, from, to), retry base in seconds and most retries.
TICKET_STEPS = [("start", 1, 2), ("request_info", 2, 3), ("supplement", 3, 2), ("resolve", 2, 4), ("close", 1, 5), ("close", 2, 5), ("close", 3, 5), ("close", 6, 5), ("withdraw", 1, 6)]
ARTICLE_STEPS = [("submit", 1, 2), ("approve", 2, 3), ("reject", 2, 5), ("publish", 3, 4), ("disable", 4, 0), ("restore", 0, 3)]
RETRY_BASE, MOST_RETRIES = 30, 3


def compare_and_set(rows: DataFrame, column: str, where: Column, expected, new) -> DataFrame:
    """``column`` set to ``new`` where the row is meant and still has ``expected``; ``changed`` says so."""
    hit = F.coalesce(where & (F.col(column) == F.lit(expected)), F.lit(False))
    return rows.withColumn("changed", hit).withColumn(column, F.when(F.col("changed"), F.lit(new).cast(rows.schema[column].dataType)).otherwise(F.col(column)))


def bounded_increment(rows: DataFrame, column: str, where: Column, most: int) -> DataFrame:
    hit = F.coalesce(where & (F.col(column) < most), F.lit(False))
    return rows.withColumn("changed", hit).withColumn(column, (F.col(column) + F.col("changed").cast("int")).cast(rows.schema[column].dataType))


def apply_events(rows: DataFrame, events: DataFrame, key: str, column: str, steps: list[tuple[str, int, int]]) -> DataFrame:
    """One event for each row at most (key, event): allowed ones change the state, others leave it (accepted false)."""
    moves = F.create_map(*[F.lit(x) for e, a, b in steps for x in (f"{e}:{a}", b)])
    asked = rows.join(events, key, "left")
    to = F.element_at(moves, F.concat_ws(":", "event", F.col(column).cast("string")))
    out = asked.withColumn("_to", F.when(F.col("event").isNotNull(), to))
    return out.withColumn("accepted", F.col("_to").isNotNull()).withColumn(column, F.coalesce("_to", column)).drop("_to")


def overdue(rows: DataFrame, now: Column, done: list) -> DataFrame:
    """Past their deadline and not done; null deadlines never are."""
    return rows.where((F.col("deadline_at") < now) & ~F.col("status").isin(done))


def retry_due(rows: DataFrame, now: Column, stuck_before: Column, in_flight: list[str], limit: int) -> DataFrame:
    """Failed rows whose time has come and in-flight ones that are stuck, oldest first."""
    due = (F.col("process_status") == "failed") & (F.col("next_retry_at") <= now)
    stuck = F.col("process_status").isin(in_flight) & (F.col("updated_at") < stuck_before)
    return rows.where(due | stuck).orderBy("updated_at", "id").limit(limit)


def retry_at(now: Column, retries: Column) -> Column:
    """30 s doubled with each retry; null once there were three."""
    return F.when(retries < MOST_RETRIES, F.timestamp_seconds(F.unix_timestamp(now) + RETRY_BASE * F.pow(F.lit(2), retries).cast("long")))


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the rows of the keys that go."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def expire_leases(queue: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """Items in work whose lease is older than ``seconds`` are pending again."""
    stale = (F.col("status") == "processing") & (F.unix_timestamp("lease_at") < F.unix_timestamp(now) - seconds)
    return queue.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("lease_at", F.when(stale, F.lit(None)).otherwise(F.col("lease_at")))
