"""Lookups, guards and row changes of the back office: each a filter, a join or a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts in an embedding request, days that a report covers at most, the system's name for id 0.
BATCH, MOST_DAYS, SYSTEM = 20, 90, "system"


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids`` (key), each once however often it is asked for."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def newest_first(rows: DataFrame, owner: str, at: str, key: str) -> DataFrame:
    """``place`` of each row among its owner's, the newest first, equal times by the larger key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at), F.desc(key))))


def taken(rows: DataFrame, asked: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``asked`` with ``taken``: whether a row other than the asking one (by ``key``) has the same ``columns``."""
    others = rows.groupBy(*columns).agg(F.count_distinct(key).alias("_n"), F.min(key).alias("_one"))
    out = asked.join(others, columns, "left")
    other = (F.col("_n") > 1) | (F.col("_n") == 1) & ~F.col("_one").eqNullSafe(F.col(key))
    return out.withColumn("taken", F.coalesce(other, F.lit(False))).drop("_n", "_one")


def with_names(rows: DataFrame, people: DataFrame, columns: dict[str, str], key: str, name: str) -> DataFrame:
    """A name column for each of several id columns (id column: name column); the system's for id 0, empty for unknown ids."""
    for c, into in columns.items():
        rows = rows.join(people.select(F.col(key).alias(c), F.col(name).alias(into)), c, "left")
        rows = rows.withColumn(into, F.when(F.col(c) == 0, F.lit(SYSTEM)).otherwise(F.coalesce(into, F.lit(""))))
    return rows


def or_default(value: Column, default: str) -> Column:
    """``value``, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def rendered_page(title: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), body)


def valid_range(start: Column, end: Column) -> Column:
    """Whether two yyyy-MM-dd texts are dates in order that span MOST_DAYS at most."""
    a, b = (F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("date") for c in (start, end))
    return F.coalesce((a <= b) & (F.date_diff(b, a) <= MOST_DAYS), F.lit(False))


def batched(rows: DataFrame, owner: str, order: str, size: int = BATCH) -> DataFrame:
    """``batch`` from 0 and ``place`` in it for each owner's rows in order."""
    at = F.row_number().over(Window.partitionBy(owner).orderBy(order)) - 1
    return rows.withColumn("_at", at).withColumn("batch", F.floor(F.col("_at") / size)).withColumn("place", (F.col("_at") % size).cast("int")).drop("_at")


def checked_embeddings(asked: DataFrame, answers: DataFrame, dim: int) -> DataFrame:
    """(batch, n, fault) of each request: what is wrong with the answered ``place``s and vectors of ``asked`` (batch, place), or null.

    A request is at fault with a place out of range, one answered twice, one not
    answered, or a vector of another dimension, in this order.
    """
    sizes = asked.groupBy("batch").agg(F.count("*").alias("n"))
    got = answers.groupBy("batch").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("m"), F.count_distinct("place").alias("d"), F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).alias("odd")
    )
    fault = (
        F.when((F.col("low") < 0) | (F.col("high") >= F.col("n")), "index out of range")
        .when(F.col("m") > F.col("d"), "duplicate index")
        .when(F.coalesce("d", F.lit(0)) < F.col("n"), "missing index")
        .when(F.col("odd") > 0, "dimension")
    )
    return sizes.join(got, "batch", "left").select("batch", "n", fault.alias("fault"))


def changed(rows: DataFrame, hit: Column, **values: Column) -> DataFrame:
    """``rows`` with other values in some columns where ``hit``; ``changed`` tells which rows those are."""
    hit = F.coalesce(hit, F.lit(False))
    new = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}
    return rows.withColumns(new | {"changed": hit})


def closed_in_batch(rows: DataFrame, asked: DataFrame, key: str, open_states: list[str]) -> DataFrame:
    """(key, result) for each asked key: closed, not open (its state forbids it) or missing."""
    there = rows.select(key, F.col("status").isin(open_states).alias("_open"))
    result = F.when(F.col("_open"), "closed").when(~F.col("_open"), "not open").otherwise("missing")
    return asked.select(key).distinct().join(there, key, "left").select(key, result.alias("result"))


def guarded_removal(rows: DataFrame, asked: DataFrame, key: str, group: str) -> DataFrame:
    """``asked`` (key) with ``allowed``: not where all that is left of a row's group would go (the last administrators)."""
    marked = rows.join(asked.select(key).distinct().withColumn("_asked", F.lit(True)), key, "left")
    left = marked.groupBy(group).agg(F.count_if(F.col("_asked").isNull()).alias("_left"))
    return marked.where("_asked").join(left, group).select(key, (F.col("_left") > 0).alias("allowed"))
