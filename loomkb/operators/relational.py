"""Lists, joins and counts of the back office."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ilike


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """One page in a total order: numbers below 1 are 1, sizes outside 1 .. 100 are 10."""
    number, size = max(1, number), size if 1 <= size <= 100 else 10
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def with_total(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """A page whose rows carry the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, number, size, *order).crossJoin(F.broadcast(total))  # one row


def any_contains(keyword: str, *columns: str, escaped: bool = True) -> Column:
    """A keyword in any of the columns, ignoring case; none means no filter."""
    if not keyword:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | contains_ilike(F.col(c), keyword, escaped)
    return out


def action_matches(column: Column, action: str) -> Column:
    """Equal to ``action``, or with its prefix if it ends in *."""
    return column.startswith(action[:-1]) if action.endswith("*") else column == action


def between_days(ts: Column, first: str | None, last: str | None) -> Column:
    """From the first day on and before the day after the last one."""
    out = F.lit(True)
    if first:
        out = out & (ts >= F.lit(first).cast("timestamp"))
    if last:
        out = out & (ts < F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return out


def multimap(bridge: DataFrame, names: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """(left, names): sorted names of each left key, through a bridge table."""
    return bridge.join(names, right).groupBy(left).agg(F.sort_array(F.collect_set(name)).alias("names"))


def permission_union(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, permissions): distinct permissions of all roles; malformed JSON counts as none."""
    held = F.explode(F.from_json("permissions", "array<string>"))
    rows = user_roles.join(roles, "role_id").select("user_id", held.alias("p")).where("p IS NOT NULL")
    return rows.groupBy("user_id").agg(F.sort_array(F.collect_set("p")).alias("permissions"))


def time_spine(spark: SparkSession, first: str, last: str, weekly: bool = False) -> DataFrame:
    """One row for each day or week (from its Monday) between two days."""
    unit, step = ("WEEK", "7") if weekly else ("DAY", "1")
    return spark.range(1).select(
        F.explode(F.expr(f"sequence(date_trunc('{unit}', timestamp'{first}'), date_trunc('{unit}', timestamp'{last}'), INTERVAL {step} DAY)")).alias("bucket")
    )


def counts_by_time(facts: DataFrame, ts: str, first: str, last: str, weekly: bool = False) -> DataFrame:
    bucket = F.date_trunc("WEEK" if weekly else "DAY", ts).alias("bucket")
    return facts.where(between_days(F.col(ts), first, last)).groupBy(bucket).agg(F.count("*").alias("n"))


def zero_filled_trend(spark: SparkSession, series: dict[str, tuple[DataFrame, str]], first: str, last: str, weekly: bool = False) -> DataFrame:
    """A row for each bucket with each series' count, 0 where it has none. ``series``: name -> (facts, time column)."""
    out = time_spine(spark, first, last, weekly)
    for name, (facts, ts) in series.items():
        out = out.join(counts_by_time(facts, ts, first, last, weekly).withColumnRenamed("n", name), "bucket", "left")
    return out.select(F.date_format("bucket", "yyyy-MM-dd").alias("label"), *[F.coalesce(n, F.lit(0)).alias(n) for n in series])


def counts_with_zero(owners: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Owners with the number of their facts, 0 for none."""
    counts = facts.groupBy(key).agg(F.count("*").alias("n"))
    return owners.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def missing_ids(asked: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return asked.select(key).distinct().join(there.select(key), key, "left_anti")


def catalogue(articles: DataFrame) -> DataFrame:
    """(group, page): a Markdown list of each group's titles in order."""
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("id").cast("string"), F.lit(".md)"))
    rows = articles.select("group", F.struct(F.col("title"), F.col("id"), line.alias("line")).alias("s"))
    lines = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"])
    head = F.concat(F.lit("## "), F.col("group"), F.lit("\n"))
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("body")).select("group", "n", F.concat(head, "body").alias("page"))


def ordered_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Parents with an array of their children's fields in order, empty for none."""
    row = F.struct(*order, *[f for f in fields if f not in order])
    own = children.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("children"))
    return parents.join(own, key, "left")


def tree_paths(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(id, depth, path) of all nodes below the roots (parent_id 0), siblings by sort_order and id."""
    return spark.sql(
        """WITH RECURSIVE t(id, depth, path) AS (
             SELECT id, 0, lpad(CAST(sort_order AS STRING), 4, '0') || '.' || CAST(id AS STRING) FROM {nodes} WHERE parent_id = 0
             UNION ALL
             SELECT n.id, t.depth + 1, t.path || '/' || lpad(CAST(n.sort_order AS STRING), 4, '0') || '.' || CAST(n.id AS STRING)
             FROM {nodes} n JOIN t ON n.parent_id = t.id)
           SELECT id, depth, path FROM t""",
        nodes=nodes,
    )


def unreferenced_images(files: DataFrame, articles: DataFrame) -> DataFrame:
    """Image files (name) that no article's content refers to, over all knowledge bases."""
    used = articles.select(F.explode(F.regexp_extract_all("content", F.lit(r"image/([a-f0-9]+\.\w+)"), 1)).alias("name"))
    return files.join(used.distinct(), "name", "left_anti")


def latest_wins(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at")


def replace_links(bridge: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """A bridge table in which the changed keys have the new links alone."""
    return bridge.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed.distinct())
