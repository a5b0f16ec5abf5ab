"""Memory entries (scope, session_id, key, description, body, disabled, updated_at) as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest_wins


def recall(entries: DataFrame, asked: str, scope: str, limit: int, session_id: str | None = None) -> DataFrame:
    """Enabled entries that hold the text, 1.0 in their body and 0.5 in their description, best first."""
    rows = entries.where((F.col("scope") == scope) & ~F.coalesce("disabled", F.lit(False)))
    if session_id is not None:
        rows = rows.where(F.col("session_id") == session_id)
    needle = F.lower(F.lit(asked))
    score = F.when(F.contains(F.lower("body"), needle), 1.0).when(F.contains(F.lower("description"), needle), 0.5)
    return rows.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), "key").limit(limit)


def remember(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with the new ones, the latest of each scope, session and key."""
    return latest_wins(entries.unionByName(new, allowMissingColumns=True), ["scope", "session_id", "key"], "updated_at")


def index_page(entries: DataFrame, most_lines: int = 200) -> DataFrame:
    """(scope, page): a line for each enabled entry in key order, as many as fit below the two lines of the head."""
    own = Window.partitionBy("scope").orderBy("key")
    rows = entries.where(~F.coalesce("disabled", F.lit(False))).withColumn("at", F.row_number().over(own)).where(F.col("at") <= most_lines - 2)
    line = F.concat(F.lit("- "), "key", F.lit(": "), F.coalesce("description", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda s: s["line"])
    return rows.groupBy("scope").agg(F.concat(F.lit("# Memory\n\n"), F.array_join(lines, "\n")).alias("page"))


def retained(files: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` files by name; what is left out goes."""
    return files.orderBy(F.desc("name")).limit(most)


def revoked(tokens: DataFrame, blacklist: DataFrame, now) -> DataFrame:
    """Tokens that no unexpired blacklist row names."""
    return tokens.join(blacklist.where(F.col("expires_at") > now).select("token"), "token", "left_anti")
