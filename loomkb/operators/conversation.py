"""Compaction of conversations (thread_id, seq, role, content) stage by stage, as windows over each thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate

#: Recent messages left alone, result and blanking lengths, ratios at which stages start.
RECENT, RESULT_BYTES, BLANK_BYTES, SNIP_AT, DEDUP_AT, AUTO_AT = 10, 2000, 200, 0.50, 0.70, 0.85
BLANKED, REPEATED = "[old tool result content cleared]", "[duplicate tool result removed]"
CUT = "\n...[tool result budget 截断]"


def token_ratio(messages: DataFrame, most: int) -> DataFrame:
    """(thread_id, tokens, ratio) against a budget."""
    own = messages.groupBy("thread_id").agg(F.sum(token_estimate(F.col("content"))).alias("tokens"))
    return own.withColumn("ratio", F.col("tokens") / F.lit(float(most)))


def with_zones(messages: DataFrame, recent: int = RECENT) -> DataFrame:
    """``zone``: head (leading system messages), tail (the last ``recent``) or middle."""
    order = Window.partitionBy("thread_id").orderBy("seq")
    back = Window.partitionBy("thread_id").orderBy(F.desc("seq"))
    spoken = F.max((F.col("role") != "system").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = messages.withColumn("_s", spoken).withColumn("_b", F.row_number().over(back))
    return rows.withColumn("zone", F.when(F.col("_s") == 0, "head").when(F.col("_b") <= recent, "tail").otherwise("middle")).drop("_s", "_b")


def cap_results(messages: DataFrame, tool_role: str = "tool", most: int = RESULT_BYTES) -> DataFrame:
    """Tool results of over ``most`` bytes are cut to as many whole characters as lie in them, and say so."""
    long = (F.col("role") == tool_role) & (F.octet_length("content") > most)
    head = F.substring(F.encode("content", "UTF-8"), 1, most)
    whole = F.regexp_replace(F.make_valid_utf8(head.cast("string")), "\ufffd$", "")  # without what is left of a cut character
    return messages.withColumn("content", F.when(long, F.concat(whole, F.lit(CUT))).otherwise(F.col("content")))


def blank_old_results(messages: DataFrame, compactable: Column, recent: int = RECENT, least: int = BLANK_BYTES) -> DataFrame:
    """Compactable results in the middle of over ``least`` bytes are blanked."""
    rows = with_zones(messages, recent)
    old = (F.col("zone") == "middle") & compactable & (F.octet_length("content") > least)
    return rows.withColumn("content", F.when(old, F.lit(BLANKED)).otherwise(F.col("content"))).drop("zone")


def snip(messages: DataFrame, most: int, recent: int = RECENT, at: float = SNIP_AT) -> DataFrame:
    """The oldest third of the middle goes in threads whose token ratio has reached ``at``."""
    own = Window.partitionBy("thread_id")
    rows = with_zones(messages, recent).withColumn("_ratio", F.sum(token_estimate(F.col("content"))).over(own) / F.lit(float(most)))
    rows = rows.withColumn("_m", F.sum((F.col("zone") == "middle").cast("int")).over(own))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("thread_id", "zone").orderBy("seq")))
    gone = (F.col("_ratio") >= at) & (F.col("zone") == "middle") & (F.col("_i") <= F.floor(F.col("_m") / 3))
    return rows.where(~gone).drop("zone", "_ratio", "_m", "_i")


def dedup_results(messages: DataFrame, tool_role: str = "tool") -> DataFrame:
    """Of equal tool results in a thread the first keeps its content."""
    same = Window.partitionBy("thread_id", "role", F.sha2("content", 256)).orderBy("seq")
    again = (F.col("role") == tool_role) & (F.row_number().over(same) > 1)
    return messages.withColumn("_again", again).withColumn("content", F.when(F.col("_again"), F.lit(REPEATED)).otherwise(F.col("content"))).drop("_again")


def merge_adjacent(messages: DataFrame, separator: str = "") -> DataFrame:
    """Neighbours of one role become one message (gaps and islands): first seq, number and joined content."""
    order = Window.partitionBy("thread_id").orderBy("seq")
    new = F.coalesce((F.col("role") != F.lag("role").over(order)).cast("int"), F.lit(1))
    rows = messages.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda s: s["content"])
    out = rows.groupBy("thread_id", "_island", "role").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), F.array_join(parts, separator).alias("content"))
    return out.drop("_island")


def model_input(messages: DataFrame) -> DataFrame:
    """(thread_id, prompt): non-empty messages as role: content lines in order."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("content"))
    rows = messages.where("content <> ''").select("thread_id", F.struct("seq", line.alias("line")).alias("s"))
    return rows.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("prompt"))


def replay(events: DataFrame, since: int, capacity: int = 1024) -> DataFrame:
    """Events of each run from ``since`` on, as far as its ring of the last ``capacity`` still holds them."""
    last = events.groupBy("run_id").agg(F.max("seq").alias("_last"))
    return events.join(last, "run_id").where(F.col("seq") >= F.greatest(F.lit(since), F.col("_last") - (capacity - 1))).drop("_last")


def extract(contents: Column, chars: int = 80, most: int = 20) -> Column:
    """An extractive summary: the openings of the first messages."""
    return F.array_join(F.transform(F.slice(contents, 1, most), lambda c: F.left(c, F.lit(chars))), "\n")


def autocompact(messages: DataFrame, most: int, recent: int = RECENT, at: float = AUTO_AT, summarise=extract) -> DataFrame:
    """The middle of threads whose token ratio has passed ``at`` becomes one summary message at its first seq."""
    own = Window.partitionBy("thread_id")
    rows = with_zones(messages, recent).withColumn("_ratio", F.sum(token_estimate(F.col("content"))).over(own) / F.lit(float(most)))
    goes = (F.col("_ratio") > at) & (F.col("zone") == "middle")
    kept = rows.where(~goes).select("thread_id", "seq", "role", "content")
    middle = rows.where(goes).groupBy("thread_id").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("m"))
    summary = F.concat(F.lit("[summary of earlier messages]\n"), summarise(F.transform("m", lambda s: s["content"])))
    return kept.unionByName(middle.select("thread_id", "seq", F.lit("system").alias("role"), summary.alias("content")))


def compact(messages: DataFrame, most: int, compactable: Column, *, tool_role: str = "tool", recent: int = RECENT, result_bytes: int | None = RESULT_BYTES, summarise=extract) -> DataFrame:
    """All stages in order, each by its thread's token ratio at that point.

    Results are capped (None: whole); the oldest third of the middle goes from SNIP_AT on; old
    results are blanked; beyond DEDUP_AT repeated results are; beyond AUTO_AT
    the middle becomes a summary.
    """
    capped = messages if result_bytes is None else cap_results(messages, tool_role, result_bytes)
    rows = blank_old_results(snip(capped, most, recent), compactable, recent)
    ratio = F.sum(token_estimate(F.col("content"))).over(Window.partitionBy("thread_id")) / F.lit(float(most))
    rows = rows.withColumn("_full", ratio > DEDUP_AT).withColumn("_before", F.col("content"))
    rows = dedup_results(rows, tool_role)
    rows = rows.withColumn("content", F.when(F.col("_full"), F.col("content")).otherwise(F.col("_before"))).drop("_full", "_before")
    return autocompact(rows, most, recent, summarise=summarise)


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """(message_id, index, name, arguments) of streamed tool-call pieces (message_id, index, seq, name, arguments)."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "arguments")))
    out = deltas.groupBy("message_id", "index").agg(F.max("name").alias("name"), parts.alias("p"))
    return out.select("message_id", "index", "name", F.array_join(F.transform("p", lambda s: F.coalesce(s["arguments"], F.lit(""))), "").alias("arguments"))


def paired_calls(parts: DataFrame) -> DataFrame:
    """Tool calls with their results by id; calls without one have a null result."""
    calls = parts.where("type = 'tool_call'").select("run_id", "id", F.col("content").alias("call"))
    results = parts.where("type = 'tool_result'").select("run_id", "id", F.col("content").alias("result"))
    return calls.join(results, ["run_id", "id"], "left")
