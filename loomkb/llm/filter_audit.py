"""How filters interact: Walsh-Hadamard sums of failure masks, all orders, and Shapley shares."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: White space that ends a word.
BLANK = r"[\x20\x09-\x0D]+"


def failures() -> dict[str, Column]:
    """The conditions under which a (non-null) text fails the filters that see it alone.

    A: under 200 words; B: distinct words under half of them; C: more than 2 % of
    the characters are A-Z; D: any of #$%&*|. They read the columns ``words`` and ``text``.
    """
    n, distinct, text = F.size("words"), F.size(F.array_distinct("words")), F.col("text")
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def words(text: Column) -> Column:
    """All words of a text, in order."""
    return F.array_remove(F.split(text, BLANK), "")


def repeats(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (with ``digest``) and whether a row with a smaller id has the same digest.

    Digests meet in one aggregation with partial minima; only those that two ids
    share go back to the rows, in a join whose hot keys Spark can split.
    """
    firsts = rows.groupBy("digest").agg(F.min(id_col).alias("least"), F.max(id_col).alias("most")).where("least < most").select("digest", "least")
    return rows.join(firsts, "digest", "left").withColumn("again", F.coalesce(F.col(id_col) > F.col("least"), F.lit(False))).drop("least")


def parity(mask: Column, subset: int) -> Column:
    """1 or -1: whether the mask fails evenly or oddly many of the subset's filters."""
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(F.lit(subset))) % 2)


def transformed(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """For each key, the 2^n sums of the parities of its rows' masks, as an array in the order of the subsets."""
    sums = [F.sum(parity(F.col("mask"), s)).cast("long").alias(f"w{s}") for s in range(1 << n)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"w{s}" for s in range(1 << n)]).alias("w"))


def inverted(w: Column, n: int) -> Column:
    """How many rows have each mask, from the sums of parities: exactly the inverse transform, divided by 2^n."""
    subsets = F.sequence(F.lit(0), F.lit((1 << n) - 1))

    def cell(m: Column) -> Column:
        signed = lambda s: F.element_at(w, s + 1) * (1 - 2 * (F.bit_count(s.bitwiseAND(m)) % 2))
        return F.shiftright(F.aggregate(subsets, F.lit(0).cast("long"), lambda total, s: total + signed(s)), n)

    return F.transform(subsets, cell)


def over(cells: Column, keep) -> Column:
    """The sum of the cells whose mask (0-based) ``keep`` accepts."""
    picked = F.transform(cells, lambda c, m: F.when(keep(m), c).otherwise(F.lit(0).cast("long")))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, b: a + b)


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For each part, each order of the five filters and each step: what is kept, removed, redundant, unique and lost.

    Each document has one mask of the filters A to E that it fails (E: its text
    is that of a smaller id anywhere in the table). For each part and label the
    32 signed parity sums are aggregated, which exactly give the number of
    documents of each mask back; orders and shares are evaluated on these. A
    filter's Shapley share is, over its failing documents, 120 divided by how
    many filters each fails: in so many orders it is the first of them.

    Null texts are empty; null parts are the empty string; a document is good or
    toxic if any of its labels says so. Rows with a null id never repeat another
    row. Repeated rows count each, and do not repeat each other. No rows in,
    none out. Other columns are ignored.
    """
    scratch = Scratch(spark, "audit")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures().values())]
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    rows = scratch.write(rows, "masks")  # texts are read once
    rows = repeats(rows).select("doc_id", "part", (F.col("mask") + F.when(F.col("again"), 16).otherwise(0)).alias("mask"))
    marks = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good OR toxic")
    no = F.lit(False)
    rows = rows.join(marks, "doc_id", "left").select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "mask")
    cells = transformed(rows, 5, "part", "good", "toxic").select("part", "good", "toxic", F.posexplode(inverted(F.col("w"), 5)).alias("cell", "n"))
    of = lambda keep: F.sum(F.when(keep, F.col("n")).otherwise(0))
    by_mask = cells.groupBy("part", "cell").agg(F.sum("n").alias("all"), of(F.col("good")).alias("good"), of(F.col("toxic")).alias("toxic"))
    in_order = F.sort_array(F.collect_list(F.struct("cell", "all", "good", "toxic")))  # 32 of a part
    by_part = by_mask.groupBy("part").agg(in_order.alias("c"))
    by_part = by_part.select("part", *[F.col(f"c.{name}").alias(f"c_{name}") for name in ("all", "good", "toxic")])

    letters = "ABCDE"
    steps = [("".join(o), k + 1, sum(1 << letters.index(x) for x in o[:k]), 1 << letters.index(o[k])) for o in permutations(letters) for k in range(5)]
    plan = spark.createDataFrame(steps, "filter_order string, step int, before int, bit int")  # 600 rows, whatever the table
    combos = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("bit")) for b, f in sorted({x[2:] for x in steps})])
    each = by_part.select("*", F.explode(combos).alias("x")).select("*", "x.before", "x.bit")
    before, bit = F.col("before"), F.col("bit")
    fails, first = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) == 0
    # 60, 30, 20, 15 or 12 times two: 120 over the number of failed filters
    share = F.transform("c_all", lambda c, m: F.when(fails(m), c * (F.lit(120) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    each = each.select(
        "part",
        "before",
        "bit",
        over(F.col("c_all"), lambda m: first(m) & ~fails(m)).alias("kept"),
        over(F.col("c_all"), lambda m: first(m) & fails(m)).alias("removed"),
        over(F.col("c_all"), lambda m: ~first(m) & fails(m)).alias("redundant"),
        over(F.col("c_all"), lambda m: m == bit).alias("unique_fails"),
        over(F.col("c_good"), lambda m: first(m) & fails(m)).alias("good_lost"),
        over(F.col("c_toxic"), lambda m: first(m) & fails(m)).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )
    out = each.join(F.broadcast(plan), ["before", "bit"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
