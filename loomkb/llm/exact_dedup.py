"""Exact deduplication against a minimal perfect hash of historical digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct digests that one bucket's perfect hash holds on average.
BUCKET_KEYS = 20_000
#: Keys that share one displacement, on average.
GROUP_KEYS = 4


def digest(text) -> F.Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), 256))


def _parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three 64-bit numbers of each digest (an n x 4 array of its words)."""
    return keys[:, 1], keys[:, 2], keys[:, 3] | np.uint64(1)


def _slot(a: np.ndarray, b: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    return ((a + shift.astype(np.uint64) * b) >> np.uint64(11)) % np.uint64(n)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by group and the slot of each key: n keys fill the slots 0 to n - 1.

    Groups are placed from the largest to the smallest; each takes the first
    displacement under which all its keys fall on free slots. ``keys`` is an
    n x 4 array of distinct 256-bit digests.
    """
    n = len(keys)
    g, a, b = _parts(keys)
    groups = max(1, -(-n // GROUP_KEYS))
    group = (g % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(groups + 1))
    moved, taken, slots = np.zeros(groups, np.uint32), np.zeros(n, bool), np.zeros(n, np.int64)
    for k in np.argsort(-np.diff(starts), kind="stable"):
        own = order[starts[k] : starts[k + 1]]
        if not len(own):
            break
        first, width = 0, 64
        while True:
            tries = np.arange(first, first + width)
            at = _slot(a[own][None, :], b[own][None, :], tries[:, None], n).astype(np.int64)
            fits = ~taken[at].any(axis=1)
            if len(own) > 1:
                sorted_at = np.sort(at, axis=1)
                fits &= (np.diff(sorted_at, axis=1) != 0).all(axis=1)
            if fits.any():
                hit = int(np.argmax(fits))
                moved[k], slots[own] = tries[hit], at[hit]
                taken[at[hit]] = True
                break
            first, width = first + width, min(width * 2, 1 << 16)
            if first > 1 << 31:
                raise RuntimeError("no displacement found; are the digests distinct?")
    return moved, slots


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket's index: displacements, and by slot the full digest, winner and copies."""
    keys = _words(frame["digest"])
    moved, slots = perfect_hash(keys)
    back = np.empty(len(keys), np.int64)
    back[slots] = np.arange(len(keys))
    return pd.DataFrame(
        {
            "bucket": [int(frame["bucket"].iloc[0])],
            "moved": [moved.tobytes()],
            "digests": [keys[back].tobytes()],
            "winners": [frame["winner"].to_numpy(np.int64)[back].tobytes()],
            "copies": [frame["copies"].to_numpy(np.int64)[back].tobytes()],
        }
    )


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Perfect-hash index of ``history`` (digest, winner, copies), one row a bucket.

    A bucket is a remainder of the digest's first bytes, so that buckets hold about the same
    number of distinct digests whatever the rows' skew.
    """
    return (
        history.withColumn("bucket", _bucket(buckets))
        .groupBy("bucket")
        .applyInPandas(_build, "bucket long, moved binary, digests binary, winners binary, copies binary")
    )


def _bucket(buckets: int) -> F.Column:
    return F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % F.lit(buckets)


def look_up(index: pd.DataFrame, digests: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Membership, winner and historical copies of each digest; all 32 bytes are compared."""
    keys = _words(digests)
    none = np.zeros(len(keys), np.int64)
    if not len(index):
        return none.astype(bool), none, none
    row = index.iloc[0]
    moved, held = np.frombuffer(row["moved"], np.uint32), np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
    g, a, b = _parts(keys)
    at = _slot(a, b, moved[(g % np.uint64(len(moved))).astype(np.int64)], len(held)).astype(np.int64)
    found = (held[at] == keys).all(axis=1)
    return found, np.frombuffer(row["winners"], np.int64)[at], np.frombuffer(row["copies"], np.int64)[at]


def _probe(fresh: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(fresh):
        return pd.DataFrame({"digest": [], "winner": [], "copies": [], "member": []})
    found, winner, copies = look_up(index, fresh["digest"])
    return pd.DataFrame(
        {
            "digest": fresh["digest"],
            "winner": np.where(found, winner, fresh["winner"]),
            "copies": np.where(found, copies + fresh["copies"], fresh["copies"]),
            "member": found,
        }
    )


def exact_dedup(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    history_from: int | None = None,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """Every row of ``docs`` with the row that stays for its text.

    Returns (doc_id, digest, keep_id, group_size, kept). Texts are
    equal when identical after lower-casing A-Z; of equal texts the largest id
    stays. Rows with an id of at least ``history_from`` (default: the middle of
    the id range) are history: their distinct digests go into a minimal perfect
    hash whose slots hold the full digest and the winner. The other rows'
    distinct digests are looked up in it, all bytes compared; members follow
    the historical winner, nonmembers are grouped among themselves. As history
    has the larger ids, its winners are the overall ones.

    Digests are pre-aggregated before each shuffle; a text that a third of all
    rows share costs one row a task. Null texts count as empty; a null id takes
    part but never wins over an id (it stays only where every copy has a null
    id). Rows repeated with their id are all reported; the ``kept`` id is then
    kept on each. Other columns are ignored.
    """
    scratch = Scratch(spark, "exact-dedup")
    rows = scratch.write(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest")), "rows")
    if history_from is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        history_from = 0 if low is None else (low + high + 1) // 2
    old = F.coalesce(F.col("doc_id") >= F.lit(history_from), F.lit(False))
    # a null winner travels as the smallest long
    best = F.coalesce(F.max("doc_id"), F.lit(-(2**63))).alias("winner")
    groups = scratch.write(
        rows.withColumn("old", old).groupBy("digest", "old").agg(best, F.count("*").alias("copies")), "groups"
    )
    buckets = max(1, -(-groups.where("old").count() // bucket_keys))
    index = scratch.write(build_index(groups.where("old").drop("old"), buckets), "index")
    fresh = groups.where("NOT old").withColumn("bucket", _bucket(buckets))
    probed = (
        fresh.groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(_probe, "digest binary, winner long, copies long, member boolean")
    )
    probed = scratch.write(probed, "probed")
    alone = groups.where("old").join(probed.where("member").select("digest"), "digest", "left_anti")
    winners = probed.select("digest", "winner", "copies").union(alone.select("digest", "winner", "copies"))
    out = rows.join(winners, "digest")
    keep = F.when(F.col("winner") == F.lit(-(2**63)), F.lit(None)).otherwise(F.col("winner"))
    return out.select(
        "doc_id",
        "digest",
        keep.cast("long").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
    )
