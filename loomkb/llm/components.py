"""Connected components by alternating star contraction, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 64


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node.

    Each round sends every node's larger neighbours, then its smaller ones, to
    the smallest in reach (large star, small star). Rounds grow with the
    logarithm of a component's diameter. Minima combine before the shuffle and
    a hub's edges go through a join that Spark can split, so no task gathers a
    component. Rounds are written to the shared folder. Null ends and loops
    are no edges; an empty input gives no rows.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, last = scratch.write(edges, f"{name}-0"), None
    for k in range(1, MAX_ROUNDS + 1):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hooked.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.write(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = _fingerprint(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("star contraction did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
