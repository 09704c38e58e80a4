"""Connected components of a table of links, by alternating star contractions (joins and grouped minima only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest node around it: those above the node, or (small star) those below and itself."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if larger_only:
        both = both.union(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    low = both.groupBy("n").agg(F.min("m").alias("low")).withColumn("low", F.least("n", "low"))
    joined = both.join(low, "n")
    if larger_only:
        return joined.where(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("low").alias("v"))
    return joined.where(F.col("m") != F.col("low")).select(F.col("m").alias("u"), F.col("low").alias("v")).union(low.select(F.col("n").alias("u"), F.col("low").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node of the component.

    ``edges``: columns u, v of one orderable type.  Each round is written to the shared folder, and a checksum of the
    links tells when nothing changes.  Links of a hub are spread by partial aggregation and skew-split joins."""
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, "links")
    seen = None
    for _ in range(max_rounds):
        e = materialise(_star(_star(e, True).distinct(), False).distinct(), "links")
        now = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(now) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
        seen = tuple(now)
    raise RuntimeError(f"the links did not settle in {max_rounds} rounds")
