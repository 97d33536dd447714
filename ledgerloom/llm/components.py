"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.shared import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or other) neighbours on the smallest node around it. links: u > v."""
    sides = links if not large else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # the minimum is summed up before the shuffle, so a hub with many neighbours costs a row per task
    least = materialize(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    met = sides.join(least, "u")
    hung = met.filter("v > u") if large else met
    out = hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node that has a link to another one.

    links may hold pairs in either order, repeats and links of a node to itself; a null end is no
    link. Each round is two star steps; links stay in the cluster, and only their number and a
    checksum reach the driver. Every round is a table in the shared folder, so a lost executor
    repeats at most one step. No links give an empty table.
    """
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null and u != v").distinct()
    now, seen = materialize(now, "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        now = materialize(_star(materialize(_star(now, True), "large"), False), "small")
