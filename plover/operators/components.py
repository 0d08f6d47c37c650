"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step replaces links by links to the smallest known neighbour. Minima are aggregates (combined before the shuffle)
joined back to the links, so no neighbourhood is ever gathered in one task; AQE splits a hot node's side of the join.
Every round is written to the shared folder, which cuts lineage and survives the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.runtime import discard, materialize


def _stars(edges: DataFrame) -> bool:
    """True if every source has one target and no target is itself a source."""
    twice = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(1).alias("x"))
    chained = edges.select(F.col("dst").alias("src")).join(edges.select("src"), "src", "left_semi").select(F.lit(1).alias("x"))
    return not twice.unionByName(chained).take(1)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
    return both.join(least, "src").filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").filter(F.col("dst") != F.col("m")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component for each node of ``edges`` (src, dst: any orderable type); the component is its smallest node.

    Loops and repeated links are allowed; rows with a null end are left out.
    """
    links = (
        edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    links = materialize(links, "links")
    for _ in range(max_rounds):
        if _stars(links):
            break
        before, links = links, materialize(_small_star(_large_star(links)), "links")
        discard(before)
    else:
        raise RuntimeError(f"connected_components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("dst").alias("node")).distinct()
    return links.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
