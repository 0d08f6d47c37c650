"""Running sums and maxima within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.runtime import materialize


def running(rows: DataFrame, group: list[str], order: list[str], amounts: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` plus, per name in ``amounts``, the sum or max (its kind) of the column over the group's rows that come earlier
    in ``order``: 0 or null for the first.

    ``order`` should be unique within the group; rows that tie have an arbitrary but fixed order. Rows are range-
    partitioned by group and order and written once, so partition bounds can't change between the two uses; running values
    are taken inside a partition, and partition totals (a row per group and partition it touches) carry them on.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumns({f"_of_{name}": of for name, (_, of) in amounts.items()})
    ranged = marked.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged")
    fold = lambda kind, c: F.sum(c) if kind == "sum" else F.max(c)
    inside = Window.partitionBy("_part", *group).orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part", *group).agg(*[fold(kind, f"_of_{name}").alias(f"_total_{name}") for name, (kind, _) in amounts.items()])
    across = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[fold(kind, f"_total_{name}").over(across).alias(f"_carried_{name}") for name, (kind, _) in amounts.items()]
    )
    local = ranged.withColumns({f"_inside_{name}": fold(kind, f"_of_{name}").over(inside) for name, (kind, _) in amounts.items()})
    on = [local["_part"] == carried["_p"], *[local[g].eqNullSafe(carried[f"_g{i}"]) for i, g in enumerate(group)]]

    def both(name: str, kind: str) -> Column:
        a, b = F.col(f"_inside_{name}"), F.col(f"_carried_{name}")
        return (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if kind == "sum" else F.greatest(a, b)).alias(name)

    return local.join(carried, on).select(*rows.columns, *[both(name, kind) for name, (kind, _) in amounts.items()])


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], amount: str) -> DataFrame:
    """``rows`` plus ``before``: the sum of ``amount`` over the group's rows that come earlier in ``order`` (as ``running``)."""
    return running(rows, group, order, {"before": ("sum", F.col(amount))})
