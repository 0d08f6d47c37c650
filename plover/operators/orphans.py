"""References to records that do not exist (problem 7).

Method: references are pre-aggregated per key and period; the few heavy keys (at most ``heavy_parts`` of them, so the
bound is proven) are checked through a broadcast of their history, all other keys through a shuffle join, and the two
results are united.

Inputs
------
references  ref_seq, ref_field, entity, key, seen_at   one row per reference
targets     entity, key, seen_at                       one row per stored record
deletions   entity, key, deleted_at                    one row per tombstone

Edge cases: null keys refer to nothing and are left out; null times never make a reference late; a tombstone without
time deletes nothing but shows that the id was known; empty tables give empty results (references without any target
are ``missing``); repeated rows of targets and deletions change nothing, repeated references are reported each.
Columns beyond those named above are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.runtime import materialize

STATES = ("deleted", "missing", "late")


def key_history(targets: DataFrame, deletions: DataFrame) -> DataFrame:
    """One row per (entity, key): first and last time a record of the key was seen, latest deletion."""
    seen = targets.select("entity", "key", F.col("seen_at"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(1).alias("stored"))
    gone = deletions.select("entity", "key", F.lit(None).cast("timestamp").alias("seen_at"), F.col("deleted_at"), F.lit(0).alias("stored"))
    return (
        seen.unionByName(gone)
        .filter(F.col("key").isNotNull())
        .groupBy("entity", "key")
        .agg(
            F.min("seen_at").alias("first_seen"),
            F.max("seen_at").alias("last_seen"),
            F.max("deleted_at").alias("deleted_at"),
            F.max("stored").alias("stored"),
        )
    )


def _key_state() -> Column:
    """The part of the state that depends on the key alone; null for keys that are there."""
    stored = F.coalesce(F.col("stored"), F.lit(0)) == 1
    gone = F.col("deleted_at").isNotNull() & (~stored | F.coalesce(F.col("deleted_at") >= F.col("last_seen"), F.lit(True)))
    return F.when(gone, "deleted").when(~stored, "missing")


def heavy_keys(references: DataFrame, heavy_parts: int = 1000) -> DataFrame:
    """Keys with more than 1 / ``heavy_parts`` of all references each: fewer than ``heavy_parts`` rows, always."""
    counts = references.groupBy("entity", "key").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") > F.lit(max(1, total // heavy_parts))).select("entity", "key")


def _with_history(refs: DataFrame, history: DataFrame, heavy: DataFrame) -> DataFrame:
    """Left join of references with the history of their keys, hot keys by broadcast, the others by shuffle."""
    on = ["entity", "key"]
    few = F.broadcast(heavy.withColumn("hot", F.lit(True)))
    marked = refs.join(few, on, "left")
    light = marked.filter(F.col("hot").isNull()).drop("hot").join(history, on, "left")
    hot_history = F.broadcast(history.join(F.broadcast(heavy), on, "left_semi"))
    hot = marked.filter("hot").drop("hot").join(hot_history, on, "left")
    return light.unionByName(hot)


def orphan_references(references: DataFrame, targets: DataFrame, deletions: DataFrame, *, heavy_parts: int = 1000) -> DataFrame:
    """Every reference whose target is deleted, missing or came later: ref_seq, ref_field, ref_state, seen_at, entity, key."""
    refs = references.select("ref_seq", "ref_field", "entity", "key", "seen_at").filter(F.col("key").isNotNull())
    found = _with_history(refs, key_history(targets, deletions), materialize(heavy_keys(refs, heavy_parts), "heavy"))
    state = F.coalesce(_key_state(), F.when(F.col("first_seen") > F.col("seen_at"), "late"))
    return found.select("ref_seq", "ref_field", state.alias("ref_state"), "seen_at", "entity", "key").filter(F.col("ref_state").isNotNull())


def orphan_report(references: DataFrame, targets: DataFrame, deletions: DataFrame, *, heavy_parts: int = 1000) -> DataFrame:
    """Orphans per reference column, period (month, UTC) and state, with the number of distinct keys.

    References are counted per key and period before any join. Only groups that straddle the first arrival of their
    target, part of which is late, go back to the rows; there are at most as many as there are targets times fields.
    """
    refs = references.select("ref_field", "entity", "key", "seen_at", F.date_format("seen_at", "yyyy-MM").alias("period")).filter(F.col("key").isNotNull())
    groups = refs.groupBy("ref_field", "entity", "key", "period").agg(
        F.count(F.lit(1)).alias("n"), F.min("seen_at").alias("from_at"), F.max("seen_at").alias("to_at")
    )
    history = key_history(targets, deletions)
    heavy = materialize(heavy_keys(refs, heavy_parts), "heavy")
    joined = _with_history(groups, history, heavy).withColumn("ref_state", _key_state())
    late = F.when(F.col("first_seen") > F.col("to_at"), F.lit("late"))
    whole = joined.withColumn("ref_state", F.coalesce("ref_state", late))
    settled = whole.filter(F.col("ref_state").isNotNull()).select("ref_field", "period", "ref_state", "entity", "key", "n")
    straddling = whole.filter(
        F.col("ref_state").isNull() & (F.col("first_seen") > F.col("from_at")) & (F.col("first_seen") <= F.col("to_at"))
    ).select("ref_field", "entity", "key", "period", "first_seen")
    on, hot = ["ref_field", "entity", "key", "period"], F.broadcast(heavy.withColumn("hot", F.lit(True)))
    few = straddling.join(hot, ["entity", "key"], "left_semi")  # at most a row per heavy key, column and month
    marked = refs.join(hot, ["entity", "key"], "left")
    light = marked.filter(F.col("hot").isNull()).join(straddling.join(hot, ["entity", "key"], "left_anti"), on)
    part = (
        light.unionByName(marked.filter("hot").join(F.broadcast(few), on))
        .filter(F.col("first_seen") > F.col("seen_at"))
        .groupBy("ref_field", "period", "entity", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ref_state", F.lit("late"))
    )
    return (
        settled.unionByName(part)
        .groupBy("ref_field", "period", "ref_state")
        .agg(F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_keys"))
    )
