"""Author snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.functions.ids import canonical_id


def handle(column: str) -> Column:
    """One leading @ off, lower case."""
    return F.lower(F.regexp_replace(F.trim(column), "^@", ""))


def latest_authors(authors: DataFrame) -> DataFrame:
    """One row per author id: the latest snapshot, of equally late ones the first. A max over a struct: no window, no sort of a hot author."""
    keyed = authors.withColumn("author_id", canonical_id("id")).filter(F.col("author_id").isNotNull())
    order = F.struct(F.coalesce(F.unix_micros("received_at"), F.lit(-(1 << 62))).alias("t"), (-F.col("author_seq")).alias("s"))
    kept = keyed.groupBy("author_id").agg(F.max_by(F.struct(handle("handle").alias("handle"), "display_name", "follower_count", "following_count", "verified", "created_at", "received_at"), order).alias("a"))
    return kept.select("author_id", "a.*")


def upsert_authors(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Stored and arriving authors (author_id, handle, follower_count, stub, authority) merged.

    A stub never replaces a real record; a real one keeps its computed authority; a stub that becomes real starts with
    ln(1 + followers). ``action``: inserted, promoted, updated or kept.
    """
    old = stored.select("author_id", *[F.col(c).alias(f"o_{c}") for c in ("handle", "follower_count", "stub", "authority")])
    new = arriving.select("author_id", *[F.col(c).alias(f"n_{c}") for c in ("handle", "follower_count", "stub")])
    j = old.join(new, "author_id", "full")
    day_one = F.when(F.col("n_stub"), F.lit(0.0)).otherwise(F.log1p(F.coalesce(F.col("n_follower_count"), F.lit(0)).cast("double")))
    action = (
        F.when(F.col("o_stub").isNull(), "inserted").when(F.col("n_stub").isNull() | F.col("n_stub"), "kept").when(F.col("o_stub"), "promoted").otherwise("updated")
    )
    j = j.withColumn("action", action)
    take = lambda c: F.when(F.col("action") == "kept", F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c)
    authority = F.when(F.col("action").isin("inserted", "promoted"), day_one).otherwise(F.col("o_authority"))
    return j.select("author_id", take("handle"), take("follower_count"), take("stub"), authority.alias("authority"), "action")


def stub_authors(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """author_id, stub of known authors and of those only posts speak of (placeholders)."""
    missing = posts.filter(F.col("author_id").isNotNull()).select("author_id").distinct().join(authors.select("author_id"), "author_id", "left_anti")
    return authors.select("author_id", F.lit(False).alias("stub")).unionByName(missing.withColumn("stub", F.lit(True)))
