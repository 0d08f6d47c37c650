"""Author graph: interaction edges and weighted PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.functions.ids import canonical_id
from plover.runtime import discard, materialize

JUMP = 0.1
STOP = 0.001
#: What an interaction is worth.
W_QUOTE, W_REPOST, W_REPLY, W_MENTION = 3.0, 2.0, 1.5, 1.0


def interaction_edges(posts: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """src, dst, w: who quotes, reposts, answers and mentions whom. posts: author_id, post_id, quoted_id, retweet_of_id,
    reply_to_id; mentions: src, dst. Own posts and unknown targets don't count; popular targets combine before the shuffle."""
    kinds = (("quoted_id", W_QUOTE), ("retweet_of_id", W_REPOST), ("reply_to_id", W_REPLY))
    links = F.array(*[F.struct(F.col(c).alias("target"), F.lit(w).alias("w")) for c, w in kinds])
    out = posts.select(F.col("author_id").alias("src"), F.explode(links).alias("l")).select("src", "l.target", "l.w").filter("src IS NOT NULL AND target IS NOT NULL")
    out = out.groupBy("src", "target").agg(F.sum("w").alias("w"))
    owners = posts.select(F.col("post_id").alias("target"), F.col("author_id").alias("dst")).filter("dst IS NOT NULL")
    edges = out.join(owners, "target").select("src", "dst", "w")
    if mentions is not None:
        edges = edges.unionByName(mentions.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", F.lit(W_MENTION).alias("w")))
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def pagerank(edges: DataFrame, iterations: int = 20, jump: float = JUMP, stop: float = STOP) -> DataFrame:
    """node, rank. Rank of nodes without outgoing links is spread over all; stops early once the L1 change is below ``stop``.

    edges: src, dst, w (positive). One pass over links and ranks a round: contributions and what dangling nodes lose meet in
    one aggregate (combined before the shuffle, so a popular target is no hot key), and a round's loss and change come back
    as two numbers summed from the table it writes, which also cuts lineage.
    """
    edges = edges.filter("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    links = materialize(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "links")
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = materialize(nodes.join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("total").isNull().alias("dangling")), "nodes")
    n, loose = known.agg(F.count(F.lit(1)), F.count_if("dangling")).first()
    if not n:
        return known.select("node", F.lit(0.0).alias("rank"))
    ranks, lost = known.withColumn("rank", F.lit(1.0 / n)), loose / n
    for _ in range(iterations):
        given = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").select(F.col("dst").alias("node"), (F.col("rank") * F.col("share")).alias("got"))
        both = ranks.select("node", "dangling", "rank", F.lit(0.0).alias("got")).unionByName(given.select("node", F.lit(None).cast("boolean").alias("dangling"), F.lit(0.0).alias("rank"), "got"))
        summed = both.groupBy("node").agg(F.max("dangling").alias("dangling"), F.sum("rank").alias("old"), F.sum("got").alias("got"))
        new = F.lit(jump / n) + F.lit(1 - jump) * (F.col("got") + F.lit(lost / n))
        before, ranks = ranks, materialize(summed.select("node", "dangling", new.alias("rank"), F.abs(new - F.col("old")).alias("moved")), "ranks")
        discard(before)
        lost, moved = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)), F.sum("moved")).first()
        if moved < stop:
            break
    return ranks.select("node", "rank")


def authority(ranks: DataFrame, followers: DataFrame) -> DataFrame:
    """node, authority: rank times the clamped follower ratio (1 where unknown). followers: node, follower_count, following_count."""
    ratio = F.least(F.greatest(F.col("follower_count") / F.greatest(F.col("following_count"), F.lit(1)), F.lit(0.1)), F.lit(1.0))
    return ranks.join(followers, "node", "left").select("node", (F.col("rank") * F.coalesce(ratio, F.lit(1.0))).alias("authority"))


def mention_edges(rows: DataFrame, authors: DataFrame) -> DataFrame:
    """src, dst of mentions. rows: author_id, mentions (array of handles); authors: author_id, handle (of several ids the least)."""
    ids = authors.filter("handle IS NOT NULL").groupBy("handle").agg(F.min("author_id").alias("dst"))
    named = rows.select(canonical_id("author_id").alias("src"), F.explode("mentions").alias("m")).select("src", F.lower("m").alias("handle"))
    return named.join(ids, "handle").select("src", "dst")
