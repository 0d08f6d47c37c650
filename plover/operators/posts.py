"""The posts table of the engine, from ingested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.functions.ids import canonical_id
from plover.operators import timestamps
from plover.operators.ingest import gate_reason
from plover.runtime import materialize, spread

#: 2025-01-01, the start of the static recency term; days it grows, and how many days are one point.
RECENCY_EPOCH_MS = 1735689600000
RECENCY_CAP_DAYS = 730
RECENCY_DAYS_PER_POINT = 30
SCORE_CAP = 42.0
BUCKETS = 255
#: Weights of likes, replies, reposts and quotes.
W_LIKE, W_REPLY, W_REPOST, W_QUOTE = 1, 2, 3, 4
BOOST = 0.5
COUNTS = ("likes", "replies", "retweets", "quotes")
DAY_MS = 86400000


EPOCH_MS = r"\A[0-9]{13}\z"


def with_created(ingress: DataFrame, feeds: DataFrame) -> DataFrame:
    """``ingress`` plus created_ms, the instant of ``created_at`` (null where it names none), by the clock and date order of
    the row's feed (feed_id, zone_name, date_order). Most values are epoch milliseconds already; only the others are read."""
    at = F.col("created_at").try_cast("long")
    plain = F.coalesce(F.col("created_at").rlike(EPOCH_MS) & at.between(timestamps.FIRST_MS, timestamps.LAST_MS), F.lit(False))
    clocks = feeds.select("feed_id", F.col("zone_name").alias("_zone"), F.col("date_order").alias("_order")).dropDuplicates(["feed_id"])
    mixed = timestamps.normalise(ingress.filter(~plain).join(clocks, "feed_id", "left"), "created_at", "feed_id", "_zone", "_order")
    real = F.when(F.col("utc_ms").between(timestamps.FIRST_MS, timestamps.LAST_MS), F.col("utc_ms")).alias("created_ms")
    read = materialize(mixed.select(*ingress.columns, real), "timed")  # what follows reads it more than once
    return ingress.filter(plain).select("*", at.alias("created_ms")).unionByName(read)


def posts_from_ingress(timed: DataFrame, now_ms: int) -> DataFrame:
    """One row per post id: its first record that passes the gates (text, possible times). Ids in canonical spelling,
    missing counts as 0. ``timed``: the columns of ``with_created``."""
    columns = ["ingress_seq", "author_id", "text", "created_ms", "received_at", "metrics", "metrics_at", "media", "lang", "quoted_tweet_id", "retweet_of_tweet_id", "in_reply_to_tweet_id"]
    fit = gate_reason("text", ["created_ms", "metrics_at"], now_ms).isNull()
    keyed = timed.withColumn("post_id", canonical_id("id")).filter(F.col("post_id").isNotNull() & fit).select("post_id", *columns)
    keyed = keyed.repartition(spread(timed.sparkSession), "post_id", "ingress_seq")  # by row: a post may hold any share of them
    first = keyed.groupBy("post_id").agg(F.min("ingress_seq").alias("ingress_seq"))
    count = lambda name: F.coalesce(F.col(f"metrics.{name}"), F.lit(0)).alias(name)
    kept = keyed.join(first, ["post_id", "ingress_seq"], "left_semi")
    return kept.select(
        "post_id",
        "ingress_seq",
        canonical_id("author_id").alias("author_id"),
        "text",
        "created_ms",
        F.unix_millis("received_at").alias("received_ms"),
        count("likes"),
        count("replies"),
        count("retweets"),
        count("quotes"),
        "metrics_at",
        F.coalesce(F.get("media", F.lit(0))["type"], F.lit("none")).alias("media_type"),
        F.lower("lang").alias("lang"),
        canonical_id("quoted_tweet_id").alias("quoted_id"),
        canonical_id("retweet_of_tweet_id").alias("retweet_of_id"),
        canonical_id("in_reply_to_tweet_id").alias("reply_to_id"),
    )


def engagement(boost: Column | None = None) -> Column:
    counts = W_LIKE * F.col("likes") + W_REPLY * F.col("replies") + W_REPOST * F.col("retweets") + W_QUOTE * F.col("quotes")
    return F.log1p(counts if boost is None else counts + F.greatest(boost, F.lit(0.0)))


def static_recency() -> Column:
    days = (F.col("created_ms") - F.lit(RECENCY_EPOCH_MS)) / DAY_MS
    return F.greatest(F.lit(0.0), F.least(days, F.lit(float(RECENCY_CAP_DAYS)))) / RECENCY_DAYS_PER_POINT


def score_bucket(score: Column) -> Column:
    held = F.least(F.greatest(score, F.lit(0.0)), F.lit(SCORE_CAP))
    return F.floor(BUCKETS * F.log1p(held) / F.log1p(F.lit(SCORE_CAP))).cast("int")


def propagated_boosts(posts: DataFrame) -> DataFrame:
    """post_id, boost: half of the engagement of each post that quotes or reposts it (one hop); hot targets combine before the shuffle."""
    edges = posts.select(F.explode(F.array("quoted_id", "retweet_of_id")).alias("post_id"), engagement().alias("e")).filter(F.col("post_id").isNotNull())
    return edges.groupBy("post_id").agg((F.sum("e") * BOOST).alias("boost"))


def static_scores(posts: DataFrame) -> DataFrame:
    """post_id, engagement, boost, recency, static_score, bucket."""
    boosts = propagated_boosts(posts)
    scored = posts.join(boosts, "post_id", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    out = scored.select("post_id", engagement().alias("engagement"), "boost", static_recency().alias("recency"))
    total = F.col("engagement") + F.col("boost") + F.col("recency")
    return out.withColumn("static_score", total).withColumn("bucket", score_bucket(total))


#: Ages at which a young post's metrics are read again, in hours.
RECRAWL_HOURS = (1, 6, 24, 48)


def recrawl_due(posts: DataFrame, now_ms: int) -> DataFrame:
    """post_id, due_ms of posts whose metrics are older than the last age they should have been read again at."""
    age = [F.when(F.col("created_ms") + h * 3600000 <= now_ms, F.col("created_ms") + h * 3600000) for h in RECRAWL_HOURS]
    due = F.greatest(*age)
    young = F.col("created_ms") > now_ms - (RECRAWL_HOURS[-1] + 24) * 3600000
    return posts.filter(young).select("post_id", due.alias("due_ms"), "metrics_at").filter(F.coalesce(F.col("metrics_at") < F.col("due_ms"), F.col("due_ms").isNotNull())).select("post_id", "due_ms")


def sample_posts(posts: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` posts drawn by a seed: those whose seeded hash is lowest, the same ones whatever the order or layout of the rows."""
    return posts.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("post_id"))), "post_id").limit(n)
