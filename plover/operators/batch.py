"""Searches as relations: any number of queries of a batch run through one level, or are ranked, in one plan.

What a query asks is data (columns of ``SPEC``), not plan shape, so the plan's size doesn't grow with the batch. A batch
has at most ``MAX_BATCH`` queries; its specifications and found ids (at most ``index.RERANK_CAP`` a query) are small enough
to be broadcast.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plover.operators import index as I
from plover.operators import rank as R

MAX_BATCH = 1000
SPEC = (
    "qid int, sort string, intent string, union boolean, must array<string>, should array<string>, pairs array<string>, phrases array<array<string>>, phrase_words array<string>, "
    "exclude array<string>, authorId string, since long, until long, media string, minLikes long, lang string, gates array<string>, have array<string>, room int, key string, "
    "terms array<struct<term: string, idf: double>>, reads array<struct<role: string, term: string, cap: int, read: string, floor: int>>"
)


def local_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few driver-side rows as a relation that needs no Python worker."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_struct(schema)}>>")))


def _struct(schema: str) -> str:
    return ", ".join(": ".join(column.split(" ", 1)) for column in _columns(schema))


def _columns(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[start:i].strip())
            start = i + 1
    return [*parts, schema[start:].strip()]


# Expressions are SQL text here: building them call by call would take longer than running them.
_IN_TIME = "(since IS NULL OR created_ms >= since) AND (until IS NULL OR created_ms < until)"
_IN_MEDIA = "(media IS NULL OR media_type = media)"


def index_slice(postings: DataFrame, floors: dict[str, int | None]) -> DataFrame:
    """The postings of the given terms, each from its floor on (None: all), as a filter the files' statistics can use."""
    whole = [t for t, floor in floors.items() if floor is None]
    keep = F.col("term").isin(whole or [""])
    for term, floor in floors.items():
        if floor is not None:
            keep |= (F.col("term") == term) & (F.col("bucket") >= floor)
    return postings.filter(keep)


def candidates(postings: DataFrame, specs: DataFrame) -> DataFrame:
    """qid, post_id, rrf: seed of the rarest gate, union lists fused by reciprocal rank, all reads capped.

    What a read's order can push (author, time range, media) is filtered before the cap, the rest after it, on purpose: a
    capped index read would do the same.
    """
    reads = specs.selectExpr("qid", "authorId", "since", "until", "media", "inline(reads)").withColumnRenamed("term", "read_term")
    kept = (
        postings.join(F.broadcast(reads), F.expr("term = read_term"))
        .filter(
            f"CASE read WHEN 'author' THEN author_id = authorId AND {_IN_TIME} WHEN 'time' THEN {_IN_TIME} WHEN 'media' THEN media_type = media ELSE bucket >= coalesce(floor, 0) END"
        )
        .selectExpr("*", "row_number() OVER (PARTITION BY qid, role, term ORDER BY CASE WHEN read IN ('author', 'time') THEN created_ms ELSE CAST(bucket AS BIGINT) END DESC, post_id) AS rnk")
        .filter(f"rnk <= {I.SEED_CAP}")
        .filter(f"rnk <= cap AND {_IN_TIME} AND {_IN_MEDIA}")
        .selectExpr("qid", "post_id", "role", "row_number() OVER (PARTITION BY qid, role, term ORDER BY rnk) AS r")
    )
    return kept.groupBy("qid", "post_id").agg(F.expr(f"sum(CASE role WHEN 'gate' THEN 0D ELSE 1D / ({R.RRF_K} + r) END) AS rrf"))


def timelines(posts: DataFrame, specs: DataFrame) -> DataFrame:
    """qid, post_id, rrf of queries that name an author and no term: the newest posts, newest first."""
    wanted = specs.filter("size(reads) = 0 AND authorId IS NOT NULL").select("qid", "authorId", "since", "until")
    rows = posts.select("post_id", "author_id", "created_ms").join(F.broadcast(wanted), F.col("author_id") == F.col("authorId")).filter(_IN_TIME)
    newest = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("created_ms"), "post_id"))
    return rows.withColumn("n", newest).filter(F.col("n") <= I.PER_TERM_CAP).select("qid", "post_id", (-F.col("n")).cast("double").alias("rrf"))


_HAS_PHRASE = "p -> exists(sequence(1, greatest(size(tokens_all) - size(p) + 1, 1)), i -> slice(tokens_all, i, size(p)) = p)"
#: The one predicate that verifies a post (tokens_all, present, its language as posts_lang) against its query's filters, gates, words and phrases.
PREDICATE = f"""coalesce((authorId IS NULL OR author_id = authorId) AND {_IN_TIME} AND {_IN_MEDIA} AND (minLikes IS NULL OR likes >= minLikes) AND (lang IS NULL OR posts_lang = lang)
 AND size(array_except(gates, present)) = 0 AND NOT arrays_overlap(tokens_all, exclude)
 AND CASE WHEN union THEN size(should) + size(phrases) = 0 OR arrays_overlap(tokens_all, should) OR exists(phrases, {_HAS_PHRASE}) ELSE forall(phrases, {_HAS_PHRASE}) END, false)"""


def verified(posts: DataFrame, found: DataFrame, specs: DataFrame) -> DataFrame:
    """qid, post_id, place of the found posts that pass, in reading order, as many as there is ``room`` for."""
    rows = posts.withColumnRenamed("lang", "posts_lang").join(found, "post_id").join(F.broadcast(specs.drop("reads", "terms")), "qid")
    passed = rows.filter(PREDICATE).filter("NOT array_contains(have, post_id)")
    placed = passed.selectExpr("qid", "post_id", "room", "row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, post_id) AS place")
    return placed.filter(f"place <= {I.RERANK_CAP}").filter("place <= room").select("qid", "post_id", "place")


def feedback(posts: DataFrame, top: DataFrame, specs: DataFrame, most: int = 5) -> DataFrame:
    """qid, term, n: the words most of a query's top posts share, beyond its own (``terms``)."""
    rows = posts.select("post_id", "tokens").join(F.broadcast(top), "post_id").join(F.broadcast(specs.select("qid", "terms")), "qid")
    own = lambda t: F.exists("terms", lambda x: x["term"] == t)
    words = F.filter(F.array_distinct("tokens"), lambda t: (F.length(t) >= 3) & ~t.startswith("~") & ~own(t))
    counts = rows.select("qid", F.explode(words).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "term"))).filter(F.col("k") <= most)


def scored(candidates: DataFrame) -> DataFrame:
    """Candidates (posts with the columns of their query's specification, author_authority, propagated_boost, feedback_votes,
    matched_via) with relevance, coverage, fit, chain, the six signals and the score."""
    ready = candidates.selectExpr(
        "* EXCEPT (likes, replies, retweets, quotes, created_ms)",
        "likes AS like_count",
        "replies AS reply_count",
        "retweets AS retweet_count",
        "quotes AS quote_count",
        "created_ms AS created_at",
        f"aggregate(filter(terms, x -> array_contains(present, x.term)), 0D, (acc, x) -> acc + x.idf * get(tf, CAST(array_position(present, x.term) AS INT) - 1) * {R.K1 + 1}D / (get(tf, CAST(array_position(present, x.term) AS INT) - 1) + {R.K1 * (1 - R.B)}D)) AS rel",
        f"CASE WHEN CASE WHEN media IS NOT NULL THEN media_type = media ELSE intent = 'media' AND media_type <> 'none' END THEN {R.FIT_MEDIA}D ELSE 0D END"
        f" + CASE WHEN arrays_overlap(present, pairs) OR (size(must) >= 2 AND size(array_except(must, present)) = 0) OR (size(phrase_words) > 0 AND size(array_except(phrase_words, present)) = 0) THEN {R.FIT_PHRASE}D ELSE 0D END"
        f" + CASE WHEN arrays_overlap(present, should) THEN {R.FIT_SHOULD}D ELSE 0D END AS fit",
        "CASE WHEN size(must) > 0 THEN size(filter(must, t -> array_contains(present, t))) / size(must) ELSE 1D END AS cover",
        "coalesce(retweet_of_id, quoted_id, post_id) AS chain",
    )
    return R.six_signals(ready, "now_ms", by=["qid"], tau=f"CASE sort WHEN 'latest' THEN {R.TAU_LATEST_MS} ELSE {R.TAU_TOP_MS} END")


PAGE_ORDER = "CASE matched_via WHEN 'L0' THEN 0 ELSE 1 END, CASE sort WHEN 'latest' THEN CAST(created_at AS DOUBLE) ELSE cover END DESC, score DESC, post_id"
PLACE = f"row_number() OVER (PARTITION BY qid ORDER BY {PAGE_ORDER})"


def ranked(scored: DataFrame) -> DataFrame:
    """One row per query and chain, the one the order puts first (as ``rank.final_order``), with its place ``rnk``."""
    best = scored.selectExpr("*", f"row_number() OVER (PARTITION BY qid, chain ORDER BY {PAGE_ORDER}) AS _n").filter("_n = 1").drop("_n")
    return best.selectExpr("*", f"{PLACE} AS rnk")
