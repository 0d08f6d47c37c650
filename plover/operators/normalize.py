"""From provider pages to the corpus: mapping, windows, deduplication with refresh, side outputs and counts of one run.

Every candidate (a timeline row, or a post quoted inside one, at any depth up to ``MAX_DEPTH``) has a place in the run's
order: accounts as configured, pages, rows, quotes after what quotes them. What the order decides (who was first, what was
newest before) is worked out with ``prefix.running``, so no post's repeats are gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.functions.ids import canonical_id
from plover.operators.collect import rejection_reasons
from plover.operators.csvload import REJECTION_CODES
from plover.operators.ingest import SECONDS_BELOW, dedup_with_refresh, json_kind, window_reason
from plover.runtime import materialize

MAX_DEPTH = 32
#: The provider's media types, and what each is to us.
MEDIA_TYPES = {"photo": "image", "mosaic_photo": "image", "video": "video", "gif": "gif"}
_TEXT = ("type", "id", "text", "created_at", "lang", "author.id", "author.screen_name", "author.name", "author.description", "author.avatar_url", "replying_to.screen_name", "replying_to.status")
_NUMBER = ("likes", "reposts", "quotes", "replies", "author.followers", "author.following", "author.statuses")
_OBJECT_OR_NULL = ("media", "author", "author.verification", "quote", "reposted_by", "raw_text", "replying_to")


def candidates(rows: DataFrame) -> DataFrame:
    """``rows`` (row: JSON) as candidates: origin, depth, parent_id, o. A quoted post is one if it is a status itself and the
    posts down to it are."""
    v = rows.withColumn("o", F.expr("try_parse_json(row)"))
    paths = ["$" + ".quote" * i for i in range(MAX_DEPTH + 1)]
    nested = F.array(*[F.struct(F.lit(i).alias("depth"), F.expr(f"try_variant_get(o, '{p}', 'variant')").alias("v")) for i, p in enumerate(paths)])
    held = v.withColumn("c", F.explode(F.filter(nested, lambda x: (x["depth"] == 0) | x["v"].isNotNull())))
    depth = F.col("c.depth")
    parent = F.coalesce(*[F.when(depth == i, F.expr(f"try_variant_get(o, '{paths[i - 1]}.id', 'string')")) for i in range(1, MAX_DEPTH + 1)])
    chain = F.coalesce(*[F.when(depth == i, _statuses(paths[1 : i + 1])) for i in range(1, MAX_DEPTH + 1)], F.lit(True))
    fallback = F.concat_ws("#", "raw_file", F.col("position").cast("string"))
    out = held.withColumn("parent_id", F.when(depth > 0, F.coalesce(canonical_id(parent), fallback))).filter(chain)
    return out.withColumns({"depth": depth, "origin": F.when(depth == 0, "timeline").otherwise("embedded"), "o": F.col("c.v")}).drop("c")


def _statuses(paths: list[str]) -> Column:
    return F.expr(" AND ".join(f"coalesce(try_variant_get(o, '{p}.type', 'string') = 'status', false)" for p in paths))


def _sound() -> Column:
    fits = lambda p, ok: f"coalesce({json_kind('$.' + p)} RLIKE '^({ok})', true)"
    tests = [fits(p, "STRING") for p in _TEXT] + [fits(p, "BIGINT|DECIMAL|DOUBLE") for p in _NUMBER] + [fits(p, "OBJECT|VOID") for p in _OBJECT_OR_NULL]
    tests += [fits("media.all", "ARRAY|VOID"), fits("raw_text.facets", "ARRAY"), fits("author.verification.verified", "BOOLEAN")]
    return F.expr(" AND ".join(tests))


def map_candidates(found: DataFrame) -> DataFrame:
    """Posts and authors of candidates with ``reasons``: every rule a candidate breaks (empty: accepted), in the codes' order."""
    text = lambda *p: F.expr("coalesce(" + ", ".join(f"try_variant_get(o, '$.{x}', 'string')" for x in p) + ")")
    filled = lambda c: F.when(F.trim(c) != "", c)
    count = lambda p: F.expr(f"CASE WHEN try_variant_get(o, '$.{p}', 'double') >= 0 THEN CAST(try_variant_get(o, '$.{p}', 'double') AS BIGINT) END")
    raw = F.expr("try_variant_get(o, '$.created_timestamp', 'double')")
    stamp = F.when(raw > 0, F.round(F.when(raw >= SECONDS_BELOW, raw).otherwise(raw * 1000)).cast("long"))
    media = F.expr("try_variant_get(o, '$.media.all', 'array<struct<type: string, url: string>>')")
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    typed = F.transform(media, lambda m: F.struct(F.try_element_at(kinds, m["type"]).alias("type"), m["url"].alias("url")))
    kept = F.aggregate(
        typed, F.array().cast("array<struct<type: string, url: string>>"), lambda acc, m: F.when(F.exists(acc, lambda x: x["url"] == m["url"]), acc).otherwise(F.array_append(acc, m))
    )
    facets = F.expr("try_variant_get(o, '$.raw_text.facets', 'array<struct<type: string, original: string, replacement: string>>')")
    of = lambda kind, value: F.array_distinct(F.array_compact(F.transform(F.filter(facets, lambda f: f["type"] == kind), value)))
    entities = F.struct(
        of("hashtag", lambda f: F.regexp_replace(filled(f["original"]), "^#", "")).alias("hashtags"),
        of("mention", lambda f: F.regexp_replace(filled(f["original"]), "^@", "")).alias("mentions"),
        of("url", lambda f: F.coalesce(filled(f["replacement"]), filled(f["original"]))).alias("urls"),
    )
    replied = F.coalesce(
        canonical_id(text("replying_to.status")), canonical_id(text("replying_to_status[0].id")), canonical_id(text("replying_to_status[0]")), canonical_id(text("replying_to_status"))
    )
    out = found.withColumns(
        {
            "post_id": canonical_id(text("id")),
            "text": text("text"),
            "created_ms": F.coalesce(stamp, human_ms(text("created_at"))),
            "likes": count("likes"),
            "retweets": count("reposts"),
            "quotes": count("quotes"),
            "replies": count("replies"),
            "media": F.coalesce(kept, F.array().cast("array<struct<type: string, url: string>>")),
            "quoted_id": canonical_id(text("quote.id")),
            "reply_to_id": replied,
            "lang": filled(text("lang")),
            "entities": F.when(facets.isNotNull(), entities),
            "author_id": canonical_id(text("author.id")),
            "handle": F.lower(F.regexp_replace(filled(text("author.screen_name")), "^@", "")),
            "display_name": filled(text("author.name")),
            "follower_count": count("author.followers"),
            "following_count": count("author.following"),
            "verified": F.expr("try_variant_get(o, '$.author.verification.verified', 'boolean')"),
            "author_created_ms": human_ms(text("author.joined")),
            "bio": filled(text("author.description")),
            "avatar_url": filled(text("author.avatar_url")),
        }
    )
    no_author = F.expr(f"coalesce({json_kind('$.author')} = 'VOID', true)")
    has = lambda test: ~no_author & test
    bad_media = F.exists(typed, lambda m: m["type"].isNull() | F.coalesce(F.trim(m["url"]) == "", F.lit(True)))
    tests = {
        "missing_tweet_id": F.col("post_id").isNull(),
        "empty_text": F.trim(F.coalesce("text", F.lit(""))) == "",
        "invalid_created_at": F.col("created_ms").isNull(),
        "missing_metric": F.col("likes").isNull() | F.col("retweets").isNull() | F.col("quotes").isNull() | F.col("replies").isNull(),
        "invalid_media": bad_media,
        "missing_author": no_author,
        "missing_author_id": has(F.col("author_id").isNull()),
        "missing_author_handle": has(F.col("handle").isNull()),
        "missing_author_display_name": has(F.col("display_name").isNull()),
        "missing_author_counts": has(F.col("follower_count").isNull() | F.col("following_count").isNull()),
        "missing_author_created_at": has(F.col("author_created_ms").isNull()),
        "missing_author_verification": has(F.col("verified").isNull()),
    }
    status = _sound() & F.expr("coalesce(try_variant_get(o, '$.type', 'string') = 'status', false)")
    reasons = F.when(status, rejection_reasons(tests)).otherwise(F.array(F.lit(REJECTION_CODES[0])))
    hidden = F.expr("coalesce(try_variant_get(o, '$.quote.type', 'string') = 'tombstone', false)")
    return out.withColumns({"reasons": reasons, "reposted": ~F.expr(f"coalesce({json_kind('$.reposted_by')} = 'VOID', true)"), "quote_tombstone": hidden}).drop("o", "row")


def human_ms(value: Column) -> Column:
    """Milliseconds of the provider's dates: ``Mon Sep 01 05:05:29 -0700 2025`` or ISO 8601."""
    provider = F.try_to_timestamp(F.substring(value, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.unix_millis(F.coalesce(provider, value.try_cast("timestamp")))


@dataclass
class Run:
    """What a run leaves: posts and authors of the corpus in their order (seq), side outputs, and counts (section, key, n)."""

    posts: DataFrame
    authors: DataFrame
    rejections: DataFrame
    duplicates: DataFrame
    skips: DataFrame
    counts: DataFrame


def normalise_run(pages: DataFrame, accounts: DataFrame, *, cutoff_ms: int) -> Run:
    """pages: account, page, position, received_at (ms), raw_file, row (JSON); accounts: account, place (configured order).

    Accounts that aren't configured come last, by name.
    """
    order = ["place", "account", "page", "position", "depth"]
    mapped = map_candidates(candidates(pages)).join(accounts.select("account", "place"), "account", "left").withColumn("place", F.coalesce("place", F.lit(2**31 - 1)))
    mapped = materialize(mapped.withColumn("seq", F.struct(*order)), "candidates")
    good = mapped.filter(F.size("reasons") == 0)
    kind = window_reason(F.col("origin"), F.col("author_id") == F.col("account"), F.col("reposted"), F.col("created_ms"), cutoff_ms)
    kept = good.withColumn("window", kind)
    outcome = materialize(dedup_with_refresh(kept.filter("window = 'kept'"), "post_id", "seq", "text", "received_at"), "outcomes")
    side = ["account", "page", "raw_file", F.col("position").alias("row_index"), "origin", "parent_id", F.col("post_id").alias("candidate_id")]
    conflicts = outcome.filter("outcome = 'conflict'").select(*side, F.array(F.lit("conflicting_tweet_text")).alias("reasons"))
    rejections = mapped.filter(F.size("reasons") > 0).select(*side, "reasons").unionByName(conflicts)
    first = outcome.filter("outcome = 'first'")
    seen = lambda prefix: F.struct(F.col(f"{prefix}account").alias("account_user_id"), F.col(f"{prefix}page").alias("page"), F.col(f"{prefix}origin").alias("origin"))
    start = first.select("post_id", *[F.col(c).alias(f"f_{c}") for c in ("account", "page", "origin")])
    again = outcome.filter("outcome IN ('refreshed', 'duplicate')").join(start, "post_id")
    duplicates = again.select(F.col("post_id").alias("tweet_id"), seen("f_").alias("first_seen"), seen("").alias("again"), (F.col("outcome") == "refreshed").alias("metrics_refreshed"))
    skips = kept.filter("window = 'skipped'").select(F.col("post_id").alias("tweet_id"), "account", "page", F.col("created_ms").alias("created_at"), F.lit(cutoff_ms).alias("cutoff_at"))
    metrics = ["likes", "retweets", "quotes", "replies"]
    newest = outcome.filter("outcome IN ('first', 'refreshed')").groupBy("post_id").agg(F.max_by(F.struct(*metrics, F.col("received_at").alias("metrics_at")), "received_at").alias("m"))
    posts = first.drop(*metrics).join(newest, "post_id").select("seq", "post_id", "author_id", "origin", "text", "created_ms", "m.*", "media", "quoted_id", "reply_to_id", "lang", "entities")
    person = ["handle", "display_name", "follower_count", "following_count", "verified", F.col("author_created_ms").alias("created_ms"), "bio", "avatar_url"]
    known = outcome.filter("outcome <> 'conflict'").groupBy("author_id").agg(F.min_by(F.struct(*person), F.struct((-F.col("received_at")).alias("t"), "seq")).alias("a"))
    authors = posts.groupBy("author_id").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("accepted")).join(known, "author_id").select("seq", "author_id", "accepted", "a.*")
    return Run(posts, authors, rejections, duplicates, skips, _counts(mapped, kept, outcome, rejections, posts))


def _counts(mapped: DataFrame, kept: DataFrame, outcome: DataFrame, rejections: DataFrame, posts: DataFrame) -> DataFrame:
    tally = lambda rows, section, key: rows.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "key", "n")
    line = kept.filter("depth = 0").groupBy("account", "post_id").agg((F.count(F.lit(1)) - 1).alias("again"))
    one = lambda section, rows, n: rows.agg(n.cast("long").alias("n")).select(F.lit(section).alias("section"), F.lit("").alias("key"), "n")
    parts = [
        tally(mapped, "candidates", F.col("origin")),
        tally(rejections, "rejected", F.col("origin")),
        tally(rejections.select(F.explode("reasons").alias("reason")), "rejected_reason", F.col("reason")),
        tally(posts, "accepted", F.col("origin")),
        tally(posts, "author", F.col("author_id")),
        tally(outcome.filter("outcome IN ('refreshed', 'duplicate')"), "duplicates", F.col("outcome")),
        one("skipped", kept, F.count_if(F.col("window") == "skipped")),
        one("tombstone_quotes", kept, F.count_if("quote_tombstone")),
        one("repeated_rows", line, F.coalesce(F.sum("again"), F.lit(0))),
        one("oldest", posts, F.min("created_ms")),
        one("newest", posts, F.max("created_ms")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def emission(run: Run) -> DataFrame:
    """kind, id, seq in the order records are written: an author just before the first post that needs it."""
    people = run.authors.select(F.lit("author").alias("kind"), F.col("author_id").alias("id"), "seq", F.lit(0).alias("second"))
    return people.unionByName(run.posts.select(F.lit("tweet").alias("kind"), F.col("post_id").alias("id"), "seq", F.lit(1).alias("second"))).orderBy("seq", "second").drop("second")
