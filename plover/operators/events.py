"""Exported analytics events: the envelope's gate, and the posts and authors staged from their payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.functions.ids import canonical_id
from plover.operators.drift import json_object
from plover.operators.ingest import ENVELOPE_BYTES, json_kind
from plover.operators.normalize import MAX_DEPTH, human_ms
from plover.operators.timestamps import instant_us

#: The event captured data arrives in, its schema version, and what it may be about.
EVENT = "xmd_data_captured"
VERSION = 1
RESOURCES = ("tweet", "profile", "search", "followers", "following")
_UUID = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"


def gated(events: DataFrame, name: str, properties: str) -> DataFrame:
    """``events`` plus o (the properties unwrapped) and reason: ignored (another event), ok, or the first rule the envelope breaks."""
    held = events.withColumn("o", json_object(F.col(properties)))
    is_ = lambda key, kinds: F.expr(f"coalesce({json_kind('$.' + key)} RLIKE '^({kinds})', false)")
    absent = lambda key: F.expr(f"{json_kind('$.' + key)} IS NULL")
    text = lambda key: F.expr(f"try_variant_get(o, '$.{key}', 'string')")
    number = lambda key: F.expr(f"try_variant_get(o, '$.{key}', 'bigint')")
    sure = lambda test: F.coalesce(test, F.lit(False))
    strings = F.expr("coalesce(forall(try_variant_get(o, '$.warnings', 'array<variant>'), x -> schema_of_variant(x) = 'STRING'), false)")
    chunk = is_("chunk_count", "BIGINT") & is_("chunk_index", "BIGINT") & sure((number("chunk_count") > 0) & (number("chunk_index") >= 0) & (number("chunk_index") < number("chunk_count")))
    captured = is_("captured_at", "STRING") & sure(text("captured_at").rlike(r"\A\d{4}-\d{2}-\d{2}T")) & F.coalesce(instant_us(text("captured_at")), human_ms(text("captured_at"))).isNotNull()
    rules = [
        ("unsupported_schema", is_("archive_schema_version", "BIGINT") & sure(number("archive_schema_version") == VERSION)),
        ("invalid_request_id", is_("request_id", "STRING") & sure(text("request_id").rlike(_UUID))),
        ("invalid_status_or_resource", is_("http_status", "BIGINT") & sure((number("http_status") == 200) & text("resource").isin(*RESOURCES))),
        ("invalid_source_or_degraded", is_("source", "STRING") & is_("degraded", "BOOLEAN")),
        ("invalid_cache", absent("cache") | is_("cache", "STRING")),
        ("invalid_warnings", absent("warnings") | (is_("warnings", "ARRAY") & strings)),
        ("invalid_chunk", chunk),
        ("invalid_captured_at", captured),
        ("oversized", sure(F.octet_length(properties) < ENVELOPE_BYTES)),
        ("invalid_payload", is_("payload", "OBJECT") & is_("payload.posts", "ARRAY") & is_("payload.users", "ARRAY")),
    ]
    reason = F.when(~sure(F.col(name) == EVENT), "ignored")
    for code, holds in rules:
        reason = reason.when(~holds, code)
    return held.withColumn("reason", reason.otherwise("ok"))


def media_items(o: str) -> Column:
    """The media of a post (variant column ``o``): all, else photos, videos and animated ones; type from the item or its list, URL
    from the item or the first of its variants or formats that has one. Null if an item is neither."""
    shape = "array<struct<type: string, url: string, variants: array<struct<url: string>>, formats: array<struct<url: string>>>>"
    of = lambda key, kind: F.transform(F.expr(f"try_variant_get({o}, '$.media.{key}', '{shape}')"), lambda m: F.struct(m["type"].alias("type"), F.lit(kind).alias("fallback"), m.alias("m")))
    every = of("all", None)
    none = F.array().cast("array<struct<type: string, fallback: string, m: struct<type: string, url: string, variants: array<struct<url: string>>, formats: array<struct<url: string>>>>>")
    lists = F.concat(*[F.coalesce(of(key, kind), none) for key, kind in (("photos", "image"), ("videos", "video"), ("animated", "gif"))])
    items = F.when(F.size(F.coalesce(every, none)) > 0, every).otherwise(lists)
    public = lambda u: F.when(u.rlike("^https://[^/@?#]+([/?#]|$)"), F.regexp_replace(u, "[?#].*$", ""))
    first = lambda xs: F.get(F.filter(F.transform(xs, lambda x: public(x["url"])), lambda u: u.isNotNull()), F.lit(0))
    named = lambda t: F.when(t == "photo", "image").when(t == "animated_gif", "gif").otherwise(t)
    out = F.transform(items, lambda x: F.struct(F.coalesce(named(x["type"]), x["fallback"]).alias("type"), F.coalesce(public(x["m"]["url"]), first(F.coalesce(x["m"]["variants"], x["m"]["formats"]))).alias("url")))
    return F.when(~F.exists(out, lambda m: ~F.coalesce(m["type"].isin("image", "video", "gif") & m["url"].isNotNull(), F.lit(False))), out)


def staged(events: DataFrame, seq: str) -> DataFrame:
    """seq, location, kind, record_id, issue of every author and post in good events' payloads (columns seq, o): users, the profile,
    posts and the posts quoted in them, an author before its post. What nests deeper than ``MAX_DEPTH`` is an issue itself."""
    part = lambda path: F.expr(f"try_variant_get(o, '$.payload.{path}', 'array<variant>')")
    users = events.select(F.col(seq).alias("seq"), F.posexplode(part("users"))).select("seq", F.format_string("users[%d]", "pos").alias("location"), F.lit("author").alias("kind"), F.lit(0).alias("depth"), F.col("col").alias("v"))
    profile = events.select(F.col(seq).alias("seq"), F.lit("profile").alias("location"), F.lit("author").alias("kind"), F.lit(0).alias("depth"), F.expr("try_variant_get(o, '$.payload.profile', 'variant')").alias("v")).filter("v IS NOT NULL")
    posts = events.select(F.col(seq).alias("seq"), F.posexplode(part("posts")).alias("pos", "p"))
    levels = F.array(*[F.struct(F.lit(i).alias("depth"), F.expr(f"try_variant_get(p, '${'.quote' * i}', 'variant')").alias("v")) for i in range(MAX_DEPTH + 2)])
    nested = posts.select("seq", "pos", F.explode(F.filter(levels, lambda x: (x["depth"] == 0) | F.coalesce(F.substring(F.call_function("schema_of_variant", x["v"]), 1, 6) == "OBJECT", F.lit(False)))).alias("n"))
    where = F.concat(F.format_string("posts[%d]", "pos"), F.repeat(F.lit(".quote"), F.col("n.depth")))
    tweets = nested.select("seq", where.alias("location"), F.lit("tweet").alias("kind"), F.col("n.depth").alias("depth"), F.col("n.v").alias("v"))
    people = tweets.select("seq", F.concat("location", F.lit(".author")).alias("location"), F.lit("author").alias("kind"), "depth", F.expr("try_variant_get(v, '$.author', 'variant')").alias("v")).filter("v IS NOT NULL AND NOT is_variant_null(v)")
    every = users.unionByName(profile).unionByName(people.filter(F.col("depth") <= MAX_DEPTH)).unionByName(tweets)
    return every.select("seq", "location", "kind", canonical_id(F.expr("try_variant_get(v, '$.id', 'string')")).alias("record_id"), _issue().alias("issue"))


def _issue() -> Column:
    o = lambda p: f"try_variant_get(v, '$.{p}', 'variant')"
    text = lambda p: F.expr(f"CASE WHEN schema_of_variant({o(p)}) = 'STRING' THEN try_variant_get(v, '$.{p}', 'string') END")
    count = lambda p: F.expr(f"coalesce(schema_of_variant({o(p)}) = 'BIGINT' AND try_variant_get(v, '$.{p}', 'bigint') >= 0, false)")
    no_id = lambda p: canonical_id(F.expr(f"try_variant_get(v, '$.{p}', 'string')")).isNull()
    time = lambda *p: F.coalesce(*[F.coalesce(F.expr(f"try_variant_get(v, '$.{x}', 'bigint')"), human_ms(text(x))) for x in p]).isNull()
    author = (
        F.when(no_id("id"), "id")
        .when(F.coalesce(text("screen_name"), F.lit("")) == "", "screen_name")
        .when(F.coalesce(text("name"), F.lit("")) == "", "name")
        .when(~count("followers"), "followers")
        .when(~count("following"), "following")
        .when(F.expr("try_variant_get(v, '$.verification.verified', 'boolean') IS NULL"), "verified")
        .when(time("joined"), "joined")
    )
    tweet = (
        F.when(F.col("depth") > MAX_DEPTH, "too_deep")
        .when(no_id("id"), "id")
        .when(F.coalesce(text("text"), F.lit("")) == "", "text")
        .when(no_id("author.id"), "author")
        .when(time("created_timestamp", "created_at"), "created_at")
        .when(~count("likes"), "likes")
        .when(~(count("retweets") | count("reposts")), "retweets")
        .when(~count("quotes"), "quotes")
        .when(~count("replies"), "replies")
        .when(media_items("v").isNull(), "media")
    )
    return F.when(F.col("kind") == "author", author).otherwise(tweet)


