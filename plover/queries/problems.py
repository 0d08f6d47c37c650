"""Queries of the general problems p2, p3, p4, p6 and p7 over the project's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.functions.ids import canonical_id, canonical_uuid
from plover.operators import csvload, deliver_once, drift, orphans, timestamps
from plover.sources.tables import table

EPOCH_MS_DIGITS = r"^[0-9]{13}$"


# ---- p2 -------------------------------------------------------------------------------------------------------------
def _time_values(spark: SparkSession, d: str) -> DataFrame:
    """record_table, record_seq, feed_id, value: every value of the three columns that isn't null."""
    ingress = table(spark, d, "ingress").select(F.lit("ingress").alias("record_table"), F.col("ingress_seq").alias("record_seq"), "feed_id", F.col("created_at").alias("value"))
    loose = (
        table(spark, d, "loose_posts")
        .select("loose_seq", "feed_id", drift.json_object("raw_line").alias("o"))
        .select(
            F.lit("loose_posts").alias("record_table"),
            F.col("loose_seq").alias("record_seq"),
            "feed_id",
            F.expr("coalesce(try_variant_get(o, '$.created_at', 'string'), try_variant_get(o, '$.createdAt', 'string'))").alias("value"),
        )
    )
    capture = table(spark, d, "capture_events").select(
        F.lit("capture_events").alias("record_table"), F.col("event_seq").alias("record_seq"), "feed_id", F.col("event_timestamp").alias("value")
    )
    return ingress.unionByName(loose).unionByName(capture).filter(F.col("value").isNotNull())


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    values = _time_values(spark, d).filter(~(F.col("value").rlike(EPOCH_MS_DIGITS) & F.col("value").try_cast("long").between(timestamps.FIRST_MS, timestamps.LAST_MS)))
    feeds = table(spark, d, "feeds").select("feed_id", "zone_name", "date_order")
    return timestamps.normalise(values.join(feeds, "feed_id", "left"), "value", "feed_id", "zone_name", "date_order")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d).filter(F.col("utc_ms").between(timestamps.FIRST_MS, timestamps.LAST_MS)).select("record_table", "record_seq", "utc_ms")


def p2_formats(spark: SparkSession, d: str) -> DataFrame:
    """How the values of each table were read: format, where the zone came from, what stayed open."""
    return _normalised(spark, d).groupBy("record_table", "format", "zone_from", "status").agg(F.count(F.lit(1)).alias("n"), F.min("utc_ms").alias("first_ms"), F.max("utc_ms").alias("last_ms"))


# ---- p3 -------------------------------------------------------------------------------------------------------------
def _producer_lines(spark: SparkSession, d: str) -> DataFrame:
    loose = table(spark, d, "loose_posts").select(F.lit("loose_posts").alias("t"), "stream_id", "file_no", "source_file", F.col("raw_line").alias("line"))
    capture = table(spark, d, "capture_events").select(F.lit("capture_events").alias("t"), "stream_id", "file_no", "source_file", F.col("properties").alias("line"))
    return loose.unionByName(capture).select(F.struct("t", "stream_id").alias("producer"), "file_no", "source_file", "line")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(_producer_lines(spark, d)).withColumn("record_table", F.col("producer.t"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("record_table", "source_file", "field_name", "change_kind", "new_name")


def p3_lifespans(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue: which field lived from which file to which, with which types."""
    return drift.lifespans(_producer_lines(spark, d)).select(
        F.col("producer.t").alias("record_table"), F.col("producer.stream_id").alias("stream_id"), F.col("field").alias("field_name"), F.col("types").alias("json_types"), "from_ordinal", "to_ordinal"
    )


#: Names one field has had in the project's files. Fields that aren't named here come out in ``rest``.
POST_ALIASES = {
    "post_id": ("string", ["$.id"]),
    "body": ("string", ["$.text", "$.full_text", "$.body"]),
    "author": ("string", ["$.author_id", "$.authorId", "$.author.id"]),
    "created": ("string", ["$.created_at", "$.createdAt"]),
    "created_epoch": ("bigint", ["$.created_timestamp", "$.created_timestamp.value"]),
    "measured_at": ("bigint", ["$.metrics_at", "$.metricsAt"]),
    "like_count": ("bigint", ["$.likes", "$.likes.value", "$.favorites"]),
    "repost_count": ("bigint", ["$.reposts", "$.reposts.value", "$.retweets", "$.repost_count"]),
    "quote_count": ("bigint", ["$.quotes"]),
    "reply_count": ("bigint", ["$.replies", "$.replies.count"]),
    "language": ("string", ["$.lang", "$.lang[0]", "$.language", "$.language[0]"]),
    "reply_to": ("string", ["$.in_reply_to_tweet_id", "$.inReplyToTweetId"]),
    "line_type": ("string", ["$.type"]),
    "author_record": ("json", ["$.author"]),
    "author_handle": ("string", ["$.author_handle", "$.authorHandle", "$.author.screen_name"]),
    "media": ("json", ["$.media"]),
    "tags": ("json", ["$.tags"]),
    "edit_info": ("json", ["$.edit_info"]),
    "possibly_sensitive": ("boolean", ["$.possibly_sensitive"]),
    "source_app": ("string", ["$.source_app"]),
    "bookmark_count": ("bigint", ["$.bookmarks"]),
    "view_count": ("bigint", ["$.views"]),
}
EVENT_ALIASES = {
    "archive_schema_version": ("string", ["$.archive_schema_version", "$.archiveSchemaVersion", "$.schema_version"]),
    "request_id": ("string", ["$.request_id"]),
    "captured_at": ("string", ["$.captured_at"]),
    "resource": ("string", ["$.resource"]),
    "http_status": ("bigint", ["$.http_status", "$.status_code"]),
    "source": ("string", ["$.source", "$.provider"]),
    "cache": ("string", ["$.cache", "$.cache_state"]),
    "degraded": ("boolean", ["$.degraded"]),
    "warnings": ("json", ["$.warnings", "$.notices"]),
    "chunk_index": ("bigint", ["$.chunk_index"]),
    "chunk_count": ("bigint", ["$.chunk_count"]),
    "payload": ("json", ["$.payload"]),
    "edge_site": ("string", ["$.edge_site"]),
    "retries": ("bigint", ["$.retries"]),
    "sampled": ("boolean", ["$.sampled"]),
    "sdk": ("json", ["$.sdk"]),
}


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """All well-formed lines of loose_posts and all properties of capture_events as one table with one name and type per
    field: the declared ones, and a column for every other field of the catalogue; ``rest`` holds what no column holds whole."""
    keep = ["record_table", "record_seq"]
    lines, out = _producer_lines(spark, d), None
    for name, seq, line, declared in (("loose_posts", "loose_seq", "raw_line", POST_ALIASES), ("capture_events", "event_seq", "properties", EVENT_ALIASES)):
        aliases = drift.generated_aliases(lines.filter(F.col("producer.t") == name), declared)
        rows = table(spark, d, name).select(F.lit(name).alias(keep[0]), F.col(seq).alias(keep[1]), F.col(line).alias("line"))
        part = drift.unified(rows, aliases, keep)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# ---- p4 -------------------------------------------------------------------------------------------------------------
def _events(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "capture_events").select("event_seq", "received_at", "uuid", drift.json_object("properties").alias("o"))
    return raw.select(
        "event_seq",
        "received_at",
        canonical_uuid("uuid").alias("uuid_key"),
        F.expr("lower(trim(try_variant_get(o, '$.request_id', 'string')))").alias("request_id"),
        F.expr("try_variant_get(o, '$.chunk_index', 'bigint')").alias("chunk_index"),
        timestamps.instant_us(F.expr("try_variant_get(o, '$.captured_at', 'string')")).alias("captured_us"),
    )


def _event_ids() -> dict:
    whole = F.col("request_id").isNotNull() & F.col("chunk_index").isNotNull() & F.col("captured_us").isNotNull()
    return {"uuid": F.col("uuid_key"), "request": F.when(whole, F.concat_ws("|", "request_id", "chunk_index", "captured_us"))}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return deliver_once.redelivered(_events(spark, d), "event_seq", F.col("received_at"), _event_ids())


def p4_delivered_once(spark: SparkSession, d: str) -> DataFrame:
    return deliver_once.deliver_once(_events(spark, d), "event_seq", F.col("received_at"), _event_ids()).select("event_seq", "uuid_key", "request_id", "chunk_index", "captured_us")


# ---- p6 -------------------------------------------------------------------------------------------------------------
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return csvload.load_rejections(table(spark, d, "rejection_lines")).filter(F.col("failure").isNotNull()).select("raw_seq", "failure")


def p6_errors(spark: SparkSession, d: str) -> DataFrame:
    """Where and why each refused line broke."""
    loaded = csvload.load_rejections(table(spark, d, "rejection_lines")).filter(F.col("failure").isNotNull())
    return loaded.select("raw_seq", "failure", "detail", "error_offset")


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    loaded = csvload.load_rejections(table(spark, d, "rejection_lines")).filter(F.col("failure").isNull())
    return loaded.select("raw_seq", "kind", "account_user_id", "page", "raw_file", "row_index", "origin", "parent_id", "candidate_id", F.array_join("reasons", "|").alias("reasons"))


# ---- p7 -------------------------------------------------------------------------------------------------------------
REFERENCES = {"author_id": "author", "quoted_tweet_id": "tweet", "retweet_of_tweet_id": "tweet", "in_reply_to_tweet_id": "tweet"}


def _references(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(e).alias("entity"), F.col(f).alias("raw")) for f, e in REFERENCES.items()])
    return (
        table(spark, d, "ingress")
        .select(F.col("ingress_seq").alias("ref_seq"), F.col("received_at").alias("seen_at"), F.explode(F.filter(listed, lambda x: x["raw"].isNotNull())).alias("r"))
        .select("ref_seq", "seen_at", "r.ref_field", "r.entity", canonical_id(F.col("r.raw")).alias("key"))
    )


def _targets(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "ingress").select(F.lit("tweet").alias("entity"), canonical_id("id").alias("key"), F.col("received_at").alias("seen_at"))
    authors = table(spark, d, "authors").select(F.lit("author").alias("entity"), canonical_id("id").alias("key"), F.col("received_at").alias("seen_at"))
    return posts.unionByName(authors)


def _deletions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tombstones").select("entity", canonical_id("entity_id").alias("key"), "deleted_at")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphan_references(_references(spark, d), _targets(spark, d), _deletions(spark, d))
    return found.select(F.col("ref_seq").alias("ingress_seq"), "ref_field", "ref_state")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_references(spark, d), _targets(spark, d), _deletions(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_formats, p3_found, p3_lifespans, p3_unified, p4_found, p4_delivered_once, p6_found, p6_errors, p6_loaded, p7_found, p7_report)}
