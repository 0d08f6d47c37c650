"""Queries of the write side, collection reports, graph and vectors, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.functions.ids import canonical_id, canonical_uuid
from plover.operators import authors as A
from plover.operators import collect as C
from plover.operators import events as E
from plover.operators import graph, ingest, vectors
from plover.operators import normalize as N
from plover.operators import posts as P
from plover.operators.drift import json_object
from plover.operators.prefix import running
from plover.queries.store import NOW, latest_authors, posts, timed_ingress
from plover.queries.sqlparts import AUTHORS, ENGAGEMENT, POSTS, RECENCY, bucket, canon, q
from plover.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
CUTOFF = 1767225600000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- decoding and gates
@query(f"""WITH {POSTS} SELECT ingress_seq, CASE WHEN id IS NULL THEN 'bad_id' WHEN text IS NULL THEN 'bad_text' WHEN author_id IS NULL THEN 'bad_authorId' WHEN created_ms IS NULL THEN 'bad_createdAt'
 WHEN NOT coalesce(metrics.likes >= 0 AND metrics.retweets >= 0 AND metrics.quotes >= 0 AND metrics.replies >= 0, false) THEN 'bad_metrics' WHEN metrics_at IS NULL THEN 'bad_metricsAt'
 WHEN media IS NULL OR len(list_filter(media, lambda m: m.url IS NULL OR NOT coalesce(m.type IN ('image', 'video', 'gif'), false))) > 0 THEN 'bad_media' END AS reason, id, metrics.likes AS likes FROM keyed""")
def ingress_parse(spark, d):
    """Ingress posts written as the contract's JSON lines and decoded again."""
    named = {"authorId": "author_id", "createdAt": "created_ms", "metricsAt": "metrics_at", "quotedTweetId": "quoted_tweet_id", "retweetOfTweetId": "retweet_of_tweet_id", "inReplyToTweetId": "in_reply_to_tweet_id"}
    keys = [k for k in ingest.CONTRACT["tweet"] if k != "kind"]
    line = F.to_json(F.struct(F.lit("tweet").alias("kind"), *[F.col(named.get(k, k)).alias(k) for k in keys]), {"ignoreNullFields": "false"})
    return ingest.decode_ingress(timed_ingress(spark, d).select("ingress_seq", line.alias("line"))).select("ingress_seq", "reason", "r.id", "r.metrics.likes")


@query(f"""WITH {POSTS}, r AS (SELECT CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty_text' WHEN NOT coalesce(created_ms > 1136073600000 AND created_ms <= {NOW} + 300000, false) THEN 'bad_created_ms'
 WHEN NOT coalesce(metrics_at > 1136073600000 AND metrics_at <= {NOW} + 300000, false) THEN 'bad_metrics_at' ELSE 'ok' END AS reason FROM keyed)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def ingress_gates(spark, d):
    reason = F.coalesce(ingest.gate_reason("text", ["created_ms", "metrics_at"], NOW), F.lit("ok"))
    return timed_ingress(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _num(*paths: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(o, '$.{p}') IN ('UBIGINT', 'BIGINT') THEN CAST(o->>'$.{p}' AS BIGINT) END" for p in paths) + ")"


def _txt(*paths: str) -> str:
    return "coalesce(" + ", ".join(f"o->>'$.{p}'" for p in paths) + ")"


_SOUND = " AND ".join(
    f"coalesce(json_type(o, '$.{p}') IN ({kinds}, 'NULL'), true)"
    for kinds, paths in (("'VARCHAR'", ingest._LOOSE_TEXT), ("'UBIGINT'", ingest._LOOSE_COUNT), ("'UBIGINT', 'BIGINT'", ingest._LOOSE_WHOLE), ("'OBJECT'", ingest._LOOSE_OBJECT), ("'ARRAY'", ["media.all"]), ("'BOOLEAN'", ["author.verification.verified"]))
    for p in paths
)
LOOSE = f"""j AS (SELECT loose_seq, CASE WHEN json_valid(raw_line) AND json_type(raw_line) = 'OBJECT' THEN CAST(raw_line AS JSON) END AS o FROM loose_posts),
f AS (SELECT loose_seq, o, o->>'$.type' AS type, {_SOUND} AS sound, {canon(_txt('id'))} AS post_id, trim(o->>'$.text', ' ') AS text, {canon(_txt('author_id', 'authorId', 'author.id'))} AS author_id,
 {_num('created_at', 'createdAt', 'created_timestamp')} AS c, {_num('metrics_at', 'metricsAt')} AS m, coalesce({_num('likes', 'metrics.likes')}, 0) AS likes, coalesce({_num('reposts', 'retweets', 'metrics.retweets')}, 0) AS reposts,
 {canon(_txt('quoted_tweet_id', 'quotedTweetId', 'quote.id'))} AS quoted_id, {canon(_txt('in_reply_to_tweet_id', 'inReplyToTweetId', 'replying_to.status'))} AS reply_to_id,
 CASE WHEN json_type(o, '$.author') = 'OBJECT' THEN coalesce(o->>'$.author.name', {_txt('author_handle', 'authorHandle', 'author.screen_name', 'author_id', 'authorId', 'author.id')}) END AS author_name FROM j),
g AS (SELECT *, CASE WHEN c > 0 AND c < 1000000000000 THEN c * 1000 ELSE c END AS created_ms, coalesce(CASE WHEN m > 0 AND m < 1000000000000 THEN m * 1000 ELSE m END, CASE WHEN c > 0 AND c < 1000000000000 THEN c * 1000 ELSE c END) AS metrics_at FROM f)"""


@query(f"""WITH {LOOSE} SELECT loose_seq, post_id, created_ms, metrics_at, likes, reposts, quoted_id, reply_to_id, author_name, CASE WHEN o IS NULL THEN 'broken' WHEN json_type(o, '$.kind') IS NOT NULL THEN 'strict' WHEN NOT sound THEN 'bad_type' WHEN post_id IS NULL THEN 'missing_post_id'
 WHEN coalesce(text, '') = '' THEN 'empty_text' WHEN type = 'tombstone' THEN 'tombstone' WHEN author_id IS NULL THEN 'missing_author_id' WHEN created_ms IS NULL THEN 'missing_created_ms' END AS reason FROM g""")
def loose_ingest(spark, d):
    rows = ingest.decode_loose(table(spark, d, "loose_posts"), "raw_line")
    return rows.select("loose_seq", "post_id", "created_ms", "metrics_at", "likes", "reposts", "quoted_id", "reply_to_id", F.col("author.display_name").alias("author_name"), "reason")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def archive_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("""SELECT event_seq, CASE WHEN strlen(properties) > 1000000 THEN 'line_too_long' WHEN strlen(properties) > 200000 THEN 'envelope_too_large' ELSE 'ok' END AS reason,
 CASE WHEN strlen(properties) > 1000000 THEN sha256(properties) END AS sha256 FROM capture_events""")
def event_line_gate(spark, d):
    """Size gates of exported lines; of a line too long to keep there remains its hash."""
    return ingest.line_gate(table(spark, d, "capture_events"), "properties").select("event_seq", "reason", "sha256")


EVENTS = """raw AS (SELECT *, CASE WHEN json_type(properties) = 'VARCHAR' THEN CAST(CAST(properties AS JSON)->>'$' AS JSON) ELSE CAST(properties AS JSON) END AS o FROM capture_events),
ev AS (SELECT event_seq, uuid, o, lower(o->>'$.request_id') AS request_id, TRY_CAST(o->>'$.chunk_index' AS BIGINT) AS chunk_index, TRY_CAST(o->>'$.chunk_count' AS BIGINT) AS chunk_count,
 TRY_CAST(o->>'$.archive_schema_version' AS BIGINT) AS version, o->>'$.captured_at' AS captured_at, o->>'$.resource' AS resource, o->>'$.source' AS source FROM raw)"""


def _events(spark, d):
    return event_fields(table(spark, d, "capture_events"))


def event_fields(events: DataFrame) -> DataFrame:
    e = events.withColumn("o", json_object("properties"))
    text = lambda p: F.expr(f"try_variant_get(o, '$.{p}', 'string')")
    big = lambda p: F.expr(f"try_variant_get(o, '$.{p}', 'bigint')")
    return e.select(
        "event_seq", "uuid", F.lower(text("request_id")).alias("request_id"), big("chunk_index").alias("chunk_index"), big("chunk_count").alias("chunk_count"),
        big("archive_schema_version").alias("version"), text("captured_at").alias("captured_at"), text("resource").alias("resource"), text("source").alias("source"), "received_at", "o",
    )


_INT = "coalesce(json_type(o, '$.{0}') IN ('UBIGINT', 'BIGINT'), false)"
_STR = "coalesce(json_type(o, '$.{0}') = 'VARCHAR', false)"
_GATED = f"""{EVENTS}, gated AS (SELECT ev.event_seq, o, CASE WHEN event_name IS DISTINCT FROM {q(E.EVENT)} THEN 'ignored'
 WHEN NOT ({_INT.format('archive_schema_version')} AND coalesce(version = 1, false)) THEN 'unsupported_schema'
 WHEN NOT ({_STR.format('request_id')} AND regexp_full_match(request_id, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}')) THEN 'invalid_request_id'
 WHEN NOT ({_INT.format('http_status')} AND coalesce(CAST(o->>'$.http_status' AS BIGINT) = 200 AND resource IN ('tweet', 'profile', 'search', 'followers', 'following'), false)) THEN 'invalid_status_or_resource'
 WHEN NOT ({_STR.format('source')} AND coalesce(json_type(o, '$.degraded') = 'BOOLEAN', false)) THEN 'invalid_source_or_degraded'
 WHEN NOT (json_type(o, '$.cache') IS NULL OR json_type(o, '$.cache') = 'VARCHAR') THEN 'invalid_cache'
 WHEN NOT (json_type(o, '$.warnings') IS NULL OR (json_type(o, '$.warnings') = 'ARRAY' AND len(list_filter(json_extract(o, '$.warnings[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0)) THEN 'invalid_warnings'
 WHEN NOT ({_INT.format('chunk_count')} AND {_INT.format('chunk_index')} AND coalesce(chunk_count > 0 AND chunk_index >= 0 AND chunk_index < chunk_count, false)) THEN 'invalid_chunk'
 WHEN NOT ({_STR.format('captured_at')} AND regexp_matches(captured_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T') AND TRY_CAST(captured_at AS TIMESTAMPTZ) IS NOT NULL) THEN 'invalid_captured_at'
 WHEN strlen(properties) >= 200000 THEN 'oversized' WHEN NOT coalesce(json_type(o, '$.payload') = 'OBJECT' AND json_type(o, '$.payload.posts') = 'ARRAY' AND json_type(o, '$.payload.users') = 'ARRAY', false) THEN 'invalid_payload' ELSE 'ok' END AS reason
 FROM ev JOIN capture_events c ON c.event_seq = ev.event_seq)"""


@query(f"WITH {_GATED} SELECT event_seq, reason FROM gated")
def event_gate(spark, d):
    return E.gated(table(spark, d, "capture_events"), "event_name", "properties").select("event_seq", "reason")


@query(f"""WITH {_GATED}, p AS (SELECT event_seq, unnest(json_extract(o, '$.payload.posts[*]')) AS v, unnest(range(0, len(json_extract(o, '$.payload.posts[*]')))) AS i FROM gated WHERE reason = 'ok')
SELECT event_seq AS seq, 'posts[' || i || ']' AS location, 'tweet' AS kind, {canon("(v->>'$.id')")} AS record_id,
 CASE WHEN {canon("(v->>'$.id')")} IS NULL THEN 'id' WHEN coalesce(v->>'$.text', '') = '' THEN 'text' WHEN {canon("(v->>'$.author.id')")} IS NULL THEN 'author' ELSE 'other' END AS issue FROM p""")
def event_records(spark, d):
    """Posts and authors staged from the payloads of good events, with what keeps them out. The tables' posts have no authors."""
    good = E.gated(table(spark, d, "capture_events"), "event_name", "properties").filter("reason = 'ok'")
    return E.staged(good, "event_seq")


@query(f"WITH {EVENTS} SELECT resource, source, count(*) AS n, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM ev GROUP BY ALL")
def event_props(spark, d):
    return _events(spark, d).groupBy("resource", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_count").alias("chunks"))


@query(f"""WITH {POSTS}, one AS (SELECT a.post_id AS root, a.quoted_id AS next FROM posts a WHERE a.quoted_id IS NOT NULL), two AS (SELECT root, p.post_id, p.quoted_id AS next FROM one JOIN posts p ON next = p.post_id)
SELECT root, 0 AS depth, root AS post_id FROM one UNION ALL SELECT root, 1, post_id FROM two UNION ALL SELECT root, 2, p.post_id FROM two JOIN posts p ON two.next = p.post_id""")
def quote_unnest(spark, d):
    """Posts that quote, with what they quote nested two deep as a provider would send it, taken apart again."""
    p = posts(spark, d)
    plain = F.struct(F.col("post_id").alias("id"), "text")
    inner = p.select(F.col("post_id").alias("k2"), plain.alias("v2"))
    middle = p.join(inner, F.col("quoted_id") == F.col("k2"), "left").select(F.col("post_id").alias("k1"), F.struct(F.col("post_id").alias("id"), "text", F.col("v2").alias("quote")).alias("v1"))
    whole = p.filter("quoted_id IS NOT NULL").join(middle, F.col("quoted_id") == F.col("k1"), "left")
    lines = whole.select(F.col("post_id").alias("root"), F.to_json(F.struct(F.col("post_id").alias("id"), "text", F.col("v1").alias("quote"))).alias("line"))
    return ingest.unnest_quotes(lines, "root", "line")


@query("SELECT ingress_seq, epoch_ms(strptime(created_at, '%a %b %d %H:%M:%S %z %Y')) AS epoch_ms FROM ingress WHERE regexp_matches(created_at, '^[A-Z][a-z]{2} [A-Z][a-z]{2} [0-9]{2} [0-9:]{8} [+-][0-9]{4} [0-9]{4}$')")
def provider_dates(spark, d):
    rows = table(spark, d, "ingress").filter(F.col("created_at").rlike(r"\A[A-Z][a-z]{2} [A-Z][a-z]{2} [0-9]{2} [0-9:]{8} [+-][0-9]{4} [0-9]{4}\z"))
    at = F.try_to_timestamp(F.substring("created_at", 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return rows.select("ingress_seq", F.unix_millis(at).alias("epoch_ms"))


@query("WITH e AS (SELECT ingress_seq, unnest([{'kind': 'hashtag', 'v': entities.hashtags}, {'kind': 'mention', 'v': entities.mentions}, {'kind': 'url', 'v': entities.urls}]) AS x FROM ingress), u AS (SELECT ingress_seq, x.kind AS kind, unnest(x.v) AS value FROM e) SELECT DISTINCT ingress_seq, kind, value FROM u WHERE value IS NOT NULL")
def facet_entities(spark, d):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.array_compact(f"entities.{c}")).alias("v")) for k, c in (("hashtag", "hashtags"), ("mention", "mentions"), ("url", "urls"))])
    e = table(spark, d, "ingress").select("ingress_seq", F.explode(kinds).alias("x"))
    return e.select("ingress_seq", F.col("x.kind").alias("kind"), F.explode("x.v").alias("value"))


# ---- upserts
KEYED = f"k AS (SELECT *, {canon('id')} AS post_id FROM ingress WHERE {canon('id')} IS NOT NULL)"


def _keyed(spark, d):
    return table(spark, d, "ingress").withColumn("post_id", canonical_id("id")).filter(F.col("post_id").isNotNull())


@query(f"""WITH {KEYED}, m AS (SELECT *, max(metrics_at) OVER (PARTITION BY post_id ORDER BY ingress_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, row_number() OVER (PARTITION BY post_id ORDER BY ingress_seq) AS r FROM k)
SELECT ingress_seq, post_id, CASE WHEN r = 1 THEN 'inserted' WHEN metrics_at > coalesce(newest, -4611686018427387904) THEN 'updated' ELSE 'skipped' END AS action FROM m""")
def metrics_upsert(spark, d):
    return ingest.upsert_actions(_keyed(spark, d), "post_id", "ingress_seq", "metrics_at").select("ingress_seq", "post_id", "action")


@query(f"WITH {KEYED} SELECT post_id, ingress_seq, metrics_at, metrics.likes AS likes FROM k WHERE metrics_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY metrics_at DESC, ingress_seq) = 1")
def latest_recrawl(spark, d):
    rows = _keyed(spark, d).withColumn("likes", F.col("metrics.likes"))
    return ingest.latest_by(rows, "post_id", "metrics_at", "ingress_seq", ["ingress_seq", "metrics_at", "likes"])


@query(f"""WITH {KEYED}, {POSTS}, n AS (SELECT post_id, coalesce(metrics.likes, 0) AS likes, coalesce(metrics.replies, 0) AS replies, coalesce(metrics.retweets, 0) AS retweets, coalesce(metrics.quotes, 0) AS quotes FROM k WHERE metrics_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY metrics_at DESC, ingress_seq) = 1),
o AS (SELECT post_id, created_ms, {bucket(f'{ENGAGEMENT} + {RECENCY}')} AS old_bucket FROM posts), b AS (SELECT post_id, old_bucket, {bucket(f'{ENGAGEMENT} + {RECENCY}')} AS new_bucket FROM n JOIN o USING (post_id))
SELECT * FROM b WHERE old_bucket <> new_bucket""")
def rebucket(spark, d):
    """Posts whose impact bucket moves when their newest metrics arrive; only their postings would be rewritten."""
    counts = ["likes", "replies", "retweets", "quotes"]
    rows = _keyed(spark, d).withColumns({c: F.coalesce(F.col(f"metrics.{c}"), F.lit(0)) for c in counts})
    newest = ingest.latest_by(rows, "post_id", "metrics_at", "ingress_seq", counts)
    score = P.score_bucket(P.engagement() + P.static_recency())
    old = posts(spark, d).select("post_id", "created_ms", score.alias("old_bucket"))
    return newest.join(old, "post_id").select("post_id", "old_bucket", score.alias("new_bucket")).filter("old_bucket <> new_bucket")


@query(f"""WITH h AS (SELECT {canon('id')} AS author_id, lower(regexp_replace(trim(handle, ' '), '^@', '')) AS handle, follower_count, received_at, author_seq FROM authors WHERE {canon('id')} IS NOT NULL),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY author_seq) = 1), {AUTHORS},
j AS (SELECT author_id, o.handle AS oh, o.follower_count AS oc, o.handle IS NULL AS os, n.handle AS nh, n.follower_count AS nc, n.handle IS NULL AS ns FROM o JOIN latest_authors n USING (author_id)),
a AS (SELECT *, CASE WHEN ns THEN 'kept' WHEN os THEN 'promoted' ELSE 'updated' END AS action FROM j)
SELECT author_id, CASE WHEN action = 'kept' THEN oh ELSE nh END AS handle, round(CASE WHEN action = 'promoted' THEN ln(1 + coalesce(nc, 0)) ELSE CASE WHEN os THEN 0.0 ELSE ln(1 + coalesce(oc, 0)) END END, 6) AS authority, action FROM a""")
def author_upsert(spark, d):
    """Each author's first snapshot is stored (a stub if it has no handle), the latest one arrives."""
    raw = table(spark, d, "authors")
    keyed = raw.withColumn("author_id", canonical_id("id")).filter(F.col("author_id").isNotNull())
    first = keyed.groupBy("author_id").agg(F.min_by(F.struct(A.handle("handle").alias("handle"), "follower_count"), "author_seq").alias("a")).select("author_id", "a.*")
    stub = F.col("handle").isNull()
    grown = F.when(stub, F.lit(0.0)).otherwise(F.log1p(F.coalesce("follower_count", F.lit(0)).cast("double")))
    stored = first.withColumns({"authority": grown, "stub": stub})
    arriving = A.latest_authors(raw).withColumn("stub", stub)
    return A.upsert_authors(stored, arriving).select("author_id", "handle", F.round("authority", 6).alias("authority"), "action")


@query(f"WITH {AUTHORS} SELECT author_id, handle, follower_count, verified FROM latest_authors")
def author_latest(spark, d):
    return A.latest_authors(table(spark, d, "authors")).select("author_id", "handle", "follower_count", "verified")


# ---- votes
CAST_VOTES = "v AS (SELECT query_key, candidate_id AS post_id, sign(feedback_votes)::BIGINT AS vote, cand_seq, matched_via AS voter FROM candidates WHERE feedback_votes <> 0)"


@query(f"WITH {CAST_VOTES}, l AS (SELECT query_key, post_id, vote FROM v WHERE voter IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_key, voter, post_id ORDER BY cand_seq DESC) = 1) SELECT query_key, post_id, CAST(sum(vote) AS BIGINT) AS total FROM l GROUP BY ALL")
def vote_totals(spark, d):
    c = table(spark, d, "candidates").filter("feedback_votes <> 0")
    votes = c.select("query_key", F.col("candidate_id").alias("post_id"), F.signum("feedback_votes").cast("long").alias("vote"), F.col("cand_seq").alias("seq"), F.col("matched_via").alias("voter"))
    return ingest.vote_totals(votes)


VOTE_LIMIT = """WITH RECURSIVE v AS (SELECT user_id AS voter, event_id % 5 AS subject, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS vote, CAST(floor(epoch(ts) / 100) AS BIGINT) AS at_s, event_id AS seq FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY voter ORDER BY at_s, seq) AS k FROM v),
f AS (SELECT voter, k, at_s AS opened, 1 AS n, MAP {subject: vote} AS standing, true AS ok FROM o WHERE k = 1
 UNION ALL SELECT voter, k, CASE WHEN again THEN opened WHEN fresh THEN at_s ELSE opened END, CASE WHEN again THEN n WHEN fresh THEN 1 WHEN n < 3 THEN n + 1 ELSE n END,
  CASE WHEN NOT again AND (fresh OR n < 3) THEN map_concat(standing, MAP {subject: vote}) ELSE standing END, again OR fresh OR n < 3
  FROM (SELECT o.voter, o.k, o.at_s, o.subject, o.vote, f.opened, f.n, f.standing, coalesce(map_extract(f.standing, o.subject)[1] = o.vote, false) AS again, o.at_s - f.opened >= 60 AS fresh FROM f JOIN o ON o.voter = f.voter AND o.k = f.k + 1))
SELECT voter, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM f GROUP BY voter"""


def event_votes(events: DataFrame) -> DataFrame:
    """Events as votes of their users."""
    at_s = (F.unix_seconds(F.col("ts").cast("timestamp")) / 100).cast("long")
    return events.select(F.col("user_id").alias("voter"), (F.col("event_id") % 5).alias("post_id"), F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("vote"), at_s.alias("at_s"), F.col("event_id").alias("seq"))


@query(VOTE_LIMIT)
def vote_rate_limit(spark, d):
    """How many votes of each user got through."""
    votes = event_votes(table(spark, d, "events"))
    return ingest.rate_limited_votes(votes, limit=3).groupBy("voter").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


@query(f"""WITH RECURSIVE {KEYED}, o AS (SELECT post_id AS key, metrics_at AS at_ms, text, struct_pack(t := text, m := metrics) AS content, row_number() OVER (PARTITION BY post_id ORDER BY ingress_seq) AS k FROM k WHERE metrics_at IS NOT NULL),
f AS (SELECT key, k, at_ms, content, coalesce(text, '') AS text, 'new' AS outcome FROM o WHERE k = 1
 UNION ALL SELECT key, k, CASE WHEN outcome IN ('updated', 'advanced') THEN n_at ELSE at_ms END, CASE WHEN outcome = 'updated' THEN n_content ELSE content END, CASE WHEN outcome = 'updated' THEN n_text ELSE text END, outcome FROM (
  SELECT o.key, o.k, f.at_ms, f.content, f.text, o.at_ms AS n_at, o.content AS n_content, coalesce(o.text, '') AS n_text, CASE WHEN o.at_ms < f.at_ms THEN 'duplicate' WHEN o.content IS NOT DISTINCT FROM f.content THEN CASE WHEN o.at_ms > f.at_ms THEN 'advanced' ELSE 'duplicate' END
   WHEN o.at_ms = f.at_ms THEN 'conflict' WHEN coalesce(o.text, '') <> f.text THEN 'quarantined' ELSE 'updated' END AS outcome FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1))
SELECT outcome, count(*) AS n FROM f GROUP BY outcome""")
def ledger_dedup(spark, d):
    """Every record of a post as a snapshot in order of arrival: what the ledger makes of it."""
    rows = _keyed(spark, d).filter(F.col("metrics_at").isNotNull())
    snaps = rows.select(F.col("post_id").alias("key"), F.col("ingress_seq").alias("seq"), F.col("metrics_at").alias("at"), F.sha2(F.to_json(F.struct("text", "metrics")), 256).alias("content"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
    return ingest.ledger(snaps).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# ---- normalisation
DEDUP = f"""{KEYED}, s AS (SELECT *, coalesce(text, '') = first_value(coalesce(text, '')) OVER w AS same, row_number() OVER w AS r FROM k WINDOW w AS (PARTITION BY post_id ORDER BY ingress_seq)),
n AS (SELECT *, max(CASE WHEN same THEN received_at END) OVER (PARTITION BY post_id ORDER BY ingress_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM s),
out AS (SELECT ingress_seq, post_id, CASE WHEN r = 1 THEN 'first' WHEN NOT same THEN 'conflict' WHEN received_at > newest THEN 'refreshed' ELSE 'duplicate' END AS outcome FROM n)"""


def _deduped(spark, d):
    return ingest.dedup_with_refresh(_keyed(spark, d), "post_id", "ingress_seq", "text", "received_at")


@query(f"WITH {DEDUP} SELECT * FROM out")
def dedup_refresh(spark, d):
    return _deduped(spark, d).select("ingress_seq", "post_id", "outcome")


@query(f"WITH {DEDUP} SELECT outcome, count(*) AS n, count(DISTINCT post_id) AS n_posts FROM out GROUP BY outcome")
def normalize_counts(spark, d):
    per = _deduped(spark, d).groupBy("outcome", "post_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("outcome").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_posts"))


@query(f"WITH {POSTS} SELECT author_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM posts), 6) AS share FROM posts GROUP BY author_id")
def author_share(spark, d):
    return C.author_share(posts(spark, d))


TOLD = f"""told AS (SELECT again_seq AS ingress_seq, min(again.origin) AS origin, min({canon('again.account_user_id')}) AS account FROM duplicates WHERE again_seq IS NOT NULL GROUP BY ALL)"""


def _told(spark, d):
    """ingress_seq, origin, account of the records ``duplicates`` tells about."""
    told = table(spark, d, "duplicates").filter(F.col("again_seq").isNotNull()).groupBy(F.col("again_seq").alias("ingress_seq"))
    return told.agg(F.min("again.origin").alias("origin"), F.min(canonical_id("again.account_user_id")).alias("account"))


@query(f"""WITH {POSTS}, {TOLD} SELECT post_id, CASE WHEN coalesce(origin, 'timeline') = 'timeline' AND coalesce(account, author_id) = author_id AND retweet_of_id IS NULL AND created_ms < {CUTOFF} THEN 'skipped' ELSE 'kept' END AS reason
FROM posts LEFT JOIN told USING (ingress_seq)""")
def history_window(spark, d):
    """Old posts the history leaves out. A record nothing is told about stood on its author's own timeline."""
    rows = posts(spark, d).join(_told(spark, d), "ingress_seq", "left")
    origin, account = F.coalesce("origin", F.lit("timeline")), F.coalesce("account", "author_id")
    return rows.select("post_id", ingest.window_reason(origin, account == F.col("author_id"), F.col("retweet_of_id").isNotNull(), F.col("created_ms"), CUTOFF).alias("reason"))


@query(f"""WITH r AS (SELECT ingress_seq, unnest([CASE WHEN {canon('id')} IS NULL THEN 'missing_tweet_id' END, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty_text' END, CASE WHEN {canon('author_id')} IS NULL THEN 'missing_author_id' END,
 CASE WHEN metrics.likes IS NULL THEN 'missing_metric' END, CASE WHEN media IS NULL THEN 'invalid_media' END, CASE WHEN created_at IS NULL OR NOT regexp_matches(created_at, '[0-9]{{4}}') THEN 'invalid_created_at' END]) AS reason FROM ingress)
SELECT ingress_seq, reason FROM r WHERE reason IS NOT NULL""")
def rejection_codes(spark, d):
    tests = {
        "missing_tweet_id": canonical_id("id").isNull(),
        "empty_text": F.trim(F.coalesce("text", F.lit(""))) == "",
        "missing_author_id": canonical_id("author_id").isNull(),
        "missing_metric": F.col("metrics.likes").isNull(),
        "invalid_media": F.col("media").isNull(),
        "invalid_created_at": F.col("created_at").isNull() | ~F.col("created_at").rlike("[0-9]{4}"),
    }
    return table(spark, d, "ingress").select("ingress_seq", F.explode(C.rejection_reasons(tests)).alias("reason"))


_RUN = f"""{POSTS}, {AUTHORS}, full_authors AS (SELECT {canon('id')} AS author_id, following_count, created_at AS joined FROM authors WHERE {canon('id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {canon('id')} ORDER BY received_at DESC NULLS LAST, author_seq) = 1),
run AS (SELECT k.ingress_seq, feed_id, post_id, text, created_ms, epoch_ms(k.received_at) AS seen_at, {canon('k.author_id')} AS aid, line_no, source_file, quoted_tweet_id IS NOT NULL AS q,
 list_filter([CASE WHEN post_id IS NULL THEN 'missing_tweet_id' END, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty_text' END, CASE WHEN created_ms IS NULL THEN 'invalid_created_at' END,
  CASE WHEN metrics.likes IS NULL OR metrics.retweets IS NULL OR metrics.quotes IS NULL OR metrics.replies IS NULL OR metrics.likes < 0 OR metrics.retweets < 0 OR metrics.quotes < 0 OR metrics.replies < 0 THEN 'missing_metric' END,
  CASE WHEN len(list_filter(coalesce(media, []), lambda m: m.url IS NULL OR trim(m.url, ' ') = '' OR coalesce(m.type, '') NOT IN ('image', 'video', 'gif'))) > 0 THEN 'invalid_media' END,
  CASE WHEN a.author_id IS NULL THEN 'missing_author' END, CASE WHEN a.author_id IS NOT NULL AND coalesce(trim(handle, ' '), '') = '' THEN 'missing_author_handle' END,
  CASE WHEN a.author_id IS NOT NULL AND coalesce(trim(display_name, ' '), '') = '' THEN 'missing_author_display_name' END, CASE WHEN a.author_id IS NOT NULL AND (follower_count IS NULL OR following_count IS NULL) THEN 'missing_author_counts' END,
  CASE WHEN a.author_id IS NOT NULL AND joined IS NULL THEN 'missing_author_created_at' END, CASE WHEN a.author_id IS NOT NULL AND verified IS NULL THEN 'missing_author_verification' END], lambda x: x IS NOT NULL) AS reasons
 FROM keyed k LEFT JOIN latest_authors a ON {canon('k.author_id')} = a.author_id LEFT JOIN full_authors f ON {canon('k.author_id')} = f.author_id),
good AS (SELECT *, row_number() OVER (ORDER BY feed_id, source_file, line_no, ingress_seq) AS seq FROM run WHERE len(reasons) = 0),
same AS (SELECT *, text = first_value(text) OVER w AS same, row_number() OVER w AS r FROM good WINDOW w AS (PARTITION BY post_id ORDER BY seq)),
newer AS (SELECT *, max(CASE WHEN same THEN seen_at END) OVER (PARTITION BY post_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM same),
oc AS (SELECT *, CASE WHEN r = 1 THEN 'first' WHEN NOT same THEN 'conflict' WHEN seen_at > newest THEN 'refreshed' ELSE 'duplicate' END AS outcome FROM newer)"""


@query(f"""WITH {_RUN} SELECT 'candidates' AS section, 'timeline' AS key, count(*) AS n FROM run UNION ALL SELECT 'rejected_reason', r, count(*) FROM (SELECT unnest(reasons) AS r FROM run) GROUP BY r
UNION ALL SELECT 'rejected_reason', 'conflicting_tweet_text', count(*) FROM oc WHERE outcome = 'conflict' HAVING count(*) > 0 UNION ALL SELECT 'rejected', 'timeline', (SELECT count(*) FROM run WHERE len(reasons) > 0) + (SELECT count(*) FROM oc WHERE outcome = 'conflict')
UNION ALL SELECT 'accepted', 'timeline', count(*) FROM oc WHERE outcome = 'first' UNION ALL SELECT 'author', aid, count(*) FROM oc WHERE outcome = 'first' GROUP BY aid UNION ALL SELECT 'duplicates', outcome, count(*) FROM oc WHERE outcome IN ('refreshed', 'duplicate') GROUP BY outcome
UNION ALL SELECT 'skipped', '', 0 UNION ALL SELECT 'tombstone_quotes', '', 0 UNION ALL SELECT 'repeated_rows', '', (SELECT count(*) - count(DISTINCT feed_id || ' ' || post_id) FROM good)
UNION ALL SELECT 'oldest', '', min(created_ms) FROM oc WHERE outcome = 'first' UNION ALL SELECT 'newest', '', max(created_ms) FROM oc WHERE outcome = 'first'""")
def normalize_run(spark, d):
    """A whole run over the rows of ingress, written as a provider's pages (a feed is an account, a file a page)."""
    a = latest_authors(spark, d)
    person = F.struct(
        F.col("a_id").alias("id"), F.col("handle").alias("screen_name"), F.col("display_name").alias("name"), F.col("follower_count").alias("followers"), F.col("following_count").alias("following"),
        F.date_format(F.timestamp_millis("joined"), "EEE MMM dd HH:mm:ss Z yyyy").alias("joined"), F.struct("verified").alias("verification"),
    )
    media = F.transform("media", lambda m: F.struct(F.when(m["type"] == "image", "photo").otherwise(m["type"]).alias("type"), m["url"].alias("url")))
    row = F.struct(
        F.lit("status").alias("type"), "id", "text", F.col("created_ms").alias("created_timestamp"), "metrics.likes", F.col("metrics.retweets").alias("reposts"), "metrics.quotes", "metrics.replies",
        F.struct(media.alias("all")).alias("media"), F.when(F.col("a_id").isNotNull(), person).alias("author"),
    )
    known = a.select(F.col("author_id").alias("a_id"), "handle", "display_name", "follower_count", "following_count", "verified", F.col("created_at").alias("joined"))
    rows = timed_ingress(spark, d).join(known, canonical_id("author_id") == F.col("a_id"), "left")
    pages = rows.select(
        F.lpad(F.col("feed_id").cast("string"), 4, "0").alias("account"), F.col("source_file").alias("page"), F.unix_millis("received_at").alias("received_at"), F.col("source_file").alias("raw_file"), F.struct("line_no", "ingress_seq").alias("position"), F.to_json(row).alias("row")
    )
    accounts = table(spark, d, "feeds").select(F.lpad(F.col("feed_id").cast("string"), 4, "0").alias("account"), F.col("feed_id").alias("place"))
    return N.normalise_run(pages, accounts, cutoff_ms=ingest.FIRST_MS).counts


# ---- reports
@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events")
def latency_stats(spark, d):
    return C.latency_report(table(spark, d, "events"), "value")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY event_type")
def run_report(spark, d):
    return C.latency_report(table(spark, d, "events"), "value", ["event_type"])


_K = "CAST(props->>'$.k' AS BIGINT)"
PAGES = f"""pages AS (SELECT user_id AS account, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, CASE WHEN {_K} % 3 = 0 THEN 0 ELSE {_K} END AS n_rows,
 CASE WHEN {_K} % 50 <> 1 THEN concat(event_type, '-', {_K}) END AS cursor, CASE WHEN {_K} % 3 <> 0 THEN epoch_ms(ts) - {_K} * 86400000 END AS authored_ms, CASE WHEN {_K} % 47 = 5 THEN 'provider_error' END AS error FROM events)"""
PAGES_CUTOFF = 1704067200000
OUTCOMES = f"""{PAGES}, m AS (SELECT *, CAST(n_rows = 0 AS INT) AS empty, sum(CAST(n_rows <> 0 AS INT)) OVER (PARTITION BY account ORDER BY page) AS island,
  row_number() OVER (PARTITION BY account, cursor ORDER BY page) > 1 AND cursor IS NOT NULL AS again FROM pages),
c AS (SELECT *, sum(empty) OVER (PARTITION BY account, island ORDER BY page) AS k FROM m),
e AS (SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN cursor IS NULL OR (empty = 1 AND k >= 3) THEN 'cursor_exhausted' WHEN empty = 1 AND again THEN 'cursor_stalled' WHEN empty = 0 AND authored_ms < {PAGES_CUTOFF} THEN 'history_cutoff' WHEN again THEN 'cursor_stalled' END AS reason FROM c),
o AS (SELECT account, arg_min(reason, page) FILTER (reason IS NOT NULL) AS reason, CAST(coalesce(min(page) FILTER (reason IS NOT NULL), max(page)) AS BIGINT) AS pages FROM e GROUP BY account),
outcomes AS (SELECT account, CASE WHEN reason IS NULL THEN 'active' WHEN reason IN ('history_cutoff', 'cursor_exhausted') THEN 'completed' ELSE 'paused' END AS state, reason, pages FROM o)"""


def _pages(spark, d):
    """Events as fetched pages of their users: no rows where k is divisible by 3, no next cursor or an error for some k."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = running(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], {"earlier": ("sum", F.lit(1))})
    return rows.select(
        F.col("user_id").alias("account"),
        (F.col("earlier") + 1).alias("page"),
        F.when(k % 3 == 0, 0).otherwise(k).alias("n_rows"),
        F.when(k % 50 != 1, F.concat_ws("-", "event_type", k.cast("string"))).alias("cursor"),
        F.when(k % 3 != 0, F.unix_millis(F.col("ts").cast("timestamp")) - k * 86400000).alias("authored_ms"),
        F.when(k % 47 == 5, "provider_error").alias("error"),
    )


@query(f"WITH {OUTCOMES} SELECT * FROM outcomes")
def acquire_outcome(spark, d):
    return C.acquisition_outcomes(_pages(spark, d), cutoff_ms=PAGES_CUTOFF)


@query(f"WITH {OUTCOMES} SELECT CASE WHEN bool_or(state IN ('pending', 'active', 'paused')) THEN 'in_progress' WHEN bool_and(state = 'completed') THEN 'completed' ELSE 'partial' END AS status, count(*) AS accounts FROM outcomes")
def acquisition_status(spark, d):
    return C.run_status(C.acquisition_outcomes(_pages(spark, d), cutoff_ms=PAGES_CUTOFF))


@query(f"""WITH {OUTCOMES}, p AS (SELECT pages.*, row_number() OVER (PARTITION BY pages.account ORDER BY page DESC) = 1 AND state = 'completed' AS terminal FROM pages JOIN outcomes o ON pages.account = o.account AND page <= o.pages),
v AS (SELECT (SELECT round(avg(n_rows), 4) FROM p WHERE NOT terminal AND n_rows > 0) AS rows_mean, (SELECT CAST(count(*) FILTER (state = 'paused') AS DOUBLE) FROM outcomes) AS paused, (SELECT quantile_disc(value, 0.95) FROM events) AS p95)
SELECT 'mean rows per non-terminal page' AS name, rows_mean AS value, '10..40' AS bound, rows_mean BETWEEN 10 AND 40 AS passed FROM v
UNION ALL SELECT 'p95 latency ms', round(p95, 4), '<= 5000', p95 <= 5000 FROM v UNION ALL SELECT 'paused accounts', paused, '0', paused = 0 FROM v""")
def run_checks(spark, d):
    """The thresholds of a run that these tables can tell."""
    pages = _pages(spark, d)
    outcomes = C.acquisition_outcomes(pages, cutoff_ms=PAGES_CUTOFF)
    last = outcomes.select("account", F.col("pages").alias("_last"), "state")
    counted = pages.join(last, "account").filter((F.col("page") < F.col("_last")) | ((F.col("page") == F.col("_last")) & (F.col("state") != "completed"))).filter("n_rows > 0")
    mean = counted.agg(F.avg("n_rows")).first()[0]
    paused = outcomes.filter("state = 'paused'").count()
    p95 = C.latency_report(table(spark, d, "events"), "value").first()["p95"]
    known = {"rows_mean": mean, "paused": paused, "latency_p95": p95}
    names = ["requests", "retries", "latency_mean", "latency_p95", "rows_mean", "timeline", "timeline_rejected", "embedded", "embedded_rejected", "repeated_rows", "paused"]
    values = spark.range(1).select(*[F.lit(known.get(n)).cast("double").alias(n) for n in names], F.lit(None).cast("string").alias("status"))
    return C.report_checks(values).filter("name IN ('mean rows per non-terminal page', 'p95 latency ms', 'paused accounts')")


@query(f"""WITH {KEYED}, f AS (SELECT post_id, min(ingress_seq) AS first FROM k GROUP BY post_id)
SELECT source_file, count(*) AS n_rows, count(*) FILTER (ingress_seq = first) AS n_new, count(*) FILTER (ingress_seq <> first) AS n_repeated, count(*) FILTER (text IS NULL OR metrics.likes IS NULL) AS n_missing FROM k JOIN f USING (post_id) GROUP BY source_file""")
def probe_page_stats(spark, d):
    missing = F.col("text").isNull() | F.col("metrics.likes").isNull()
    return C.page_stats(_keyed(spark, d), "source_file", "post_id", "ingress_seq", missing)


@query(f"""WITH {POSTS}, {AUTHORS}, e AS (SELECT author_id AS seed, 'reply' AS kind, reply_to_id AS t FROM posts UNION ALL SELECT author_id, 'quote', quoted_id FROM posts UNION ALL SELECT author_id, 'repost', retweet_of_id FROM posts),
s AS (SELECT seed, kind, p.author_id AS account FROM e JOIN posts p ON e.t = p.post_id WHERE seed <> p.author_id)
SELECT account, handle, count(DISTINCT seed) AS seeds, array_to_string(list_sort(list(DISTINCT seed))[1:{C.SEEDS_LISTED}], ',') AS seed_list, count(*) FILTER (kind = 'reply') AS replies, count(*) FILTER (kind = 'quote') AS quotes, count(*) FILTER (kind = 'repost') AS reposts, count(*) AS total
FROM s LEFT JOIN latest_authors ON account = latest_authors.author_id GROUP BY account, handle HAVING count(DISTINCT seed) >= 2""")
def discover_accounts(spark, d):
    return C.discover_accounts(posts(spark, d), authors=latest_authors(spark, d))


@query(f"""WITH {AUTHORS}, h AS (SELECT {canon('id')} AS author_id, lower(regexp_replace(trim(handle, ' '), '^@', '')) AS handle, author_seq FROM authors),
learnt AS (SELECT handle, arg_max(author_id, author_seq) AS known FROM h WHERE author_id IS NOT NULL AND handle IS NOT NULL GROUP BY handle),
n AS (SELECT NULL AS author_id, lower(m) AS handle FROM (SELECT unnest(entities.mentions) AS m FROM ingress) WHERE m IS NOT NULL)
SELECT coalesce(known, '@' || handle) AS key, count(*) AS mentions FROM n LEFT JOIN learnt USING (handle) GROUP BY ALL""")
def mention_accounts(spark, d):
    """How often each account is mentioned, by id where the handle is known."""
    known = table(spark, d, "authors").select(canonical_id("id").alias("author_id"), A.handle("handle").alias("handle"), F.col("author_seq").alias("seq"))
    named = table(spark, d, "ingress").select(F.explode("entities.mentions").alias("m")).filter("m IS NOT NULL").select(F.lit(None).cast("string").alias("author_id"), F.lower("m").alias("handle"))
    return C.resolve_handles(known, named).groupBy("key").agg(F.count(F.lit(1)).alias("mentions"))


@query(f"""WITH {EVENTS} SELECT request_id, count(DISTINCT chunk_index) AS received, max(chunk_count) AS expected, min(chunk_count) = max(chunk_count) AS consistent,
 min(chunk_count) = max(chunk_count) AND count(DISTINCT chunk_index) = max(chunk_count) AS complete FROM ev WHERE request_id IS NOT NULL GROUP BY request_id""")
def chunk_coverage(spark, d):
    return C.chunk_coverage(_events(spark, d))


_UUIDS = f"SELECT event_seq, nullif(replace(regexp_extract(lower(uuid), '([0-9a-f]{{8}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{12}})', 1), '-', ''), {q('0' * 32)}) AS uuid FROM capture_events WHERE nullif(replace(regexp_extract(lower(uuid), '([0-9a-f]{{8}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{12}})', 1), '-', ''), '') IS NOT NULL AND replace(regexp_extract(lower(uuid), '([0-9a-f]{{8}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{12}})', 1), '-', '') <> {q('0' * 32)}"


@query(_UUIDS)
def event_uuids(spark, d):
    return table(spark, d, "capture_events").select("event_seq", canonical_uuid("uuid").alias("uuid")).filter(F.col("uuid").isNotNull())


# ---- graph and vectors
ITERATIONS = 8


_EDGES = f"""{POSTS}, {AUTHORS}, links AS (SELECT author_id AS src, quoted_id AS t, 3.0 AS w FROM posts UNION ALL SELECT author_id, retweet_of_id, 2.0 FROM posts UNION ALL SELECT author_id, reply_to_id, 1.5 FROM posts),
names AS (SELECT handle, min(author_id) AS dst FROM latest_authors WHERE handle IS NOT NULL GROUP BY handle), said AS (SELECT {canon('author_id')} AS src, lower(unnest(entities.mentions)) AS handle FROM ingress),
every AS (SELECT src, p.author_id AS dst, w FROM links JOIN posts p ON t = p.post_id UNION ALL SELECT src, dst, 1.0 FROM said JOIN names USING (handle)),
e AS (SELECT src, dst, CAST(sum(w) AS DOUBLE) AS w FROM every WHERE src <> dst GROUP BY ALL)"""


def _ranks_sql() -> str:
    base = f"""{_EDGES}, t AS (SELECT src, sum(w) AS total FROM e GROUP BY src), l AS MATERIALIZED (SELECT src, dst, w / total AS share FROM e JOIN t USING (src)),
nodes AS (SELECT node, node NOT IN (SELECT src FROM e) AS dangling FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)), k AS (SELECT count(*) AS n FROM nodes),
r0 AS MATERIALIZED (SELECT node, dangling, 1.0::DOUBLE / n AS rank FROM nodes, k)"""
    for i in range(ITERATIONS):
        base += f""",
r{i + 1} AS MATERIALIZED (SELECT r.node, r.dangling, 0.1 / n + 0.9 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank) FILTER (dangling), 0) FROM r{i}) / n) AS rank
 FROM r{i} r LEFT JOIN (SELECT dst AS node, sum(rank * share) AS got FROM l JOIN r{i} ON src = node GROUP BY dst) g USING (node), k)"""
    return base


def _edges(spark, d):
    mentions = graph.mention_edges(table(spark, d, "ingress").select("author_id", F.col("entities.mentions").alias("mentions")), latest_authors(spark, d))
    return graph.interaction_edges(posts(spark, d), mentions)


@query(f"WITH {_EDGES} SELECT src, dst, w FROM e")
def interaction_edges(spark, d):
    return _edges(spark, d)


@query(f"WITH {_ranks_sql()} SELECT node, round(rank * 1000, 6) AS rank FROM r{ITERATIONS}")
def pagerank(spark, d):
    """Rank of authors by who quotes, reposts, answers and mentions them; in thousandths, after a fixed number of rounds."""
    return graph.pagerank(_edges(spark, d), ITERATIONS, stop=0.0).select("node", F.round(F.col("rank") * 1000, 6).alias("rank"))


@query(f"""WITH {_ranks_sql()}, f AS (SELECT {canon('id')} AS node, follower_count, following_count FROM authors WHERE {canon('id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {canon('id')} ORDER BY received_at DESC NULLS LAST, author_seq) = 1)
SELECT node, round(rank * 1000 * coalesce(least(greatest(follower_count::DOUBLE / greatest(following_count, 1), 0.1), 1.0), 1.0), 6) AS authority FROM r{ITERATIONS} LEFT JOIN f USING (node)""")
def author_authority(spark, d):
    known = latest_authors(spark, d).select(F.col("author_id").alias("node"), "follower_count", "following_count")
    return graph.authority(graph.pagerank(_edges(spark, d), ITERATIONS, stop=0.0), known).select("node", F.round(F.col("authority") * 1000, 6).alias("authority"))


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, vec_id, round(c, 6) AS cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS INTEGER) AS rnk FROM p QUALIFY rnk <= 10""")
def vector_topk(spark, d):
    """The ten nearest rows of every row whose id is divisible by 100."""
    v = table(spark, d, "embeddings")
    return vectors.top_k(v, v.filter("vec_id % 100 = 0"), 10).withColumn("cosine", F.round("cosine", 6))
