"""Write-side operators: decoding, gates, upserts, deduplication with refresh, votes, ledgers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.functions.ids import canonical_id
from plover.operators.drift import json_object
from plover.operators.prefix import running

FIRST_MS = 1136073600000
AHEAD_MS = 5 * 60000
SECONDS_BELOW = 1_000_000_000_000
#: Size gates of exported events, in bytes.
LINE_BYTES, ENVELOPE_BYTES = 1_000_000, 200_000
VOTES_PER_WINDOW, WINDOW_S = 30, 60

INGRESS = (
    "kind string, id string, text string, authorId string, createdAt long, metrics struct<likes: long, retweets: long, quotes: long, replies: long>, metricsAt long, "
    "media array<struct<type: string, url: string>>, quotedTweetId string, retweetOfTweetId string, inReplyToTweetId string, lang string, "
    "entities struct<hashtags: array<string>, mentions: array<string>, urls: array<string>>, handle string, displayName string, "
    "followerCount long, followingCount long, verified boolean, bio string, avatarUrl string"
)
#: The contract of each kind of line: key -> what it must hold (a ? allows null; keys with ! may be absent).
_TEXT, _WHOLE, _COUNT = "STRING", "BIGINT", "COUNT"
CONTRACT = {
    "tweet": {
        "kind": _TEXT, "id": _TEXT, "text": _TEXT, "authorId": _TEXT, "createdAt": _WHOLE, "metrics": "METRICS", "metricsAt": _WHOLE, "media": "MEDIA",
        "quotedTweetId": "STRING?", "retweetOfTweetId": "STRING?", "inReplyToTweetId": "STRING?", "lang": "STRING?!", "entities": "OBJECT?!",
    },
    "author": {
        "kind": _TEXT, "id": _TEXT, "handle": _TEXT, "displayName": _TEXT, "followerCount": _COUNT, "followingCount": _COUNT, "verified": "BOOLEAN", "createdAt": _WHOLE,
        "bio": "STRING?!", "avatarUrl": "STRING?!",
    },
}


def json_kind(path: str) -> str:
    """SQL text: the JSON type at a path of the variant ``o`` (STRING, BIGINT, OBJECT<..>, ...; VOID for null; null if absent)."""
    return f"schema_of_variant(try_variant_get(o, '{path}', 'variant'))"


def _count(path: str) -> str:
    return f"coalesce({json_kind(path)} = 'BIGINT' AND try_variant_get(o, '{path}', 'bigint') >= 0, false)"


def _holds(key: str, rule: str) -> str:
    kind, base = json_kind(f"$.{key}"), rule.rstrip("?!")
    if base == "COUNT":
        test = _count(f"$.{key}")
    elif base == "METRICS":
        test = " AND ".join(_count(f"$.{key}.{m}") for m in ("likes", "retweets", "quotes", "replies"))
    elif base == "MEDIA":
        items = f"try_variant_get(o, '$.{key}', 'array<struct<type: string, url: string>>')"
        test = f"coalesce({kind} LIKE 'ARRAY%' AND forall({items}, m -> coalesce(m.type IN ('image', 'video', 'gif') AND m.url IS NOT NULL, false)), false)"
    else:
        test = f"coalesce({kind} LIKE '{base}%', false)"
    if "?" in rule:
        test = f"({test} OR coalesce({kind} = 'VOID', false))"
    if "!" in rule:
        test = f"({test} OR {kind} IS NULL)"
    return test


def decode_ingress(lines: DataFrame, line: str = "line") -> DataFrame:
    """The tagged union of post and author lines, decoded with its fixed schema (``r``); ``reason`` says why a line is refused:
    blank, broken, unknown_kind, unknown_key, or bad_<key> for the first key that is missing or of a wrong type."""
    parsed = lines.withColumn("o", json_object(line)).withColumn("r", F.from_json(line, INGRESS))
    kind = F.expr("try_variant_get(o, '$.kind', 'string')")
    reason = F.when(F.trim(line) == "", "blank").when(F.col("o").isNull(), "broken").when(F.coalesce(~kind.isin(*CONTRACT), F.lit(True)), "unknown_kind")
    for name, keys in CONTRACT.items():
        reason = reason.when((kind == name) & (F.size(F.array_except(F.json_object_keys(line), F.array(*[F.lit(k) for k in keys]))) > 0), "unknown_key")
        for key, rule in keys.items():
            reason = reason.when((kind == name) & ~F.expr(_holds(key, rule)), f"bad_{key}")
    return parsed.withColumn("reason", reason).drop("o")


def gate_reason(text: str, at: list[str], now_ms: int) -> Column:
    """Why a post may not enter: empty text, or a time outside (2006, now + 5 minutes]."""
    inside = lambda c: (F.col(c) > FIRST_MS) & (F.col(c) <= now_ms + AHEAD_MS)
    reason = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty_text")
    for c in at:
        reason = reason.when(~F.coalesce(inside(c), F.lit(False)), f"bad_{c}")
    return reason


def line_gate(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` plus reason (ok, envelope_too_large, line_too_long; by UTF-8 bytes) and, of lines too long, their sha256."""
    size = F.coalesce(F.octet_length(line), F.lit(0))
    reason = F.when(size > LINE_BYTES, "line_too_long").when(size > ENVELOPE_BYTES, "envelope_too_large").otherwise("ok")
    return lines.withColumn("reason", reason).withColumn("sha256", F.when(size > LINE_BYTES, F.sha2(line, 256)))


def window_reason(origin: Column, own: Column, reposted: Column, created_ms: Column, cutoff_ms: int) -> Column:
    """skipped or kept: what an account itself wrote on its timeline, replies too, is subject to the window; embedded
    posts, reposts and posts of others aren't."""
    subject = (origin == "timeline") & own & ~reposted
    return F.when(F.coalesce(subject & (created_ms < cutoff_ms), F.lit(False)), "skipped").otherwise("kept")


#: What the known keys of a tolerant line may hold beside null; unknown keys are fine.
_LOOSE_TEXT = ("type", "id", "text", "author_id", "authorId", "author_handle", "authorHandle", "lang", "quoted_tweet_id", "quotedTweetId", "retweet_of_tweet_id", "retweetOfTweetId", "in_reply_to_tweet_id", "inReplyToTweetId",
    "author.id", "author.screen_name", "author.name", "author.description", "author.avatar_url", "quote.id", "reposted_status.id", "replying_to.status")
_LOOSE_COUNT = ("likes", "reposts", "retweets", "quotes", "replies", "metrics.likes", "metrics.retweets", "metrics.quotes", "metrics.replies", "author.followers", "author.following")
_LOOSE_WHOLE = ("created_timestamp", "metrics_at", "metricsAt", "author.joined_ms")
_LOOSE_OBJECT = ("metrics", "author", "media", "quote", "reposted_status", "replying_to", "author.verification")


def decode_loose(lines: DataFrame, line: str) -> DataFrame:
    """Posts from tolerant JSON: names have aliases, counts the first that is given, times may be seconds; an author record if
    one is nested. ``reason``: broken, strict (the line has a kind: ``decode_ingress`` reads it), bad_type, missing_post_id,
    empty_text, tombstone, missing_author_id, missing_created_ms."""
    o = lines.withColumn("o", json_object(line))
    first = lambda kind, *paths: "coalesce(" + ", ".join(f"try_variant_get(o, '$.{p}', '{kind}')" for p in paths) + ")"
    text = lambda *paths: F.expr(first("string", *paths))
    whole = lambda p: f"CASE WHEN {json_kind('$.' + p)} = 'BIGINT' THEN try_variant_get(o, '$.{p}', 'bigint') END"
    number = lambda *paths: F.expr("coalesce(" + ", ".join(map(whole, paths)) + ")")
    given = lambda c: F.when(c != "", c)
    ms = lambda c: F.when((c > 0) & (c < SECONDS_BELOW), c * 1000).otherwise(c)
    count = lambda *paths: F.coalesce(number(*paths), F.lit(0)).alias(paths[0])
    fits = lambda p, ok: f"coalesce({json_kind('$.' + p)} RLIKE '^({ok}|VOID)', true)"
    sound = [fits(p, "STRING") for p in _LOOSE_TEXT] + [fits(p, "BIGINT") for p in _LOOSE_WHOLE] + [fits(p, "OBJECT") for p in _LOOSE_OBJECT]
    sound += [f"({json_kind('$.' + p)} IS NULL OR {json_kind('$.' + p)} = 'VOID' OR {_count('$.' + p)})" for p in _LOOSE_COUNT]
    sound += [fits("media.all", "ARRAY"), fits("author.verification.verified", "BOOLEAN")]
    media = F.expr("try_variant_get(o, '$.media.all', 'array<struct<type: string, url: string>>')")
    kind = lambda t: F.when(F.lower(t).isin("image", "photo"), "image").when(F.lower(t) == "video", "video").when(F.lower(t).isin("gif", "animated_gif"), "gif")
    typed = F.transform(media, lambda m: F.struct(kind(m["type"]).alias("type"), m["url"].alias("url")))
    created = ms(number("created_at", "createdAt", "created_timestamp"))
    author_id, handle = given(text("author_id", "authorId", "author.id")), text("author_handle", "authorHandle", "author.screen_name")
    out = o.withColumns(
        {
            "post_id": canonical_id(text("id")),
            "text": F.trim(text("text")),
            "author_id": canonical_id(author_id),
            "handle": F.coalesce(handle, author_id),
            "created_ms": created,
            "likes": count("likes", "metrics.likes"),
            "reposts": count("reposts", "retweets", "metrics.retweets"),
            "quotes": count("quotes", "metrics.quotes"),
            "replies": count("replies", "metrics.replies"),
            "metrics_at": F.coalesce(ms(number("metrics_at", "metricsAt")), created),
            "media": F.coalesce(F.filter(typed, lambda m: m["type"].isNotNull() & (m["url"] != "")), F.array().cast("array<struct<type: string, url: string>>")),
            "quoted_id": canonical_id(text("quoted_tweet_id", "quotedTweetId", "quote.id")),
            "retweet_of_id": canonical_id(text("retweet_of_tweet_id", "retweetOfTweetId", "reposted_status.id")),
            "reply_to_id": canonical_id(text("in_reply_to_tweet_id", "inReplyToTweetId", "replying_to.status")),
            "lang": text("lang"),
        }
    )
    nested = F.struct(
        "author_id",
        "handle",
        F.coalesce(text("author.name"), "handle").alias("display_name"),
        F.coalesce(number("author.followers"), F.lit(0)).alias("follower_count"),
        F.coalesce(number("author.following"), F.lit(0)).alias("following_count"),
        F.coalesce(F.expr("try_variant_get(o, '$.author.verification.verified', 'boolean')"), F.lit(False)).alias("verified"),
        F.coalesce(number("author.joined_ms"), "created_ms").alias("created_ms"),
        text("author.description").alias("bio"),
        text("author.avatar_url").alias("avatar_url"),
    )
    out = out.withColumn("author", F.when(F.expr(f"coalesce({json_kind('$.author')} LIKE 'OBJECT%', false)"), nested))
    reason = (
        F.when(F.col("o").isNull(), "broken")
        .when(F.expr(f"{json_kind('$.kind')} IS NOT NULL"), "strict")
        .when(~F.expr(" AND ".join(sound)), "bad_type")
        .when(F.col("post_id").isNull(), "missing_post_id")
        .when(F.coalesce("text", F.lit("")) == "", "empty_text")
        .when(F.coalesce(text("type") == "tombstone", F.lit(False)), "tombstone")
        .when(F.col("author_id").isNull(), "missing_author_id")
        .when(F.col("created_ms").isNull(), "missing_created_ms")
    )
    return out.withColumn("media_type", F.coalesce(F.get("media", F.lit(0))["type"], F.lit("none"))).withColumn("reason", reason).drop("o")


def upsert_actions(rows: DataFrame, key: str, seq: str, at: str) -> DataFrame:
    """Per row, in order of ``seq``: inserted, updated (strictly newer than all before) or skipped. A key may hold any share of the rows."""
    before = running(rows, [key], [seq], {"_n": ("sum", F.lit(1)), "_newest": ("max", F.col(at))})
    action = F.when(F.col("_n") == 0, "inserted").when(F.col("_newest").isNull() & F.col(at).isNotNull() | (F.col(at) > F.col("_newest")), "updated").otherwise("skipped")
    return before.withColumn("action", action).drop("_n", "_newest")


def latest_by(rows: DataFrame, key: str, at: str, seq: str, columns: list[str]) -> DataFrame:
    """The newest row per key (of equally new ones the first), as one aggregate: no window, no sort."""
    order = F.struct(F.col(at).alias("t"), (-F.col(seq)).alias("s"))
    kept = rows.filter(F.col(at).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return kept.select(key, "r.*")


def dedup_with_refresh(rows: DataFrame, key: str, seq: str, text: str, at: str) -> DataFrame:
    """Per row: first, conflict (another text than the first), refreshed (newer than all agreeing rows before) or duplicate.

    A conflicting row counts for nothing: it neither refreshes nor moves the newest time. The first text of a key is one
    aggregate, the newest time before a row a running maximum: a key may hold any share of the rows.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(seq).alias("_first"), F.min_by(F.sha2(said, 256), seq).alias("_said"))
    joined = rows.join(first, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn("_same", F.sha2(said, 256) == F.col("_said"))
    before = running(joined.drop("_said"), [key], [seq], {"_newest": ("max", F.when(F.col("_same"), F.col(at)))})
    outcome = F.when(F.col(seq) == F.col("_first"), "first").when(~F.col("_same"), "conflict").when(F.col(at) > F.col("_newest"), "refreshed").otherwise("duplicate")
    return before.withColumn("outcome", outcome).drop("_same", "_first", "_newest")


def vote_totals(votes: DataFrame) -> DataFrame:
    """post_id, total: one live vote per (query_key, voter, post_id), the latest by seq; anonymous votes don't count."""
    live = votes.filter(F.col("voter").isNotNull()).groupBy("query_key", "voter", "post_id").agg(F.max_by("vote", "seq").alias("vote"))
    return live.groupBy("query_key", "post_id").agg(F.sum("vote").cast("long").alias("total"))


def ordered_fold(rows: DataFrame, key: list[str], order: list[str], schema: str, start: Callable, step: Callable) -> DataFrame:
    """Run a sequential fold over each key's rows in order: ``step(state, row) -> (state, output tuple)``.

    Keys are hashed to partitions and rows sorted inside them; batches stream through with one state in memory, so a
    key of any size is folded without being gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, now, state = [c.split()[0] for c in schema.split(", ")], object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                mine = tuple(getattr(row, k) for k in key)
                if mine != now:
                    now, state = mine, start()
                state, result = step(state, row)
                out.append(result)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


@dataclass
class Voter:
    """A voter's standing votes and the window their writes are counted in."""

    standing: dict[str, int] = field(default_factory=dict)
    opened: int | None = None
    n: int = 0

    def cast(self, subject: str, vote: int, at_s: int, limit: int = VOTES_PER_WINDOW, window_s: int = WINDOW_S) -> bool:
        """Whether a vote gets through. A repeat of the standing vote changes nothing and is free; a window opens with the
        first write and lasts ``window_s``."""
        if self.standing.get(subject) == vote:
            return True
        if self.opened is None or at_s - self.opened >= window_s:
            self.opened, self.n = at_s, 0
        if self.n >= limit:
            return False
        self.n += 1
        self.standing[subject] = vote
        return True


def vote_subject(votes: DataFrame) -> Column:
    """What a vote is on: a post under a query, or a post alone."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in ("query_key", "post_id") if c in votes.columns])


def rate_limited_votes(votes: DataFrame, limit: int = VOTES_PER_WINDOW, window_s: int = WINDOW_S) -> DataFrame:
    """voter, seq, accepted. votes: voter, post_id (and query_key), vote, at_s (seconds), seq. A voter's votes are sequential by
    nature: they stream in order through one task, which keeps their standing votes."""

    def step(voter: Voter, row) -> tuple[Voter, tuple]:
        ok = voter.cast(row.subject, row.vote, row.at_s, limit, window_s)
        return voter, (row.voter, row.seq, ok)

    rows = votes.select("voter", vote_subject(votes).alias("subject"), "vote", "at_s", "seq")
    return ordered_fold(rows, ["voter"], ["at_s", "seq"], "voter long, seq long, accepted boolean", Voter, step)


def ledger(snapshots: DataFrame) -> DataFrame:
    """key, seq, outcome of snapshots (key, seq, at, content, text) in order of arrival.

    new; older: duplicate; same content: advanced (newer) or duplicate; same time, other content: conflict; other text:
    quarantined; else updated.
    """

    def step(state: dict, row) -> tuple[dict, tuple]:
        if not state:
            return {"at": row.at, "content": row.content, "text": row.text}, (row.key, row.seq, "new")
        if row.at < state["at"]:
            return state, (row.key, row.seq, "duplicate")
        if row.content == state["content"]:
            outcome = "advanced" if row.at > state["at"] else "duplicate"
            state["at"] = row.at
            return state, (row.key, row.seq, outcome)
        if row.at == state["at"]:
            return state, (row.key, row.seq, "conflict")
        if row.text != state["text"]:
            return state, (row.key, row.seq, "quarantined")
        return {"at": row.at, "content": row.content, "text": row.text}, (row.key, row.seq, "updated")

    return ordered_fold(snapshots, ["key"], ["seq"], "key string, seq long, outcome string", dict, step)


def unnest_quotes(rows: DataFrame, key: str, text: str, depth: int = 32) -> DataFrame:
    """root, depth, post_id of a post and the posts quoted inside it, at most ``depth`` deep."""
    o = rows.select(F.col(key).alias("root"), json_object(text).alias("o"))
    found = F.array(*[F.expr(f"try_variant_get(o, '$.{'quote.' * i}id', 'string')") for i in range(depth)])
    return o.select("root", F.posexplode(found).alias("depth", "post_id")).filter(F.col("post_id").isNotNull())
