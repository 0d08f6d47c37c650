"""Collection quality: page runs, rejections, discovery, reports, chunk coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.operators.prefix import prefix_sums, running

EMPTY_PAGES = 3
SEEDS_LISTED = 100


def rejection_reasons(tests: dict[str, Column]) -> Column:
    """All codes whose test holds, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests.items()]))


#: Why an account stops or pauses.
STOP_REASONS = ("history_cutoff", "cursor_exhausted")
PAUSE_REASONS = ("cursor_stalled", "provider_error", "invalid_response", "identity_mismatch", "profile_not_found", "profile_protected")


def acquisition_outcomes(pages: DataFrame, accounts: DataFrame | None = None, *, cutoff_ms: int, run: int = EMPTY_PAGES) -> DataFrame:
    """account, state, reason, pages (fetched up to the one that decided).

    pages: account, page, n_rows, cursor (to the next page; null: none), authored_ms (newest own row; null: none), error (a
    pause reason; null: none). accounts: account, abandoned; those without pages are pending. Of each account the first page
    decides that ends it: an error; no next cursor; ``run`` empty pages in a row; an empty page whose cursor came before;
    own rows that are all older than the cutoff; any other repeated cursor. Cursors compare with all earlier pages'.
    """
    empty = F.col("n_rows") == 0
    seen = pages.filter(F.col("cursor").isNotNull()).groupBy("account", "cursor").agg(F.min("page").alias("_first"))
    rows = pages.join(seen, ["account", "cursor"], "left").withColumn("_repeated", F.coalesce(F.col("_first") < F.col("page"), F.lit(False)))
    rows = running(rows.drop("_first"), ["account"], ["page"], {"_empties": ("sum", empty.cast("long"))})  # of all earlier pages
    rows = running(rows, ["account"], ["page"], {"_settled": ("max", F.when(~empty, F.col("_empties")))})  # of those before the last full one
    in_a_row = F.col("_empties") + 1 - F.coalesce("_settled", F.lit(0))
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("cursor").isNull() | (empty & (in_a_row >= run)), "cursor_exhausted")
        .when(empty & F.col("_repeated"), "cursor_stalled")
        .when(~empty & (F.col("authored_ms") < cutoff_ms), "history_cutoff")
        .when(F.col("_repeated"), "cursor_stalled")
    )
    ended = rows.withColumn("reason", reason).groupBy("account").agg(F.max("page").alias("last"), F.min(F.when(F.col("reason").isNotNull(), F.struct("page", "reason"))).alias("end"))
    state = F.when(F.col("end.reason").isNull(), "active").when(F.col("end.reason").isin(*STOP_REASONS), "completed").otherwise("paused")
    out = ended.select("account", state.alias("state"), "end.reason", F.coalesce("end.page", "last").alias("pages"))
    if accounts is None:
        return out
    joined = accounts.select("account", F.coalesce("abandoned", F.lit(False)).alias("abandoned")).join(out, "account", "left")
    return joined.select("account", F.when(F.col("abandoned"), "abandoned").otherwise(F.coalesce("state", F.lit("pending"))).alias("state"), "reason", F.coalesce("pages", F.lit(0)).alias("pages"))


def run_status(outcomes: DataFrame) -> DataFrame:
    """status, accounts: in_progress while an account is open; completed or abandoned if all are; else partial."""
    opened = F.bool_or(F.col("state").isin("pending", "active", "paused"))
    every = lambda state: F.bool_and(F.col("state") == state)
    status = F.when(opened, "in_progress").when(every("completed"), "completed").when(every("abandoned"), "abandoned").otherwise("partial")
    return outcomes.agg(status.alias("status"), F.count(F.lit(1)).alias("accounts"))


def page_stats(rows: DataFrame, page: str, key: str, seq: str, missing: Column) -> DataFrame:
    """Per page: rows, ids seen for the first time, repeated ones, rows that lack something."""
    first = rows.groupBy(key).agg(F.min(seq).alias(seq), F.lit(1).alias("fresh"))
    joined = rows.join(first, [key, seq], "left")
    return joined.groupBy(page).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_new"),
        (F.count(F.lit(1)) - F.coalesce(F.sum("fresh"), F.lit(0))).cast("long").alias("n_repeated"),
        F.count_if(missing).alias("n_missing"),
    )


def latency_report(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, p50, p95 (nearest rank) and max per group. Equal values are counted first, and ranks come from running sums
    over the distinct values, so no task holds them all."""
    by = by or []
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    keys = ["_all", *by]
    counts = counts.withColumn("_all", F.lit(1))
    placed = prefix_sums(counts, keys, ["_v"], "_c")
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.round(F.sum(F.col("_v") * F.col("_c")) / F.sum("_c"), 6).alias("mean"), F.max("_v").alias("max"))
    named = totals.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "n", "mean", "max")
    joined = placed.join(named, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)])
    at = lambda q: F.min(F.when(F.col("before") + F.col("_c") >= F.ceil(F.col("n") * q), F.col("_v")))
    return joined.groupBy(*by).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("max").alias("max"))


#: The checks of a run's report and their bounds.
CHECKS = (
    ("timeline rejection rate", "<= 1%"),
    ("embedded rejection rate", "n/a"),
    ("repeated timeline rows within account", "<= 15%"),
    ("mean rows per non-terminal page", "10..40"),
    ("mean latency ms", "500..3000"),
    ("p95 latency ms", "<= 5000"),
    ("retry rate", "< 5%"),
    ("paused accounts", "0"),
    ("acquisition status", "completed"),
)


def report_checks(values: DataFrame) -> DataFrame:
    """name, value, bound, passed (null: reported only, or nothing to judge) of a run. values: one row of requests, retries,
    latency_mean, latency_p95, rows_mean (per page that isn't an account's last), timeline, timeline_rejected, embedded,
    embedded_rejected, repeated_rows, paused, status."""
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 4)
    number = lambda c: F.round(F.col(c).cast("double"), 4)
    found = [
        rate("timeline_rejected", "timeline"),
        rate("embedded_rejected", "embedded"),
        rate("repeated_rows", "timeline"),
        number("rows_mean"),
        number("latency_mean"),
        number("latency_p95"),
        rate("retries", "requests"),
        number("paused"),
        F.when(F.col("status") == "completed", 1.0).otherwise(0.0),
    ]
    held = {"<= 1%": lambda x: x <= 0.01, "<= 15%": lambda x: x <= 0.15, "10..40": lambda x: x.between(10, 40), "500..3000": lambda x: x.between(500, 3000), "<= 5000": lambda x: x <= 5000, "< 5%": lambda x: x < 0.05, "0": lambda x: x == 0, "completed": lambda x: x == 1}
    passed = lambda bound, x: held[bound](x) if bound in held else F.lit(None).cast("boolean")
    each = [F.struct(F.lit(name).alias("name"), x.alias("value"), F.lit(bound).alias("bound"), passed(bound, x).alias("passed")) for (name, bound), x in zip(CHECKS, found, strict=True)]
    return values.select(F.inline(F.array(*each)))


def resolve_handles(seen: DataFrame, named: DataFrame) -> DataFrame:
    """``named`` (author_id, handle; either may be null) with the ids the pages teach (``seen``: author_id, handle, seq; the
    latest of a handle counts): key is the id, else the handle, so what is known by handle only joins its id once learnt."""
    learnt = seen.filter(F.col("author_id").isNotNull() & F.col("handle").isNotNull()).groupBy("handle").agg(F.max_by("author_id", "seq").alias("_id"))
    out = named.join(learnt, "handle", "left").withColumn("author_id", F.coalesce("author_id", "_id")).drop("_id")
    return out.withColumn("key", F.coalesce("author_id", F.concat(F.lit("@"), "handle")))


def discover_accounts(posts: DataFrame, min_seeds: int = 2, authors: DataFrame | None = None) -> DataFrame:
    """account, handle, seeds, seed_list (in order), replies, quotes, reposts, total: accounts whose posts other authors answer,
    quote or repost.

    Distinct seeds are counted over (account, seed) groups, which combine before the shuffle. The list holds at most
    ``SEEDS_LISTED`` seeds, the first in order; ``seeds`` counts all.
    """
    links = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("target")) for k, c in (("reply", "reply_to_id"), ("quote", "quoted_id"), ("repost", "retweet_of_id"))])
    edges = posts.filter(F.col("author_id").isNotNull()).select(F.col("author_id").alias("seed"), F.explode(links).alias("l")).select("seed", "l.kind", "l.target").filter(F.col("target").isNotNull())
    owners = posts.select(F.col("post_id").alias("target"), F.col("author_id").alias("account")).filter(F.col("account").isNotNull())
    seen = edges.join(owners, "target").filter(F.col("seed") != F.col("account"))
    per = seen.groupBy("account", "seed").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("reply", "quote", "repost")])
    counts = [F.count(F.lit(1)).alias("seeds"), F.sum("reply").alias("replies"), F.sum("quote").alias("quotes"), F.sum("repost").alias("reposts")]
    out = per.groupBy("account").agg(*counts).filter(F.col("seeds") >= min_seeds)
    first = Window.partitionBy("account").orderBy("seed")
    few = per.select("account", "seed").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SEEDS_LISTED)
    lists = few.groupBy("account").agg(F.array_join(F.array_sort(F.collect_list("seed")), ",").alias("seed_list"))
    out = out.join(lists, "account").withColumn("total", F.col("replies") + F.col("quotes") + F.col("reposts"))
    names = authors.select(F.col("author_id").alias("account"), "handle") if authors is not None else None
    return out.join(names, "account", "left") if names is not None else out.withColumn("handle", F.lit(None).cast("string"))


def chunk_coverage(events: DataFrame) -> DataFrame:
    """request_id, received, expected, consistent, complete from request_id, chunk_index, chunk_count."""
    once = events.filter(F.col("request_id").isNotNull()).groupBy("request_id", "chunk_index").agg(F.min("chunk_count").alias("lo"), F.max("chunk_count").alias("hi"))
    out = once.groupBy("request_id").agg(F.count("chunk_index").alias("received"), F.min("lo").alias("lo"), F.max("hi").alias("expected"))
    same = F.col("lo") == F.col("expected")
    return out.select("request_id", "received", "expected", same.alias("consistent"), (same & (F.col("received") == F.col("expected"))).alias("complete"))


def author_share(posts: DataFrame) -> DataFrame:
    """author_id, n, share of all posts."""
    n = posts.groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))
    whole = posts.count()
    return n.withColumn("share", F.round(F.col("n") / whole, 6))
