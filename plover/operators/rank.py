"""Scoring and ordering of search candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.functions.text import BIGRAM

K1, B = 0.3, 0.0
#: Weights of the six signals.
W_REL, W_ENG, W_AUTH, W_REC, W_FB, W_FIT = 0.35, 0.20, 0.10, 0.15, 0.10, 0.10
TAU_TOP_MS, TAU_LATEST_MS = 48 * 3600000, 6 * 3600000
VOTE_CLAMP = 5
FIT_MEDIA, FIT_PHRASE, FIT_SHOULD = 0.5, 0.3, 0.2
RRF_K = 60


def idf(df: Column, total: int) -> Column:
    return F.log((F.lit(float(total)) - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, df: Column, total: int, k1: float = K1, b: float = B, length: Column | None = None, mean_length: float = 1.0) -> Column:
    norm = F.lit(k1 * (1 - b)) if length is None else F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / F.lit(mean_length))
    return idf(df, total) * tf * (k1 + 1) / (tf + norm)


def relevance(hits: DataFrame, dfs: DataFrame, total: int) -> DataFrame:
    """post_id, rel: BM25 summed over matched terms, pairs left out. hits: post_id, term, tf."""
    plain = hits.filter(~F.col("term").startswith(BIGRAM)).join(dfs, "term")
    return plain.groupBy("post_id").agg(F.sum(bm25(F.col("tf"), F.col("df"), total)).alias("rel"))


def rrf(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """post_id, rrf from (post_id, rnk) rows of several lists; rnk starts at 1."""
    return ranked.groupBy("post_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rnk"))).alias("rrf"))


def six_signals(candidates: DataFrame, now_ms: int | str, sort: str = "top", by: list[str] | None = None, tau: str | None = None) -> DataFrame:
    """The parts and the score of each candidate, normalised by the maximum within its query (``by``).

    candidates: rel, like_count, reply_count, retweet_count, quote_count, propagated_boost, author_authority,
    created_at, feedback_votes, fit. Missing counts, boosts, authority and votes are 0, a missing time is now. ``now_ms`` and
    ``tau`` may be SQL text over the candidates.
    """
    zero = lambda c: f"coalesce(nanvl(CAST({c} AS DOUBLE), 0D), 0D)"
    weighted = f"{zero('like_count')} + 2 * {zero('reply_count')} + 3 * {zero('retweet_count')} + 4 * {zero('quote_count')}"
    whole = f"OVER (PARTITION BY {', '.join(by or ['1'])})"
    top = lambda c: f"greatest(max({c}) {whole}, 1e-9D)"
    tau = tau or str(TAU_LATEST_MS if sort == "latest" else TAU_TOP_MS)
    parts = {
        "p_rel": f"{W_REL}D * rel / {top('rel')}",
        "p_eng": f"{W_ENG}D * _eng / {top('_eng')}",
        "p_auth": f"{W_AUTH}D * _auth / {top('_auth')}",
        "p_rec": f"{W_REC}D * exp(-CAST(greatest(0, {now_ms} - coalesce(created_at, {now_ms})) AS DOUBLE) / ({tau}))",
        "p_fb": f"{W_FB}D * least(greatest({zero('feedback_votes')}, -{VOTE_CLAMP}D), {VOTE_CLAMP}D) / {VOTE_CLAMP}",
        "p_fit": f"{W_FIT}D * fit",
    }
    raw = candidates.selectExpr("*", f"log1p({weighted} + greatest(0D, {zero('propagated_boost')})) AS _eng", f"greatest(0D, {zero('author_authority')}) AS _auth")
    out = raw.selectExpr("* EXCEPT (_eng, _auth)", *[f"{e} AS {c}" for c, e in parts.items()])
    return out.selectExpr("*", f"{' + '.join(parts)} AS score")


def chain_key(item: str, *links: str) -> Column:
    """Posts that repost or quote the same post are one chain."""
    return F.coalesce(*[F.col(c) for c in links], F.col(item))


def final_order(item: str, sort: str = "top") -> list[Column]:
    """Exact matches first; then coverage and score, or time and score; then the id."""
    exact = F.when(F.col("matched_via") == "L0", 0).otherwise(1)
    if sort == "latest":
        return [exact, F.desc("created_at"), F.desc("score"), F.asc(item)]
    return [exact, F.desc("cover"), F.desc("score"), F.asc(item)]


def best_of_chains(scored: DataFrame, item: str, by: list[str], sort: str = "top") -> DataFrame:
    """One row per chain (column ``chain``): the one the final order puts first."""
    w = Window.partitionBy(*by, "chain").orderBy(*final_order(item, sort))
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_pinned(pinned: DataFrame, tail: DataFrame, window: int = 200, by: list[str] | None = None) -> DataFrame:
    """post_id, section, pos: pinned rows stay where they were shown; the tail loses their ids and their chains.

    pinned: post_id, chain, shown (position); tail: post_id, chain, rnk. With ``by``, columns of both, each group is a
    page of its own, with its own ``window``, and its columns come first.
    """
    by = by or []
    page = by or [F.lit(1)]
    first = Window.partitionBy(*by, "post_id").orderBy("shown")
    shown = Window.partitionBy(*page).orderBy("shown")
    kept = pinned.withColumn("_n", F.row_number().over(first)).filter("_n = 1").withColumn("pos", F.row_number().over(shown)).filter(F.col("pos") <= window)

    def joined(rows: DataFrame, other: DataFrame, how: str, *keys: str) -> DataFrame:
        named = other.withColumnsRenamed({c: f"_{c}" for c in [*by, *keys]})
        on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] + [F.col(k) == F.col(f"_{k}") for k in keys]
        return rows.join(named, on or F.lit(True), how)

    rest = joined(joined(tail, kept.select(*by, "post_id"), "left_anti", "post_id"), kept.select(*by, "chain"), "left_anti", "chain")
    counted = joined(rest, kept.groupBy(*by).agg(F.count(F.lit(1)).alias("_pinned")), "left")
    numbered = counted.withColumn("pos", (F.row_number().over(Window.partitionBy(*page).orderBy("rnk")) + F.coalesce("_pinned", F.lit(0))).cast("int"))
    return kept.select(*by, "post_id", F.lit("pinned").alias("section"), "pos").unionByName(numbered.select(*by, "post_id", F.lit("tail").alias("section"), "pos"))
