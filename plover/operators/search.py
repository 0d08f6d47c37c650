"""Retrieval: capped reads, verification, and the candidates' signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.functions import text as X
from plover.operators import index as I
from plover.operators import rank as R


def hard_filters(filters: dict, author: str = "author_id") -> Column:
    """The filters that never relax: author, [since, until), media, likes, language."""
    keep = F.lit(True)
    if filters.get("authorId") is not None:
        keep &= F.col(author) == filters["authorId"]
    if filters.get("since") is not None:
        keep &= F.col("created_ms") >= filters["since"]
    if filters.get("until") is not None:
        keep &= F.col("created_ms") < filters["until"]
    if filters.get("media") is not None:
        keep &= F.col("media_type") == filters["media"]
    if filters.get("minLikes") is not None:
        keep &= F.col("likes") >= filters["minLikes"]
    if filters.get("lang") is not None:
        keep &= F.col("lang") == filters["lang"]
    return F.coalesce(keep, F.lit(False))


def text_predicate(*, gates=(), exclude=(), phrases=(), any_terms=(), any_phrases=()) -> Column:
    """The one predicate that verifies a post against its text (columns tokens_all, present)."""
    keep = F.lit(True)
    for g in gates:
        keep &= F.array_contains("present", g)
    if exclude:
        keep &= ~F.arrays_overlap("tokens_all", F.array(*[F.lit(x) for x in exclude]))
    for p in phrases:
        keep &= X.has_phrase(F.col("tokens_all"), p)
    if any_terms or any_phrases:
        one = F.arrays_overlap("tokens_all", F.array(*[F.lit(x) for x in any_terms])) if any_terms else F.lit(False)
        for p in any_phrases:
            one |= X.has_phrase(F.col("tokens_all"), p)
        keep &= one
    return F.coalesce(keep, F.lit(False))


def feedback_terms(tokenized_top: DataFrame, query_terms: list[str], most: int = 5) -> DataFrame:
    """term, n: the words that most of the top posts share, beyond the query's own."""
    words = X.exploded(tokenized_top, F.array_distinct("tokens"), "post_id")
    wanted = ~F.col("term").isin(query_terms or [""]) & (F.length("term") >= 3) & ~F.col("term").startswith("~")
    return words.filter(wanted).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").orderBy(F.desc("n"), "term").limit(most)


def suggest_terms(dfs: DataFrame, prefix: str, shown: int = 10, probed: int = 50) -> DataFrame:
    """Terms that start so: the first ``probed`` in order, by df. Pairs and aspects are no words."""
    first = dfs.filter(F.col("term").startswith(prefix) & ~F.col("term").startswith(X.BIGRAM) & ~F.col("term").startswith("~")).orderBy("term").limit(probed)
    return first.orderBy(F.desc("df"), "term").limit(shown).select("term", "df")


def suggest_authors(authors: DataFrame, prefix: str, shown: int = 10, probed: int = 20) -> DataFrame:
    first = authors.filter(F.col("handle").startswith(prefix)).orderBy("handle", "author_id").limit(probed)
    return first.orderBy(F.desc("authority"), "handle", "author_id").limit(shown)


def second_lane(posts: DataFrame, words: list[str], limit: int, k1: float = 1.2, b: float = 0.75, keep: Column | None = None) -> DataFrame:
    """post_id, score, total: plain BM25 over posts that hold every word and fit ``keep``; the number of all hits beside the
    first ``limit``. Without words all fitting posts score alike.

    posts: post_id, tokens and what ``keep`` reads. One pass counts the corpus, the words' frequencies and the hits (numbers
    only), one scores; nothing is exploded or shuffled but the first rows.
    """
    words, keep = list(dict.fromkeys(words)), F.lit(True) if keep is None else keep
    holds = lambda w: F.array_contains("tokens", w)
    hit = F.coalesce(keep, F.lit(False))
    for w in words:
        hit &= holds(w)
    n, mean, total, *dfs = posts.agg(F.count(F.lit(1)), F.avg(F.size("tokens")), F.count_if(hit), *[F.count_if(holds(w)) for w in words]).first()
    score = F.lit(0.0)
    for w, df in zip(words, dfs, strict=True):
        tf = F.size("tokens") - F.size(F.array_remove("tokens", w))
        score = score + R.bm25(tf, F.lit(df), n, k1, b, F.size("tokens"), mean or 1.0)
    return posts.filter(hit).select("post_id", score.alias("score"), F.lit(total).cast("long").alias("total")).orderBy(F.desc("score"), "post_id").limit(limit)
