"""The inverted index as DataFrames: postings, document frequencies, impact- and time-ordered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.functions import text as X
from plover.operators import posts as P
from plover.runtime import spread

#: Read caps: postings per term, seed of a multi-term plan, reranked candidates.
PER_TERM_CAP = 500
SEED_CAP = 1500
RERANK_CAP = 200
MAX_POSTINGS_PER_POST = 4096


def analysed(posts: DataFrame, lexicon: dict | None = None) -> DataFrame:
    """posts with tokens_all, tokens and ``present``: all index terms of a post (words, neighbouring pairs, aspects)."""
    return X.tokenized(posts, "text", lexicon)


def terms_of_posts(analysed: DataFrame) -> DataFrame:
    """post_id, term, tf, unique per (term, post): counted within the post already, so nothing is aggregated or shuffled."""
    return X.exploded(analysed, F.arrays_zip("present", "tf"), "post_id", name="t").select("post_id", F.col("t.present").alias("term"), F.col("t.tf").alias("tf"))


def postings_of(analysed: DataFrame) -> DataFrame:
    """term, post_id, tf and the filter columns copied onto each posting, so reads need no join."""
    copies = ["author_id", "created_ms", "media_type", "likes", "lang"]
    bucket = P.score_bucket(P.engagement() + P.static_recency()).alias("bucket")
    rows = X.exploded(analysed, F.arrays_zip("present", "tf"), "post_id", *copies, bucket, name="t")
    return rows.select("post_id", *copies, "bucket", F.col("t.present").alias("term"), F.col("t.tf").alias("tf"))


def build_postings(posts: DataFrame, lexicon: dict | None = None) -> DataFrame:
    return postings_of(analysed(posts, lexicon))


def sorted_postings(postings: DataFrame) -> DataFrame:
    """Postings in the order reads want: by term, then impact. Ranges split a common term over several files, and files,
    row groups and pages outside a term's range (or below an impact floor) are skipped by their statistics."""
    keys = ["term", F.desc("bucket"), "post_id"]
    return postings.repartitionByRange(spread(postings.sparkSession), *keys).sortWithinPartitions(*keys)


def write_postings(postings: DataFrame, path: str) -> None:
    sorted_postings(postings).write.option("parquet.block.size", 16 << 20).parquet(path)


def term_table(postings: DataFrame) -> DataFrame:
    """term, df, floors: for each read cap the lowest bucket among the term's first postings by impact, so a capped read
    needs only those at or above it. Counted over (term, bucket), at most 256 rows a term."""
    steps = postings.groupBy("term", "bucket").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("term").orderBy(F.desc("bucket"))
    counted = steps.withColumn("upto", F.sum("n").over(above))
    floor = lambda cap: F.coalesce(F.max(F.when(F.col("upto") >= cap, F.col("bucket"))), F.min("bucket"))
    return counted.groupBy("term").agg(F.sum("n").alias("df"), floor(PER_TERM_CAP).alias("floor_read"), floor(SEED_CAP).alias("floor_seed"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def fold_deltas(terms: DataFrame, deltas: DataFrame) -> DataFrame:
    """terms (term, df) with staged deltas (array of struct<term, delta>) added in; never below 0."""
    each = deltas.select(F.explode("deltas").alias("d")).select("d.term", "d.delta")
    return terms.select("term", F.col("df").alias("delta")).unionByName(each).groupBy("term").agg(F.greatest(F.sum("delta"), F.lit(0)).alias("df"))


def check_posting_cap(analysed: DataFrame, cap: int = MAX_POSTINGS_PER_POST) -> None:
    """Raises if a post has more index terms than the cap: a batch is taken whole or not at all."""
    over = analysed.filter(F.size("present") > cap).select("post_id").first()
    if over is not None:
        raise ValueError(f"post {over[0]} has more than {cap} postings")


def ranked_reads(postings: DataFrame, order: list[Column], cap: int = PER_TERM_CAP, by: str = "term") -> DataFrame:
    """The first ``cap`` postings of every term in the given order, with their place ``rnk`` (one WindowGroupLimit)."""
    w = Window.partitionBy(by).orderBy(*order)
    return postings.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= cap)


BY_IMPACT = ["bucket", "post_id"]


def impact_order() -> list[Column]:
    return [F.desc("bucket"), F.asc("post_id")]


def time_order() -> list[Column]:
    return [F.desc("created_ms"), F.asc("post_id")]


def rarest_first(query_terms: DataFrame, dfs: DataFrame) -> DataFrame:
    """term, df, rnk: unknown terms are rarest; ties by term. The query's few terms are the small side."""
    joined = query_terms.join(dfs.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return joined.withColumn("rnk", F.row_number().over(Window.orderBy("df", "term")))
