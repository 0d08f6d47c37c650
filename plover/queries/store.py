"""Tables the engine keeps: built once per application and data folder, as ingestion would store them, read by many queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plover.operators import authors as A
from plover.operators import index as I
from plover.operators import posts as P
from plover.runtime import materialize
from plover.sources.tables import table

NOW = 1788782400000  # 2026-09-07T12:00:00Z, the clock of all queries
_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _KEPT:
        _KEPT[key] = materialize(build(), name)
    return _KEPT[key]


def forget() -> None:
    """Build anew from here on (after ``runtime.clean_up``, or to measure the building itself)."""
    _KEPT.clear()


def timed_ingress(spark: SparkSession, d: str) -> DataFrame:
    return P.with_created(table(spark, d, "ingress"), table(spark, d, "feeds"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "posts", lambda: P.posts_from_ingress(timed_ingress(spark, d), NOW))


def analysed(spark: SparkSession, d: str) -> DataFrame:
    """Posts with their token streams: a filter on them must not be pushed below the tokenizer."""
    return kept(spark, d, "analysed", lambda: I.analysed(posts(spark, d)))


def postings(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "postings", lambda: I.sorted_postings(I.postings_of(analysed(spark, d))))


def term_table(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "terms", lambda: I.term_table(postings(spark, d)))


def latest_authors(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_authors(table(spark, d, "authors"))
