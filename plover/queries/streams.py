"""The streaming forms run over the tables as streams that end, against the twins of their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.functions.ids import canonical_id, canonical_uuid
from plover.queries import store
from plover.queries.ingesting import _UUIDS, EVENTS, KEYED, VOTE_LIMIT, event_fields, event_votes
from plover.queries.sqlparts import TOKENS
from plover.runtime import shared_dir
from plover.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """The files at ``path``, a folder or a single file, as a stream: a pattern that matches it alone, as a source of files takes
    no single one."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def settled(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has written once all that is there has passed: the last table (complete), or all rows (update, append)."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={0 if mode == 'complete' else number}")

    running = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(stream.columns)


@query(f"WITH {TOKENS}, t AS (SELECT DISTINCT post_id, unnest(tokens) AS term FROM tok) SELECT term, count(*) AS df FROM t GROUP BY term")
def stream_term_df(spark, d):
    posts = arriving(spark, store.analysed(spark, d)._materialized_at)
    return settled(live.running_document_frequencies(posts.select(F.explode(F.array_distinct("tokens")).alias("term"))), "complete")


@query(f"WITH {KEYED} SELECT post_id, max(metrics_at) AS metrics_at FROM k WHERE metrics_at IS NOT NULL GROUP BY post_id")
def stream_latest_metrics(spark, d):
    rows = arriving(spark, f"{d}/ingress.parquet").select(canonical_id("id").alias("post_id"), "metrics_at", F.col("metrics.likes").alias("likes")).filter("post_id IS NOT NULL")
    return settled(live.latest_metrics(rows), "update").groupBy("post_id").agg(F.max("metrics_at").alias("metrics_at"))


@query(VOTE_LIMIT)
def stream_vote_limit(spark, d):
    counted = settled(live.rate_limited_votes(event_votes(arriving(spark, f"{d}/events.parquet")), limit=3), "update")
    return counted.groupBy("voter").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


@query(f"""WITH {EVENTS} SELECT request_id, count(DISTINCT chunk_index) AS received, max(chunk_count) AS expected, min(chunk_count) = max(chunk_count) AS consistent,
 min(chunk_count) = max(chunk_count) AND count(DISTINCT chunk_index) = max(chunk_count) AS complete FROM ev WHERE request_id IS NOT NULL GROUP BY request_id""")
def stream_chunk_progress(spark, d):
    return settled(live.chunk_progress(event_fields(arriving(spark, f"{d}/capture_events.parquet"))), "complete")


@query(f"SELECT DISTINCT uuid FROM ({_UUIDS}) u")
def stream_delivered_once(spark, d):
    """One message per identifier, as long as repeats come within ten years of the first."""
    rows = arriving(spark, f"{d}/capture_events.parquet").select(canonical_uuid("uuid").alias("uuid"), "received_at").filter("uuid IS NOT NULL")
    return settled(live.delivered_once(rows, ["uuid"], "received_at", "3650 days").select("uuid"), "append")
