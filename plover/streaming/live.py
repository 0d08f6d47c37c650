"""Structured Streaming forms of the ingest operators; the transformations are those of the batch side."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plover.operators import index as I
from plover.operators.ingest import VOTES_PER_WINDOW, WINDOW_S, Voter, decode_ingress, vote_subject


def follow_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of JSON lines as a stream of decoded records; where it stopped is kept by the query's checkpoint."""
    return decode_ingress(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).withColumnRenamed("value", "line"))


def index_stream(posts: DataFrame, path: str, checkpoint: str):
    """Append the postings of arriving posts (columns of operators.posts) to the index at ``path``; posts that other batches
    have indexed are known and left out, of repeats within a batch the first counts.

    Each micro-batch writes its own folder and replaces it when it is retried, so a batch is never indexed twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = batch.groupBy("post_id").agg(F.min_by(F.struct(*batch.columns), "ingress_seq").alias("r")).select("r.*")
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            known = spark.read.schema("post_id string, batch int").parquet(path).filter(F.col("batch") != number).select("post_id").distinct()
            once = once.join(known, "post_id", "left_anti")
        I.sorted_postings(I.build_postings(once)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def delivered_once(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Events without repeats, as long as these come no later than ``late`` after the first."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def running_document_frequencies(terms: DataFrame) -> DataFrame:
    """term, df kept up to date from newly inserted posts (update mode)."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def latest_metrics(snapshots: DataFrame) -> DataFrame:
    """post_id, metrics_at, likes whenever a snapshot is strictly newer than all before it; stale ones change nothing.

    snapshots: post_id string, metrics_at long, likes long.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = held
        for batch in batches:
            for at, likes in zip(batch["metrics_at"], batch["likes"], strict=True):
                if pd.notna(at) and (best is None or at > best[0]):
                    best = (int(at), int(likes) if pd.notna(likes) else 0)
        if best != held:
            state.update(best)
            yield pd.DataFrame({"post_id": [key[0]], "metrics_at": [best[0]], "likes": [best[1]]})

    shape = "post_id string, metrics_at long, likes long"
    return snapshots.groupBy("post_id").applyInPandasWithState(update, shape, "metrics_at long, likes long", "update", GroupStateTimeout.NoTimeout)


def rate_limited_votes(votes: DataFrame, limit: int = VOTES_PER_WINDOW, window_s: int = WINDOW_S) -> DataFrame:
    """voter, accepted, rejected per voter and micro-batch, by the rules of the batch form; a voter's window and standing votes
    live in the state.

    votes: voter long, post_id (and query_key), vote int, at_s long, seq long.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n, standing = state.get if state.exists else (None, 0, "{}")
        voter = Voter(json.loads(standing), opened, n)
        rows = pd.concat(list(batches)).sort_values(["at_s", "seq"])
        kept = [voter.cast(s, int(v), int(at), limit, window_s) for s, v, at in zip(rows["subject"], rows["vote"], rows["at_s"], strict=True)]
        state.update((voter.opened, voter.n, json.dumps(voter.standing)))
        yield pd.DataFrame({"voter": [key[0]], "accepted": [sum(kept)], "rejected": [len(kept) - sum(kept)]})

    rows = votes.select("voter", vote_subject(votes).alias("subject"), "vote", "at_s", "seq")
    return rows.groupBy("voter").applyInPandasWithState(
        update, "voter long, accepted long, rejected long", "opened long, n long, standing string", "update", GroupStateTimeout.NoTimeout
    )


def vote_totals(votes: DataFrame) -> DataFrame:
    """query_key, post_id, voter, vote: each voter's live vote, kept up to date (update mode); ``ingest.vote_totals`` sums them."""
    return votes.filter(F.col("voter").isNotNull()).groupBy("query_key", "post_id", "voter").agg(F.max_by("vote", "seq").alias("vote"))


def chunk_progress(events: DataFrame) -> DataFrame:
    """request_id, received, expected, consistent, complete as chunks arrive over several exports (request_id, chunk_index,
    chunk_count). The indices seen are kept exactly: at most as many as a request has chunks."""
    seen = events.filter(F.col("request_id").isNotNull()).groupBy("request_id")
    out = seen.agg(F.collect_set("chunk_index").alias("seen"), F.min("chunk_count").alias("least"), F.max("chunk_count").alias("expected"))
    same = F.col("least") == F.col("expected")
    received = F.size("seen")
    return out.select("request_id", received.cast("long").alias("received"), "expected", same.alias("consistent"), (same & (received == F.col("expected"))).alias("complete"))
