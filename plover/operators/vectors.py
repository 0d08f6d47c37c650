"""Exact vector search: a stated set of query vectors against all rows, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors a block holds (their number of values bounds it too), blocks and rows a task holds.
BLOCK, BLOCK_VALUES = 1024, 1 << 20
TASK_BLOCKS, TASK_ROWS = 8, 20_000


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """block, ids, values of the query vectors: at most about ``BLOCK`` in a block, unit length, in one array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                matrix = np.array(part["embedding"].tolist(), dtype=np.float64).reshape(len(part), -1)
                norm = np.linalg.norm(matrix, axis=1, keepdims=True)
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy()], "values": [(matrix / np.where(norm > 0, norm, 1)).ravel()]})

    return rows.repartition(blocks, "vec_id").mapInPandas(run, "ids array<long>, values array<double>")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, cosine, rnk of the k nearest rows (the query itself left out). Columns: vec_id, embedding.

    Queries are packed into blocks, and chunks of at most ``TASK_BLOCKS`` blocks meet parts of about ``TASK_ROWS`` rows (a stated
    query set against all rows; rows are sent once per chunk). A task keeps its own k best, which are then merged, so no score
    matrix leaves it and nothing passes through the driver but three counts. Null vectors and zero vectors match nothing; vectors of
    another length than the query's neither; ties go to the lower id.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull())
    asked = queries.select("vec_id", "embedding").filter(F.col("embedding").isNotNull())
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    empty = spark.createDataFrame([], "query_id long, vec_id long, cosine double, rnk int")
    if not n:
        return empty
    size = max(1, min(BLOCK, BLOCK_VALUES // max(1, width)))
    blocks = -(-n // size)
    chunks = -(-blocks // TASK_BLOCKS)
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = rows.select(every(chunks).alias("chunk"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), "vec_id", "embedding")
    packed = _packed(asked, blocks).withColumn("chunk", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(chunks)).cast("int"))
    sent = packed.select("chunk", every(parts).alias("part"), "ids", "values")

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left):
            matrix = [np.asarray(v, dtype=np.float64) for v in left["embedding"]]
            for ids, values in zip(right["ids"], right["values"], strict=True):
                ids = np.asarray(ids)
                q = np.asarray(values, dtype=np.float64).reshape(len(ids), -1)
                fit = np.array([len(m) == q.shape[1] for m in matrix])
                if not fit.any():
                    continue
                x = np.stack([m for m, ok in zip(matrix, fit, strict=True) if ok])
                norm, vec = np.linalg.norm(x, axis=1), left["vec_id"].to_numpy()[fit]
                x, vec = x[norm > 0] / norm[norm > 0, None], vec[norm > 0]
                live = np.linalg.norm(q, axis=1) > 0
                scores = q[live] @ x.T
                scores[ids[live][:, None] == vec[None, :]] = -2
                at = np.lexsort((np.broadcast_to(vec, scores.shape), -np.round(scores, 9)))[:, :k]
                out = pd.DataFrame({"query_id": np.repeat(ids[live], at.shape[1]), "vec_id": vec[at].ravel(), "cosine": np.take_along_axis(scores, at, 1).ravel()})
                found.append(out[out["cosine"] > -1.5])
        return pd.concat(found) if found else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "cosine": np.empty(0)})

    near = held.groupBy("chunk", "part").cogroup(sent.groupBy("chunk", "part")).applyInPandas(search, "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "vec_id")
    return near.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)
