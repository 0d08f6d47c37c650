"""One ranking from several differently-scaled scores (problem 5).

Method: first principal component of rank-transformed scores. Each score becomes its mid-rank within the group; the
correlation matrix of the ranks is one distributed aggregate over all rows (its entries alone reach the driver); the
loadings of the first component take the declared directions' signs, and items are sorted by their projection.

Ranks need no window over a group: distinct values are counted, range-partitioned, and their counts summed with
``prefix_sums``, so a group may hold any share of the rows.

Edge cases: null and NaN are worst and tie with each other; infinities rank as values; repeated rows of an item count
once (the one with the lowest sequence number); a constant score gets equal ranks and loading 0; ties of the
projection fall to the smaller item id; null group or item ids are groups and items of their own; empty: empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plover.operators.prefix import prefix_sums
from plover.runtime import materialize


def ranked_scores(items: DataFrame, group: str, item: str, seq: str, scores: dict[str, int]) -> DataFrame:
    """grp, item and r_<score>: mid-ranks in (0, 1), higher is better. ``scores``: column -> +1 or -1."""
    one = items.groupBy(F.col(group).alias("grp"), F.col(item).alias("item")).agg(
        *[F.min_by(F.struct(F.col(s).cast("double").alias("x")), seq)["x"].alias(s) for s in scores]
    )
    worst = F.lit(float("-inf"))
    clean = lambda s: F.when(F.col(s).isNull() | F.isnan(s), worst).otherwise(F.col(s) * scores[s] + 0.0)
    one = materialize(one.select("grp", "item", *[clean(s).alias(s) for s in scores]), "scores")
    cells = F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("v")) for s in scores])
    long = one.select("grp", "item", F.explode(cells).alias("c")).select("grp", "item", "c.score", "c.v")
    counts = long.groupBy("grp", "score", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = prefix_sums(counts, ["grp", "score"], ["v"], "n")
    size = one.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    ranks = placed.join(size, same(placed, size, "grp")).select(
        placed["grp"].alias("g"), F.col("score").alias("s"), F.col("v").alias("w"), ((F.col("before") + F.col("n") / 2) / F.col("size")).alias("rank")
    )
    joined = long.join(ranks, [long["grp"].eqNullSafe(ranks["g"]), long["score"] == ranks["s"], long["v"] == ranks["w"]])
    return joined.groupBy("grp", "item").agg(*[F.max(F.when(F.col("score") == s, F.col("rank"))).alias(f"r_{s}") for s in scores])


def first_component(ranked: DataFrame, scores: list[str]) -> np.ndarray:
    """Loadings of the first principal component of the ranks, none negative (ranks already point the declared way)."""
    pairs = [(a, b) for i, a in enumerate(scores) for b in scores[i:]]
    row = ranked.agg(*[F.coalesce(F.covar_pop(f"r_{a}", f"r_{b}"), F.lit(0.0)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    cov = np.zeros((len(scores), len(scores)))
    for value, (a, b) in zip(row, pairs, strict=True):
        i, j = scores.index(a), scores.index(b)
        cov[i, j] = cov[j, i] = value
    sd = np.sqrt(np.diag(cov))
    alive = sd > 1e-12
    corr = np.where(np.outer(alive, alive), cov / np.outer(np.where(alive, sd, 1), np.where(alive, sd, 1)), 0)
    _, vectors = np.linalg.eigh(corr)
    return np.where(alive, np.abs(vectors[:, -1]), 0)


def fuse_ranks(items: DataFrame, group: str, item: str, seq: str, scores: dict[str, int]) -> tuple[DataFrame, np.ndarray]:
    """grp, item, r_<score>, projection; and the loadings."""
    ranked = materialize(ranked_scores(items, group, item, seq, scores), "ranks")
    loadings = first_component(ranked, list(scores))
    projection = sum((F.col(f"r_{s}") * float(w) for s, w in zip(scores, loadings, strict=True)), F.lit(0.0))
    return ranked.withColumn("projection", projection), loadings


def top_of_groups(fused: DataFrame, k: int) -> DataFrame:
    """The k best items of each group. Per-group limits are applied before the shuffle (WindowGroupLimit)."""
    best = Window.partitionBy("grp").orderBy(F.desc("projection"), F.asc("item"))
    return fused.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
