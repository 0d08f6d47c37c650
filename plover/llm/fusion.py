"""Best representative of each duplicate group (problem 1).

Method: Bayesian fusion with copy detection. Every row about an object is a claim of its source on each field. An EM
estimates how accurate each source is in each field and, from values that are shared though probably false, how likely
one source copies another; copied votes are discounted; every field takes the claim of maximum posterior, and the
surviving record is put together from the rows that made these claims.

Two kinds of fields:

* *nominal*: a false claim is one of ``WRONG_VALUES`` equally likely ones.
* *ladder*: claims have a level (time of a reading, length of a text) and errors are one-sided. A source that doesn't
  give the true level gives a lower one (stale, cut off); a higher one only with probability ``GROWN`` of its errors.
  A lone claim of a higher level therefore outweighs up to five independent sources that agree on a lower one; more
  of them, if accurate and not copying, overrule it.

Scale: a source's rows on an object are one claim (one aggregate, combined before the shuffle, so an object may hold any
share of the rows); what is gathered per object is one entry per source. Objects then reduce to *patterns* (which
sources stand behind one claim each, in order), which are counted; EM and decision run once per distinct pattern, and
objects fetch their decision by a join. To the driver come one row per field and source and one per field and pair of
sources that speak of one object: numbers that grow with the sources, not with the data.

Edge cases: rows without an object id belong to none; a null source is a source of its own; null values claim nothing (a
field nobody claims has null seq and posterior); of a source's rows the last speaks for a nominal field, the highest for
a ladder; rows that make the same claim are represented by the lowest seq; nominal ties fall to the lowest seq, ladder
ties to the higher level; nominal values are compared by 64-bit hashes within their object; very long values are only
measured and hashed; empty input: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.runtime import materialize

#: Wrong values a nominal field may take, share of a ladder's errors that go up, prior of dependence, share of values a copier copies.
WRONG_VALUES = 10
GROWN = 1e-9
DEPENDENT = 0.1
COPIED = 0.8
#: Bounds of an estimated accuracy, and what it starts from.
LEAST_ACCURATE, MOST_ACCURATE, START = 0.05, 0.95, 0.8
#: Rounds of the EM at most; it stops once nothing moves by as much as this.
ROUNDS, SETTLED = 4, 1e-4
_SEQ = 10**18
_HALF, _WHOLE = 2**63, 2**64


# ---- claims
def _big(x: Column | int) -> Column:
    return (F.lit(str(x)) if isinstance(x, int) else x).cast("decimal(20,0)")


def claims(records: DataFrame, ladders: list[str], nominal: list[str]) -> DataFrame:
    """object, n, and per field its sets (array of who, seq): which sources make one claim, and the row that stands for it.

    Ladder sets come from the highest level down, nominal ones sorted by their sources. Objects of one row are left out.
    """
    last = F.lit(_SEQ - 1) - F.col("seq")
    packed = {f: F.max(_big(F.col(f)) * _big(_SEQ) + _big(last)) for f in ladders}
    packed |= {f: F.max(F.when(F.col(f).isNotNull(), _big(F.col("seq")) * _big(_WHOLE) + _big(F.xxhash64(f)) + _big(_HALF))) for f in nominal}
    who = F.coalesce(F.base64(F.encode(F.col("source").cast("string"), "UTF-8")), F.lit("-"))
    spoken = records.filter(F.col("object").isNotNull()).groupBy("object", who.alias("who")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(f) for f, c in packed.items()])

    def entry(f: str) -> Column:
        unit = _big(_SEQ if f in ladders else _WHOLE)
        over, under = F.expr(f"`{f}` div {_SEQ if f in ladders else _WHOLE}BD"), (F.col(f) % unit)
        seq = (F.lit(_SEQ - 1) - under.cast("long")) if f in ladders else over.cast("long")
        level = over.cast("long") if f in ladders else (under - _big(_HALF)).cast("long")
        return F.when(F.col(f).isNotNull(), F.struct(level.alias("level"), seq.alias("seq"), "who")).alias(f)

    fields = [*ladders, *nominal]
    gathered = spoken.groupBy("object").agg(F.sum("n").alias("n"), *[F.collect_list(entry(f)).alias(f) for f in fields]).filter("n > 1")

    def sets(f: str) -> Column:
        levels = F.sort_array(F.array_distinct(F.transform(f, lambda e: e["level"])), asc=False)

        def one(level: Column) -> Column:
            mine = F.filter(f, lambda e: e["level"] == level)
            return F.struct(F.array_join(F.array_sort(F.transform(mine, lambda e: e["who"])), ".").alias("who"), F.array_min(F.transform(mine, lambda e: e["seq"])).alias("seq"))

        found = F.transform(levels, one)
        return (found if f in ladders else F.array_sort(found)).alias(f)

    return gathered.select("object", "n", *[sets(f) for f in fields])


def pattern(field: str) -> Column:
    """What the posterior of a field depends on, of the columns of ``claims``; '' where nobody claims it."""
    return F.array_join(F.transform(field, lambda s: s["who"]), "|")


def counted_patterns(claimed: DataFrame, fields: list[str]) -> DataFrame:
    """field, pattern, times."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), pattern(f).alias("pattern")) for f in fields]))
    return claimed.select(each.alias("p")).select("p.*").filter("pattern <> ''").groupBy("field", "pattern").agg(F.count(F.lit(1)).alias("times"))


# ---- the posterior
class Votes:
    """Posteriors of claims, given accuracies (field, source) and dependences (pairs of sources, either order)."""

    def __init__(self, ladders: list[str], accuracy: dict[tuple[str, str], float] | None = None, depends: dict[tuple[str, str], float] | None = None):
        self.ladders, self.accuracy, self.depends = frozenset(ladders), accuracy or {}, depends or {}

    def sure(self, field: str, source: str) -> float:
        return self.accuracy.get((field, source), START)

    def moved(self, other: Votes) -> float:
        """The largest change of an accuracy or a dependence."""
        change = [abs(v - other.accuracy.get(k, START)) for k, v in self.accuracy.items()] + [abs(v - other.depends.get(k, 0.0)) for k, v in self.depends.items()]
        return max(change, default=0.0)

    def independent(self, field: str, sources: list[str]) -> dict[str, float]:
        """The share of each source's vote that isn't copied from a more accurate one that says the same."""
        out: dict[str, float] = {}
        for s in sorted(sources, key=lambda s: (-self.sure(field, s), s)):
            share = 1.0
            for t in out:
                share *= 1 - COPIED * self.depends.get((min(s, t), max(s, t)), 0.0)
            out[s] = share
        return out

    def posterior(self, field: str, sets: list[list[str]]) -> np.ndarray:
        """Probability of each claim; ``sets``: who makes it, ladders from the highest level down."""
        votes = [self.independent(field, s) for s in sets]
        if field in self.ladders:
            right, low, high = (np.zeros(len(sets)) for _ in range(3))
            for i, shares in enumerate(votes):
                for s, share in shares.items():
                    a = self.sure(field, s)
                    right[i] += share * np.log(a)
                    low[i] += share * np.log((1 - a) * (1 - GROWN))
                    high[i] += share * np.log((1 - a) * GROWN)
            # if claim i is true, those above it have grown and those below have lost
            score = right + np.concatenate([[0], np.cumsum(high)[:-1]]) + low.sum() - np.cumsum(low)
            e = np.exp(score - score.max())
            return e / e.sum()
        weight = np.array([sum(x * np.log(WRONG_VALUES * self.sure(field, s) / (1 - self.sure(field, s))) for s, x in shares.items()) for shares in votes])
        top = max(0.0, weight.max())
        e = np.exp(weight - top)
        return e / (e.sum() + max(0, WRONG_VALUES + 1 - len(sets)) * np.exp(-top))  # values nobody claims keep their share

    def chosen(self, field: str, sets: list[list[str]]) -> tuple[list[int], float]:
        """The places of the claims of maximum posterior (of a ladder only the highest), and that posterior."""
        p = self.posterior(field, sets)
        held = np.round(p, 12)
        best = np.flatnonzero(held == held.max()).tolist()
        return (best[:1] if field in self.ladders else best), float(p[best[0]])


def _sets(text: str) -> list[list[str]]:
    return [s.split(".") for s in text.split("|")]


_SUMS = "field string, a string, b string, x double, y double, z double"


def _statistics(votes: Votes):
    """Sums of a batch of patterns. Of a source (b is ''): right, made; of a pair: same and true, same and false, different."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str, str], np.ndarray] = {}

        def add(field: str, a: str, b: str, amounts: tuple[float, float, float], times: int) -> None:
            held = sums.setdefault((field, a, b), np.zeros(3))
            held += np.multiply(amounts, times)

        for batch in batches:
            for field, text, times in zip(batch["field"], batch["pattern"], batch["times"], strict=True):
                sets = _sets(text)
                p = votes.posterior(field, sets)
                said = [(s, i) for i, members in enumerate(sets) for s in members]
                for at, (s, i) in enumerate(said):
                    add(field, s, "", (p[i], 1, 0), times)
                    for t, j in said[:at]:
                        add(field, min(s, t), max(s, t), (p[i], 1 - p[i], 0) if i == j else (0, 0, 1), times)
        yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["field", "a", "b", "x", "y", "z"])

    return run


def estimate(patterns: DataFrame, ladders: list[str], rounds: int = ROUNDS) -> Votes:
    """Accuracies and dependences by EM over counted patterns (field, pattern, times)."""
    votes = Votes(ladders)
    for _ in range(rounds):
        sums = patterns.mapInPandas(_statistics(votes), _SUMS).groupBy("field", "a", "b").agg(*[F.sum(c).alias(c) for c in "xyz"]).collect()
        accuracy = {(r.field, r.a): float(np.clip((r.x + 8) / (r.y + 10), LEAST_ACCURATE, MOST_ACCURATE)) for r in sums if not r.b}
        odds: dict[tuple[str, str], float] = {}
        for r in sums:
            if r.b:
                pair = np.sqrt(accuracy[r.field, r.a] * accuracy[r.field, r.b])
                true, false = pair**2, (1 - pair) ** 2 / WRONG_VALUES
                ratio = (
                    r.x * np.log((COPIED * pair + (1 - COPIED) * true) / true)
                    + r.y * np.log((COPIED * (1 - pair) + (1 - COPIED) * false) / false)
                    + r.z * np.log(1 - COPIED)
                )
                odds[r.a, r.b] = odds.get((r.a, r.b), np.log(DEPENDENT / (1 - DEPENDENT))) + ratio
        before, votes = votes, Votes(ladders, accuracy, {k: float(1 / (1 + np.exp(-np.clip(v, -50, 50)))) for k, v in odds.items()})
        if votes.moved(before) < SETTLED:
            break
    return votes


def decided(patterns: DataFrame, votes: Votes) -> DataFrame:
    """field, pattern, places (of the chosen claims in the pattern), p."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, t, *votes.chosen(f, _sets(t))) for f, t in zip(batch["field"], batch["pattern"], strict=True)]
            yield pd.DataFrame(rows, columns=["field", "pattern", "places", "p"])

    return patterns.select("field", "pattern").mapInPandas(run, "field string, pattern string, places array<int>, p double")


def fuse(records: DataFrame, ladders: list[str], nominal: list[str], *, rounds: int = ROUNDS, votes: Votes | None = None) -> DataFrame:
    """One surviving record per object with several rows: object, n, and per field ``<f>_seq``, the row to take it from, and
    ``<f>_p``, its posterior.

    ``records``: seq (below 10**18, not negative), object, source, a long per ladder (not negative, null: no claim), any value
    per nominal field. ``votes`` replaces the estimate.
    """
    fields = [*ladders, *nominal]
    claimed = materialize(claims(records, ladders, nominal), "claims")
    patterns = materialize(counted_patterns(claimed, fields), "patterns")
    votes = votes or estimate(patterns, ladders, rounds)
    choices = materialize(decided(patterns, votes), "choices")
    out = claimed
    for f in fields:
        mine = choices.filter(F.col("field") == f).select(F.col("pattern").alias("_p"), F.col("places").alias("_at"), F.col("p").alias(f"{f}_p"))
        seq = F.expr(f"array_min(transform(_at, i -> get(`{f}`, i).seq))").alias(f"{f}_seq")
        out = out.withColumn("_p0", pattern(f)).join(mine, F.col("_p0") == F.col("_p"), "left")
        out = out.select(*[c for c in out.columns if c not in ("_p0", "_p", "_at", f, f"{f}_p")], seq, f"{f}_p")
    return out
