"""Long exact spans shared between records (problem 10).

Method: sliding sentence spans, with content-defined "sentences". Spans that end at punctuation can't promise to find
every common stretch of a given length (sentences may be longer, cut off, or lack marks), so segments begin where the
hash of the next ``GRAM`` characters is the least of its neighbourhood (winnowing). Such a cut depends on nearby text
only, and one lies within every ``WINDOW`` starting places. From each cut a span of ``SPAN`` characters, several
consecutive segments, is hashed; spans are joined globally by hash; what two texts share is then compared exactly.
With WINDOW + GRAM - 1 + SPAN <= ``LEAST`` every common stretch of LEAST characters holds a whole span: none is lost.

Exact copies are one class: its representative (lowest doc_id) is compared for all, and each copy is reported with it.
A stretch that stands in n texts means n (n - 1) / 2 pairs, which ``linked_pairs`` must give; ``shared_classes`` has one
row per text instead. Of a run of shared spans only the first gives a candidate pair: the following ones see that their predecessors match.

Edge cases: null and short texts share nothing; repeats inside one text aren't sharing; repeated rows of a
doc_id are one record if equal and must not differ; very long texts are read whole, in pieces that overlap; surrogates and any code point count
as one character; empty tables: empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.operators.components import connected_components
from plover.runtime import materialize, spread

LEAST = 200
SPAN = 150
GRAM = 8
WINDOW = LEAST - SPAN - GRAM + 1
PIECE = 2_000_000
#: Windows given back at once.
ROWS = 100_000
_P = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3 * 2 + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_hash(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive codes, by doubling."""
    out, done, result, offset, power = codes, 1, None, 0, np.array([_BASE])  # an array: its overflow wraps silently
    rest = width
    while rest:
        if rest & 1:
            if result is None:
                result, offset = out, done
            else:
                n = len(codes) - offset - done + 1
                result = result[:n] * power + out[offset : offset + n]
                offset += done
        rest >>= 1
        if rest:
            n = len(out) - done
            out = out[:n] * power + out[done : done + n]
            power, done = power * power, done * 2
    return result


def cuts_and_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cut positions with a whole span after them, hash of that span) of one text's code points."""
    n = len(codes)
    if n < WINDOW + GRAM - 1 or n < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    mixed = _mix(codes.astype(np.uint64) + _P)
    gram = _mix(_window_hash(mixed, GRAM))
    place = np.arange(len(gram), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    key = (gram & ~low) | (low - place)  # least hash; of equal ones the last
    least, width = key, 1
    while width * 2 <= WINDOW:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if WINDOW > width:
        step = WINDOW - width
        least = np.minimum(least[: len(least) - step], least[step:])
    cuts = np.unique(low - (least & low)).astype(np.int64)
    cuts = cuts[cuts + SPAN <= n]
    spans = _window_hash(mixed, SPAN)
    return cuts, _mix(spans[cuts] ^ np.uint64(SPAN))


def _fingerprint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "pos", "nth", "span"]
    for batch in batches:
        ids, parts = [], []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            if text is None or len(text) < LEAST:
                continue
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            found = [cuts_and_spans(codes[a : a + PIECE + 2 * LEAST]) for a in range(0, len(codes), PIECE)]
            pos = np.concatenate([c + i * PIECE for i, (c, _) in enumerate(found)])
            span = np.concatenate([s for _, s in found])
            pos, first = np.unique(pos, return_index=True)
            span = span[first].view(np.int64)
            if not len(pos):
                continue
            ids.append(np.full(len(pos), doc_id))
            parts.append((pos.astype(np.int32), np.arange(len(pos), dtype=np.int32), span))
        if ids:
            yield pd.DataFrame(dict(zip(names, [np.concatenate(ids), *(np.concatenate(x) for x in zip(*parts, strict=True))], strict=True)))
        else:
            yield pd.DataFrame({n: np.empty(0, np.int32 if n in ("pos", "nth") else np.int64) for n in names})


def copy_classes(documents: DataFrame) -> DataFrame:
    """doc_id, rep of every document that is an exact copy of one with a lower id."""
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("h"))
    reps = texts.groupBy("h").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last")
    return texts.join(reps, "h").filter(F.col("doc_id") > F.col("rep")).select("doc_id", "rep")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc_id, pos, nth, span of the spans that occur in more than one text; ``nth`` counts all cuts of the text.

    All spans are shuffled once, by their hash: counting and the join back use that one exchange.
    """
    spans = documents.select("doc_id", "text").mapInPandas(_fingerprint, "doc_id long, pos int, nth int, span long")
    placed = spans.repartition(spread(documents.sparkSession), "span")
    every = [F.max(c).alias(f"max_{c}") for c in ("pos", "nth")]  # both sides must read all columns to share the exchange
    shared = placed.groupBy("span").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), *every).filter("a < b AND max_pos >= 0 AND max_nth >= 0").select("span")
    return placed.join(shared, "span")  # inner: a semi join would be pushed below the exchange


def with_predecessors(shared: DataFrame) -> DataFrame:
    """``shared`` plus prev_span and gap: hash and distance of the cut just before, if it is shared too (else null)."""
    by = Window.partitionBy("doc_id").orderBy("nth")
    near = F.lag("nth").over(by) == F.col("nth") - 1
    return shared.withColumn("prev_span", F.when(near, F.lag("span").over(by))).withColumn("gap", F.when(near, F.col("pos") - F.lag("pos").over(by)))


def _long_enough(left: pd.Series, lcut: pd.Series, right: pd.Series, rcut: pd.Series) -> pd.Series:
    """Whether the stretch around the shared span is at least LEAST characters, exactly compared."""
    out = []
    for a, i, b, j in zip(left, lcut, right, rcut, strict=True):
        if a[i : i + SPAN] != b[j : j + SPAN]:
            out.append(False)
            continue
        back = 0
        while back < min(i, j) and a[i - back - 1] == b[j - back - 1]:
            back += 1
        on, room = SPAN, min(len(a) - i, len(b) - j)
        while on < room and a[i + on] == b[j + on]:
            on += 1
        out.append(back + on >= LEAST)
    return pd.Series(out, dtype=bool)


def linked_pairs(documents: DataFrame) -> DataFrame:
    """doc_a, doc_b (doc_a < doc_b): representatives with a common stretch of LEAST characters, and copies with theirs."""
    docs = documents.select("doc_id", "text").filter(F.length("text") >= LEAST)
    copies = materialize(copy_classes(docs), "copies")
    reps = docs.join(copies.select("doc_id"), "doc_id", "left_anti")
    rows = materialize(with_predecessors(repeated_spans(reps)), "shared")
    other = rows.select(*[F.col(c).alias(f"{c}_b") for c in ("doc_id", "pos", "prev_span", "gap")], F.col("span"))
    new = ~F.coalesce((F.col("prev_span") == F.col("prev_span_b")) & (F.col("gap") == F.col("gap_b")), F.lit(False))
    pairs = rows.join(other, "span").filter((F.col("doc_id") < F.col("doc_id_b")) & new).select(
        F.col("doc_id").alias("doc_a"), F.col("pos").alias("pos_a"), F.col("doc_id_b").alias("doc_b"), F.col("pos_b")
    )
    pairs = materialize(pairs, "pairs")
    around = LEAST - SPAN
    named = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    texts = docs.join(named, "doc_id", "left_semi")

    def context(of: DataFrame, side: str) -> DataFrame:
        start = F.greatest(F.col(f"pos_{side}") - around, F.lit(0))
        held = of.join(texts.withColumnRenamed("doc_id", f"doc_{side}"), f"doc_{side}")
        cut = F.substring("text", (start + 1).cast("int"), F.lit(LEAST + around))
        return held.withColumn(f"text_{side}", cut).withColumn(f"cut_{side}", (F.col(f"pos_{side}") - start).cast("int")).drop("text")

    seen = context(context(pairs, "a"), "b")
    sure = seen.filter(F.pandas_udf(_long_enough, "boolean")("text_a", "cut_a", "text_b", "cut_b"))
    return sure.select("doc_a", "doc_b").distinct().unionByName(copies.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b")))


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, pos, high, low: the LEAST characters from ``pos`` on as a digest of 128 bits, for every ``pos`` whose
    window holds one of the spans at ``places`` whole."""
    held, n = [], 0

    def frame() -> pd.DataFrame:
        ids, pos, halves = (np.concatenate(x) for x in zip(*held, strict=True))
        return pd.DataFrame({"doc_id": ids, "pos": pos, "high": halves[:, 0], "low": halves[:, 1]})

    for batch in batches:
        for doc_id, text, places in zip(batch["doc_id"], batch["text"], batch["places"], strict=True):
            last, raw = len(text) - LEAST, text.encode("utf-8", "surrogatepass")
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])  # of each character in ``raw``
            near = np.zeros(len(text) + 1, np.int64)  # +1 where a run of starts begins, -1 behind its end
            places = np.asarray(places, np.int64)
            np.add.at(near, np.maximum(places - (LEAST - SPAN), 0), 1)
            np.add.at(near, places + 1, -1)
            starts = np.flatnonzero(np.cumsum(near)[: last + 1])
            for a in range(0, len(starts), ROWS):
                some = starts[a : a + ROWS]
                digests = b"".join([blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(at[some].tolist(), at[some + LEAST].tolist(), strict=True)])
                held.append((np.full(len(some), doc_id), some, np.frombuffer(digests, np.int64).reshape(-1, 2)))
                n += len(some)
                if n >= ROWS:
                    yield frame()
                    held, n = [], 0
    if held:
        yield frame()


def common_windows(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts of LEAST characters and more, exact copies, common windows): doc_id, rep of the copies; doc_id, pos, owner of
    every window of LEAST characters of a representative that another one holds too, owner being the lowest that does."""
    docs = documents.select("doc_id", "text").filter(F.length("text") >= LEAST)
    copies = materialize(copy_classes(docs).distinct(), "copies")
    reps = docs.join(copies.select("doc_id"), "doc_id", "left_anti")
    places = repeated_spans(reps).groupBy("doc_id").agg(F.collect_set("pos").alias("places"))  # at most one per character
    windows = materialize(reps.join(places, "doc_id").mapInPandas(_windows, "doc_id long, pos long, high long, low long"), "windows")
    held = windows.groupBy("high", "low").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last")
    return docs, copies, windows.join(held, ["high", "low"]).select("doc_id", "pos", "owner")


def shared_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, n_members: the texts that hang together by common stretches, each class named by its lowest doc_id.
    Every window links to one owner, so a stretch in n texts costs n rows, not n²; texts that share nothing aren't listed."""
    _, copies, common = common_windows(documents)
    links = common.filter(F.col("owner") < F.col("doc_id")).select(F.col("doc_id").alias("src"), F.col("owner").alias("dst")).distinct()
    classes = connected_components(links.unionByName(copies.select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))))
    sizes = classes.groupBy("component").agg(F.count(F.lit(1)).alias("n_members"))
    return classes.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"), "n_members")


def shared_shares(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, shared_chars, later_chars: characters in stretches of LEAST or more that other texts hold too, and
    those of them a lower doc_id holds (what removing every non-first repeated stretch would take). No pairs are formed.

    A character counts if one of the windows of LEAST characters around it stands in another text: the union of these
    windows is the union of the common stretches, up to their true ends. Windows without a shared span can't be common,
    so only those around one are compared, by digests of 128 bits. Documents without a shared stretch aren't listed.
    """
    docs, copies, common = common_windows(documents)
    marked = common.select("doc_id", "pos", (F.col("owner") < F.col("doc_id")).alias("later"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    later = F.when(F.col("later"), F.col("pos"))

    def gained(before: Column) -> Column:
        return F.least(F.lit(LEAST), F.coalesce(F.col("pos") - before, F.lit(LEAST)))

    previous = F.last(later, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        marked.withColumn("g", gained(F.lag("pos").over(order)))
        .withColumn("g_later", F.when(F.col("later"), gained(previous)).otherwise(0))
        .groupBy("doc_id")
        .agg(F.sum("g").alias("some"), F.sum("g_later").alias("some_later"))
    )
    whole = copies.select("doc_id", F.lit(True).alias("lower")).unionByName(copies.select(F.col("rep").alias("doc_id"), F.lit(False).alias("lower")).distinct())
    sizes = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))  # repeated rows are one record
    listed = sizes.join(covered, "doc_id", "left").join(whole, "doc_id", "left").filter("some IS NOT NULL OR lower IS NOT NULL")
    return listed.select(
        "doc_id",
        "n_chars",
        F.when(F.col("lower").isNotNull(), F.col("n_chars")).otherwise(F.col("some")).cast("long").alias("shared_chars"),
        F.when(F.col("lower"), F.col("n_chars")).otherwise(F.coalesce("some_later", F.lit(0))).cast("long").alias("later_chars"),
    )
