"""Mixing sources to target weights (problem 9).

Method: tokens are packed into blocks of fixed length per source; each output shard draws multinomial source counts;
slots are mapped through a per-source pseudorandom permutation of the block indices (a fresh one for each repeat), and
blocks are joined by index. A source is used at most ``max_repeats`` times; slots beyond that stay empty and show in
the report as the source's shortfall. A source is *short* if the walk through its slots placed fewer tokens than it
should have and, checked exactly, all its repeats hold fewer too: a source that can't reach its share never passes the
walk, so the check only acquits those the draw left behind by chance.

The tokenizer's vocabulary is read on the driver (at most ``MAX_VOCABULARY`` bytes) and broadcast: executors need no file.

Documents are packed in hashed order with ``prefix_sums``: no task sees a whole source. The number of sources in the
targets is bounded (``MAX_SOURCES``); everything else is distributed.

Edge cases: null and empty texts have no tokens; documents of sources without target count for the corpus size only;
a target without documents is short; null source: no target; a share of 0 is never short; repeated targets: the first
by source order of their values; empty corpus: nothing is drawn and nothing is short. Very long texts are whole: they
span as many blocks as they fill.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plover.operators.prefix import prefix_sums
from plover.runtime import materialize

#: Where the vocabulary lies, unless the session sets ``plover.tokenizer``.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY = 64_000_000
#: Fixed value: the splitting pattern that belongs to the public byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 512
SHARD_SLOTS = 1024
MAX_SOURCES = 10_000
#: Longest stretch given to the tokenizer at once; longer texts are cut at white space, where its pattern splits anyway.
STRETCH = 100_000

_encodings: dict = {}


def vocabulary(path: str) -> bytes:
    """The lines of a vocabulary file (token in base64, rank)."""
    with open(path, "rb") as file:
        held = file.read(MAX_VOCABULARY + 1)
    if len(held) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    return held


def encoding(lines: bytes):
    key = hash(lines)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        _encodings[key] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut before a single space that follows a non-space."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace() and text[cut + 1 : cut + 2].strip()):
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def count_tokens(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens."""
    spark = documents.sparkSession
    lines = spark.sparkContext.broadcast(vocabulary(tokenizer or spark.conf.get("plover.tokenizer", TOKENIZER)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(lines.value)
        for batch in batches:
            n = [sum(len(enc.encode_ordinary(s)) for s in stretches(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": n})

    return documents.select("doc_id", "source", "text").mapInPandas(count, "doc_id long, source string, n_tokens long")


def pack(counted: DataFrame, seed: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """source, block, at, doc_id, from_token, to_token: which part of which document lies in which block, from its token
    ``at`` on."""
    hashed = counted.filter("n_tokens > 0 AND source IS NOT NULL").withColumn("place", F.xxhash64("doc_id", F.lit(seed)))
    placed = prefix_sums(hashed, ["source"], ["place", "doc_id"], "n_tokens")
    size = F.lit(block_tokens)
    spread = placed.withColumn("block", F.explode(F.sequence(F.expr(f"before div {block_tokens}"), F.expr(f"(before + n_tokens - 1) div {block_tokens}"))))
    begin = F.greatest(F.col("block") * size - F.col("before"), F.lit(0))
    end = F.least((F.col("block") + 1) * size - F.col("before"), F.col("n_tokens"))
    at = F.col("before") + begin - F.col("block") * size
    return spread.select("source", "block", at.cast("int").alias("at"), "doc_id", begin.cast("long").alias("from_token"), end.cast("long").alias("to_token"))


def _feistel(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size-1, element by element (four rounds, cycle-walking)."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.ones(len(index), dtype=bool)
    while todo.any():
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            f = (right + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64)) ^ key[todo]
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo &= out >= size.astype(np.uint64)
    return out.astype(np.int64)


def permuted(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(_feistel(index.to_numpy(), size.to_numpy(), key.to_numpy().astype(np.int64).view(np.uint64)))


def draw(spark, shares: dict[str, float], slots: int, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, source, n: multinomial counts of each output shard."""
    names, p = list(shares), np.array(list(shares.values()))
    shards = math.ceil(slots / shard_slots)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for shard in batch["id"]:
                n = min(shard_slots, slots - int(shard) * shard_slots)
                rows += [(shard, s, c) for s, c in zip(names, np.random.default_rng([seed, int(shard)]).multinomial(n, p), strict=True) if c]
            yield pd.DataFrame(rows, columns=["shard", "source", "n"]).astype({"shard": "int64", "n": "int64"})

    return spark.range(shards).mapInPandas(sample, "shard long, source string, n long")


def mix(documents: DataFrame, targets: DataFrame, *, tokenizer: str | None = None, seed: int = 7, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(slots, report) of a mix as large as the corpus.

    slots: shard, source, slot, repeat, block, n_tokens, parts (block is joined by index; parts: its at, doc_id,
    from_token, to_token in order, at most ``block_tokens``).
    report: source, target_share, max_repeats, source_tokens, wanted_tokens, drawn_slots, filled_slots, mixed_tokens,
    actual_share (of the mix), reached (mixed of wanted tokens), short.
    """
    spark = documents.sparkSession
    counted = materialize(count_tokens(documents, tokenizer), "tokens")
    wanted = targets.groupBy("source").agg(F.min_by("target_share", "max_repeats").alias("target_share"), F.min("max_repeats").alias("max_repeats")).filter(F.col("source").isNotNull())
    goals = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in wanted.limit(MAX_SOURCES + 1).collect()}
    if len(goals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    packed = pack(counted, seed, block_tokens)
    parts = F.array_sort(F.collect_list(F.struct("at", "doc_id", "from_token", "to_token"))).alias("parts")  # each has a token at least
    blocks = materialize(packed.groupBy("source", "block").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n_tokens"), parts), "blocks")
    depth = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks"))
    whole = sum(s for s, _ in goals.values())
    slots_wanted = math.ceil(total / block_tokens)
    if not whole or not slots_wanted:
        drawn = spark.createDataFrame([], "shard long, source string, n long")
    else:
        drawn = draw(spark, {k: s / whole for k, (s, _) in sorted(goals.items())}, slots_wanted, seed, shard_slots)
    started = prefix_sums(drawn, ["source"], ["shard"], "n")
    limits = wanted.select("source", "max_repeats").join(depth, "source")
    each = (
        started.join(limits, "source")
        .withColumn("slot", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)))
        .filter(F.col("slot") < F.col("n_blocks") * F.col("max_repeats"))
        .withColumn("repeat", F.expr("slot div n_blocks"))
        .withColumn("key", F.xxhash64("source", "repeat", F.lit(seed)))
    )
    mapped = each.withColumn("block", F.pandas_udf(permuted, "long")(F.col("slot") % F.col("n_blocks"), "n_blocks", "key"))
    slots = mapped.join(blocks, ["source", "block"]).select("shard", "source", "slot", "repeat", "block", "n_tokens", "parts")
    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    asked = drawn.groupBy("source").agg(F.sum("n").alias("drawn_slots"))
    taken = slots.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("filled_slots"))
    counts = ["source_tokens", "drawn_slots", "filled_slots", "mixed_tokens"]
    all_targets = Window.partitionBy(F.lit(1))  # a row per target: at most MAX_SOURCES
    report = (
        wanted.join(have, "source", "left")
        .join(asked, "source", "left")
        .join(taken, "source", "left")
        .fillna(0, counts)
        .withColumn("wanted_tokens", F.col("target_share") * F.lit(float(total)))
        .withColumn("short", (F.col("mixed_tokens") < F.col("wanted_tokens")) & (F.col("wanted_tokens") > F.col("source_tokens") * F.col("max_repeats")))
        .withColumn("actual_share", F.col("mixed_tokens") / F.greatest(F.sum("mixed_tokens").over(all_targets), F.lit(1)))
        .withColumn("reached", F.try_divide("mixed_tokens", "wanted_tokens"))
    )
    return slots, report
