"""Messages delivered more than once (problem 4).

Method: identifiers are stored once per time bucket with the first message that carried them. A Bloom filter per
bucket (register-blocked: the bits of an identifier lie in one 64-bit word) says of every stored identifier whether
another bucket may hold it too. What no other filter knows is definitely new and takes no further part; possible
repeats are verified exactly, by equality of the whole identifier, among the stored rows of the matching buckets.
Copies of copies are joined by connected components over the verified repeats only.

Filters stay a DataFrame (one row per word with the words of all buckets): nothing of them goes to the driver, and
Spark broadcasts them only while they are below its size limit.

Edge cases: null identifiers identify nothing; a message without identifier is kept; rows without time form a bucket
of their own; repeated rows are copies like any other; empty input gives empty output; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.operators.components import connected_components
from plover.runtime import materialize

BITS_PER_KEY = 16
PROBES = 5


def _mask(h: Column) -> Column:
    """``PROBES`` bits of a 64-bit word, from six hash bits each."""
    bits = [F.expr(f"shiftleft(1L, cast((shiftrightunsigned(h, {6 * i})) & 63 as int))") for i in range(PROBES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def identifiers(messages: DataFrame, seq: str, at: Column, ids: dict[str, Column], bucket: str = "day") -> DataFrame:
    """seq, bucket, kind, key: one row per message and identifier it carries."""
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in ids.items()])
    return (
        messages.select(F.col(seq).alias("seq"), F.date_trunc(bucket, at).alias("bucket"), F.explode(listed).alias("id"))
        .select("seq", "bucket", "id.kind", "id.key")
        .filter(F.col("key").isNotNull())
    )


def bucketed_storage(keys: DataFrame) -> DataFrame:
    """One row per identifier and time bucket: first message, number of messages."""
    return keys.groupBy("kind", "key", "bucket").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))


def bloom_filters(storage: DataFrame) -> tuple[DataFrame, int]:
    """(word, filters: array<struct<bucket, bits>>) and the number of words of each bucket's filter.

    All buckets have as many words, enough for the fullest one at ``BITS_PER_KEY``.
    """
    most = storage.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    words = 1 << max(4, (most * BITS_PER_KEY // 64).bit_length())
    filters = (
        hashed(storage, words)
        .groupBy("word", "bucket")
        .agg(F.bit_or("mask").alias("bits"))
        .groupBy("word")
        .agg(F.collect_list(F.struct("bucket", "bits")).alias("filters"))  # as long as there are buckets, not rows
    )
    return filters, words


def hashed(storage: DataFrame, words: int) -> DataFrame:
    return (
        storage.withColumn("h", F.xxhash64("kind", "key"))
        .withColumn("word", F.pmod(F.xxhash64("h"), F.lit(words)))
        .withColumn("mask", _mask(F.col("h")))
        .drop("h")
    )


def possible_repeats(storage: DataFrame) -> DataFrame:
    """The stored rows that aren't definitely new: repeated in their own bucket, or in another one's filter."""
    filters, words = bloom_filters(storage)
    elsewhere = F.exists("filters", lambda f: ~f["bucket"].eqNullSafe(F.col("bucket")) & (f["bits"].bitwiseAND(F.col("mask")) == F.col("mask")))
    return hashed(storage, words).join(filters, "word").filter((F.col("n") > 1) | elsewhere).select("kind", "key", "bucket", "first_seq", "n")


def verified_repeats(storage: DataFrame) -> DataFrame:
    """kind, key, keep_seq of each identifier that more than one message carries; exact."""
    return (
        possible_repeats(storage)
        .groupBy("kind", "key")
        .agg(F.min("first_seq").alias("keep_seq"), F.sum("n").alias("copies"))
        .filter("copies > 1")
        .select("kind", "key", "keep_seq")
    )


def redelivered(messages: DataFrame, seq: str, at: Column, ids: dict[str, Column], bucket: str = "day") -> DataFrame:
    """kept_seq, dropped_seq: each message but the first of its group of copies, with that first one."""
    keys = materialize(identifiers(messages, seq, at, ids, bucket), "keys")  # read twice: stored, and linked at the end
    storage = materialize(bucketed_storage(keys), "ids")
    repeats = verified_repeats(storage)
    links = keys.join(repeats, ["kind", "key"]).filter(F.col("seq") != F.col("keep_seq")).select(F.col("seq").alias("src"), F.col("keep_seq").alias("dst"))
    groups = connected_components(links)
    return groups.filter("node != component").select(F.col("component").alias("kept_seq"), F.col("node").alias("dropped_seq"))


def deliver_once(messages: DataFrame, seq: str, at: Column, ids: dict[str, Column], bucket: str = "day") -> DataFrame:
    """The messages with exactly one copy of each."""
    dropped = redelivered(messages, seq, at, ids, bucket).select(F.col("dropped_seq").alias(seq))
    return messages.join(dropped, seq, "left_anti")
