"""Evaluation texts leaking into training text (problem 8).

Method: Wu-Manber multi-pattern search over words. Patterns are all runs of ``LENGTH`` consecutive words of the test
items. A window of that length slides over a document; the block (its last two words) is looked up in the shift table
and mostly allows a jump of many words; where the shift is 0 the block's bucket lists the patterns that end so, and
direct comparison confirms.

The tables are built once on the driver from the test items and broadcast; a worker unpacks them once. Items are taken from
a stream: as soon as their patterns pass ``max_patterns`` or their texts ``MAX_BYTES`` they make up one pass, and the rest
goes into further passes, so the driver and a broadcast hold a bounded part and no item is left out.
Documents stream through (``mapInPandas``): no shuffle but the final grouping of confirmed hits.

Edge cases: null or empty texts hold nothing; an item of fewer than ``LENGTH`` words can't leak; several items with a
common passage are all reported; repeated documents and items are reported each; very long texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 12
BLOCK = 2
MAX_PATTERNS = 2_000_000
MAX_BYTES = 64_000_000
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD))


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits after NFKC and lower case; invisible characters are taken out first."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    return _WORD.findall(text.lower())


class WuManber:
    """Shift and hash tables over word sequences of one length."""

    def __init__(self, patterns: dict[tuple[str, ...], frozenset[int]], length: int):
        self.length, self.default = length, length - BLOCK + 1
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], frozenset[int]]] = defaultdict(dict)
        for pattern, owners in patterns.items():
            for end in range(BLOCK, length + 1):
                block = (pattern[end - 2], pattern[end - 1])
                jump = length - end
                if jump < self.shift.get(block, self.default):
                    self.shift[block] = jump
            self.bucket[pattern[-2:]][pattern] = owners

    def search(self, doc: list[str]) -> Iterator[tuple[int, frozenset[int]]]:
        """(first word, owners) of every occurrence."""
        shift, default, length, at, size = self.shift, self.default, self.length, self.length - 1, len(doc)
        while at < size:
            jump = shift.get((doc[at - 1], doc[at]), default)
            if jump:
                at += jump
                continue
            start = at - length + 1
            owners = self.bucket[doc[at - 1], doc[at]].get(tuple(doc[start : at + 1]))
            if owners:
                yield start, owners
            at += 1


def item_patterns(items: list[tuple[int, str]], length: int = LENGTH) -> dict[tuple[str, ...], frozenset[int]]:
    found: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        for i in range(len(w) - length + 1):
            found[tuple(w[i : i + length])].add(item_id)
    return {p: frozenset(o) for p, o in found.items()}


def passes(items: Iterable[tuple[int, str | None]], length: int, max_patterns: int, max_bytes: int = MAX_BYTES) -> Iterator[WuManber]:
    """The search tables of the items, of a bounded number at a time; one (empty) if there is none. An item alone may pass the bounds."""
    held, n, size, any_yet = [], 0, 0, False
    for item_id, text in items:
        w = len(words(text)) - length + 1
        if held and (n + w > max_patterns or size + len(text or "") > max_bytes):
            yield WuManber(item_patterns(held, length), length)
            held, n, size, any_yet = [], 0, 0, True
        held.append((item_id, text))
        n, size = n + max(0, w), size + len(text or "")
    if held or not any_yet:
        yield WuManber(item_patterns(held, length), length)


def leaked_items(documents: DataFrame, items: DataFrame, *, length: int = LENGTH, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, item_id, n_hits, first_word, n_words: every document and the test items it leaks.

    ``documents``: doc_id, text; ``items``: item_id, text (a stated set).
    """
    spark, found = documents.sparkSession, None
    for tables in passes(map(tuple, items.select("item_id", "text").toLocalIterator()), length, max_patterns):
        shared = spark.sparkContext.broadcast(tables)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            search = shared.value
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    w = words(text)
                    rows += [(doc_id, item, start, len(w)) for start, owners in search.search(w) for item in owners]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "at", "n_words"]).astype("int64")

        hits = documents.select("doc_id", "text").mapInPandas(scan, "doc_id long, item_id long, at long, n_words long")
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.min("at").alias("first_word"), F.max("n_words").alias("n_words")
    )
