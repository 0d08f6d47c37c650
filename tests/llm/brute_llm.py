"""Plain Python versions of the training-data problems, straight from their definitions; for small tables only."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

import pyarrow.parquet as pq

LOW, HIGH = 1136073600000, 1790812800000


def rows(folder: str, name: str) -> list[dict]:
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def canon(value: str | None) -> str | None:
    m = re.search("[0-9]+", value or "")
    return m[0].lstrip("0") or None if m else None


def p1(folder: str) -> set[tuple]:
    stale = {r["again_seq"] for r in rows(folder, "duplicates") if r["metrics_refreshed"] is False}
    groups = defaultdict(list)
    for r in rows(folder, "ingress"):
        if canon(r["id"]):
            groups[canon(r["id"])].append(r)
    out = set()
    for key, g in groups.items():
        if len(g) < 2:
            continue
        good = [r for r in g if r["metrics"] and r["metrics"]["likes"] is not None and r["metrics_at"] and LOW < r["metrics_at"] <= HIGH and r["ingress_seq"] not in stale]
        best = min(good, key=lambda r: (-r["metrics_at"], r["ingress_seq"]))["ingress_seq"] if good else None
        out.add((key, best, min(g, key=lambda r: (-len((r["text"] or "").strip()), r["ingress_seq"]))["ingress_seq"]))
    return out


def p5(folder: str) -> set[tuple]:
    scores = ("like_count", "author_authority", "feedback_votes", "created_at")
    groups = defaultdict(dict)
    for r in sorted(rows(folder, "candidates"), key=lambda r: -r["cand_seq"]):
        groups[r["query_key"]][r["candidate_id"]] = [-math.inf if r[s] is None or r[s] != r[s] else r[s] for s in scores]
    out = set()
    for key, items in groups.items():
        total = defaultdict(float)
        for i in range(4):
            values = sorted(v[i] for v in items.values())
            for item, v in items.items():
                below, same = sum(x < v[i] for x in values), sum(x == v[i] for x in values)
                total[item] += below + same / 2
        out |= {(key, item) for item in sorted(total, key=lambda t: (-total[t], t))[:5]}
    return out


def words(text: str) -> list[str]:
    text = re.sub("[​‌‍﻿­]", "", text)
    out, now = [], ""
    for c in unicodedata.normalize("NFKC", text).lower():
        if c.isalnum():
            now += c
        elif now:
            out, now = [*out, now], ""
    return [*out, now] if now else out


def p8(folder: str) -> set[tuple]:
    grams = defaultdict(set)
    for r in rows(folder, "eval_items"):
        w = words(r["text"] or "")
        for i in range(len(w) - 11):
            grams[" ".join(w[i : i + 12])].add(r["item_id"])
    out = set()
    for r in rows(folder, "documents"):
        w = words(r["text"] or "")
        for i in range(len(w) - 11):
            out |= {(r["doc_id"], item) for item in grams.get(" ".join(w[i : i + 12]), ())}
    return out


def p9(folder: str) -> set[tuple]:
    """With words and marks as tokens."""
    sizes = defaultdict(int)
    for r in rows(folder, "documents"):
        sizes[r["source"]] += len(re.findall(r"\w+|[^\w\s]", r["text"] or ""))
    whole = sum(sizes.values())
    return {(t["source"],) for t in rows(folder, "mix_targets") if t["target_share"] * whole > sizes[t["source"]] * t["max_repeats"]}


def p10(folder: str, least: int = 200) -> set[tuple]:
    """Every pair: a common stretch of ``least`` characters."""
    at = defaultdict(set)
    for r in rows(folder, "documents"):
        text = r["text"] or ""
        for i in range(len(text) - least + 1):
            at[hash(text[i : i + least])].add(r["doc_id"])
    return {(a, b) for ids in at.values() for a in ids for b in ids if a < b}
