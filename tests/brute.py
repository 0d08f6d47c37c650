"""Plain Python versions of the general problems, straight from their definitions; for small tables only."""

from __future__ import annotations

import csv
import io
import json
import re
from collections import defaultdict
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pyarrow.parquet as pq

LOW = datetime(2006, 1, 1, tzinfo=UTC)
HIGH = datetime(2027, 1, 1, tzinfo=UTC)


def rows(folder: str, name: str) -> list[dict]:
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def canon(value: str | None) -> str | None:
    m = re.search("[0-9]+", value or "")
    return m[0].lstrip("0") or None if m else None


def as_json(text: str | None):
    def refuse(_):
        raise ValueError

    try:
        value = json.loads(text, parse_constant=refuse)
        if isinstance(value, str):
            value = json.loads(value, parse_constant=refuse)
    except (ValueError, TypeError):
        return None
    return value if isinstance(value, dict) else None


# ---- p2: strptime tries
SHAPES = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y/%m/%d %H:%M:%S", "%Y%m%dT%H%M%S", "%a, %d %b %Y %H:%M:%S", "%a %b %d %H:%M:%S %Y", "%d %b %Y, %H:%M", "%b %d, %Y %I:%M %p"]
ZONES = {"GMT": 0, "UTC": 0, "Z": 0, "z": 0, "EDT": -4, "PDT": -7, "CEST": 2, "JST": 9, "EST": -5, "CET": 1, "PST": -8, "CDT": -5, "CST": -6, "BST": 1, "EEST": 3, "EET": 2, "IST": 5.5, "AEST": 10, "AEDT": 11}


def instant(text: str, zone: str, order: str) -> int | None:
    text = re.sub(r"\s+", " ", text.strip())
    if re.fullmatch(r"\d+(\.\d+)?([eE]\+?\d+)?", text):
        from decimal import Decimal

        for ms in (Decimal(text) * 1000, Decimal(text), Decimal(text) / 1000):
            if LOW.timestamp() * 1000 <= ms < HIGH.timestamp() * 1000:
                return int(ms)
        return None
    offset, region = None, zone
    if m := re.search(r"\[([^\]]+)\]$", text):
        region, text = m[1], text[: m.start()]
    elif m := re.fullmatch(r"(\w{3} \w{3} \d+ [\d:]+) ([+-]\d{4}) (\d{4})", text):
        offset, text = m[2], f"{m[1]} {m[3]}"
    elif m := re.search(r" ?([+-]\d\d:?\d\d|[+-]\d\d|Z|z|[A-Z]{3,4})$", text):
        if re.search(r":\d\d(\.\d+)? ?$|\d{6}$", text[: m.start()]):
            offset, text = m[1], text[: m.start()]
    ms = 0
    if m := re.search(r"[.](\d+)$", text):
        if ":" in text[: m.start()]:
            ms, text = int(m[1][:3].ljust(3, "0")), text[: m.start()]
    found = None
    for shape in SHAPES:
        try:
            found = datetime.strptime(text, shape)
            break
        except ValueError:
            pass
    if m := re.fullmatch(r"(\d\d?)[/.](\d\d?)[/.](\d{4}) (.*)", text):
        clock = None
        for shape in ("%H:%M:%S", "%I:%M %p", "%H:%M"):
            try:
                clock = datetime.strptime(m[4], shape)
                break
            except ValueError:
                pass
        a, b = int(m[1]), int(m[2])
        tries = [(b, a), (a, b)] if order != "mdy" else [(a, b), (b, a)]
        for month, day in tries:
            try:
                found = clock and datetime(int(m[3]), month, day, clock.hour, clock.minute, clock.second)
                break
            except ValueError:
                pass
    if found is None:
        return None
    if offset is not None:
        if offset in ZONES:
            shift = timedelta(hours=ZONES[offset])
        elif offset[0] in "+-":
            digits = offset[1:].replace(":", "").ljust(4, "0")
            shift = timedelta(hours=int(digits[:2]), minutes=int(digits[2:])) * (-1 if offset[0] == "-" else 1)
        else:
            return None
        utc = (found - shift).replace(tzinfo=UTC)
    else:
        utc = found.replace(tzinfo=ZoneInfo(region)).astimezone(UTC)
    if not LOW <= utc < HIGH:
        return None
    return round(utc.timestamp()) * 1000 + ms


def p2(folder: str) -> set[tuple]:
    feeds = {r["feed_id"]: r for r in rows(folder, "feeds")}
    values = [("ingress", r["ingress_seq"], r["feed_id"], r["created_at"]) for r in rows(folder, "ingress")]
    values += [("capture_events", r["event_seq"], r["feed_id"], r["event_timestamp"]) for r in rows(folder, "capture_events")]
    for r in rows(folder, "loose_posts"):
        post = as_json(r["raw_line"]) or {}
        value = post.get("created_at") if post.get("created_at") is not None else post.get("createdAt")
        if isinstance(value, (str, int)):
            values.append(("loose_posts", r["loose_seq"], r["feed_id"], str(value)))
    out = set()
    for name, seq, feed, value in values:
        if value is None or re.fullmatch(r"\d{13}", value):
            continue
        ms = instant(value, feeds[feed]["zone_name"], feeds[feed]["date_order"])
        if ms is not None:
            out.add((name, seq, ms))
    return out


# ---- p3
def p3(folder: str) -> set[tuple]:
    out = set()
    kinds = {str: "string", int: "number", float: "number", bool: "boolean", dict: "object", list: "array"}
    for name, column in (("loose_posts", "raw_line"), ("capture_events", "properties")):
        files: dict = defaultdict(lambda: defaultdict(set))
        names = {}
        for r in rows(folder, name):
            at = (r["stream_id"], r["file_no"])
            files[at], names[at] = files[at], r["source_file"]
            for k, v in (as_json(r[column]) or {}).items():
                if v is not None:
                    files[at][k].add(kinds[type(v)])
        for stream in {s for s, _ in files}:
            order = sorted(n for s, n in files if s == stream)
            for before, after in zip(order, order[1:], strict=False):
                old, new, at = files[stream, before], files[stream, after], names[stream, after]
                gone = {k: frozenset(old[k]) for k in old if k not in new}
                come = {k: frozenset(new[k]) for k in new if k not in old}
                out |= {(name, at, k, "retyped", "") for k in old if k in new and old[k] != new[k]}
                for t in {*gone.values(), *come.values()}:
                    g, c = [k for k in gone if gone[k] == t], [k for k in come if come[k] == t]
                    if len(g) == len(c) == 1:
                        out.add((name, at, g[0], "renamed", c[0]))
                    else:
                        out |= {(name, at, k, "removed", "") for k in g} | {(name, at, k, "added", "") for k in c}
    return out


# ---- p4
def p4(folder: str) -> set[tuple]:
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    events = []
    for r in rows(folder, "capture_events"):
        seq = r["event_seq"]
        events.append(seq)
        text = re.sub(r"^urn:uuid:", "", (r["uuid"] or "").strip().lower())
        digits = re.sub("[^0-9a-f]", "", text)
        if len(digits) == 32 and digits.strip("0"):
            parent[find(("e", seq))] = find(("u", digits))
        o = as_json(r["properties"]) or {}
        if o.get("request_id") is not None and o.get("captured_at"):
            at = datetime.fromisoformat(o["captured_at"]).timestamp()
            parent[find(("e", seq))] = find(("r", o["request_id"].lower(), o["chunk_index"], at))
    groups = defaultdict(list)
    for seq in events:
        groups[find(("e", seq))].append(seq)
    return {(min(g), s) for g in groups.values() for s in g if s != min(g)}


# ---- p6
def p6(folder: str) -> set[tuple]:
    codes = {c for r in rows(folder, "rejections") for c in r["reasons"] or []}
    out, delimiter = set(), {}
    table = rows(folder, "rejection_lines")
    for r in table:
        if r["line_no"] == 1:
            delimiter[r["load_file"]] = next(c for c in r["line"] if c in ",;\t")
    for r in table:
        d, line = delimiter[r["load_file"]], r["line"].removesuffix("\r")
        if not line.strip() or line.lstrip("﻿").replace('"', "").replace(d, ",").lower().startswith("kind,accountuserid"):
            continue
        state, quoting, at_start, text = "start", False, True, []
        for c in line:
            if state in ("start", "plain"):
                if c == d:
                    state = "start"
                elif c == '"':
                    if state == "plain":
                        quoting = True
                        break
                    state = "in"
                else:
                    state = "plain"
            elif state == "in":
                state = "quote" if c == '"' else "in"
            elif state == "quote":
                if c == '"':
                    state = "in"
                elif c == d:
                    state = "start"
                else:
                    quoting = True
                    break
        del at_start, text
        if quoting or state == "in":
            out.add((r["raw_seq"], "quoting"))
            continue
        f = next(csv.reader(io.StringIO(line, newline=""), delimiter=d, strict=True), [])
        if len(f) != 9:
            out.add((r["raw_seq"], "column_count"))
            continue
        f = [x.strip(" \t") for x in f]
        num = lambda s, least: re.fullmatch("[0-9]+", s) and least <= int(s) <= 2147483647
        ok = (
            f[0] == "rejection" and re.fullmatch("[0-9]+", f[1]) and num(f[2], 1) and f[3] and num(f[4], 0) and f[5] in ("timeline", "embedded")
            and re.fullmatch("[0-9]*", f[6]) and re.fullmatch("[0-9]*", f[7]) and all(c in codes for c in f[8].split("|"))
        )
        if not ok:
            out.add((r["raw_seq"], "bad_value"))
    return out


# ---- p7
def p7(folder: str) -> set[tuple]:
    seen: dict = defaultdict(list)
    gone: dict = defaultdict(list)
    ingress = rows(folder, "ingress")
    for entity, table in (("tweet", ingress), ("author", rows(folder, "authors"))):
        for r in table:
            seen[entity, canon(r["id"])].append(r["received_at"])
    for r in rows(folder, "tombstones"):
        gone[r["entity"], canon(r["entity_id"])].append(r["deleted_at"])
    out = set()
    for r in ingress:
        for field, entity in (("author_id", "author"), ("quoted_tweet_id", "tweet"), ("retweet_of_tweet_id", "tweet"), ("in_reply_to_tweet_id", "tweet")):
            key = canon(r[field])
            if key is None:
                continue
            there, dead = seen.get((entity, key)), gone.get((entity, key))
            if dead and (not there or max(dead) >= max(there)):
                out.add((r["ingress_seq"], field, "deleted"))
            elif not there:
                out.add((r["ingress_seq"], field, "missing"))
            elif min(there) > r["received_at"]:
                out.add((r["ingress_seq"], field, "late"))
    return out
