"""The canonical representation of a query."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

VERSION = 1
MEDIA = ("image", "video", "gif")
FILTERS = ("authorId", "since", "until", "media", "minLikes", "lang")


@dataclass
class Query:
    must: list[str] = field(default_factory=list)
    should: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    aspects: list[str] = field(default_factory=list)
    filters: dict = field(default_factory=lambda: dict.fromkeys(FILTERS))
    intent: str = "topic"
    sort: str = "top"
    union: bool = False
    # the parser's notes: what each fragment became, and what nothing understood
    consumed: dict[str, str] = field(default_factory=dict)
    leftover: list[str] = field(default_factory=list)


def canonical_json(q: Query) -> str:
    """Equal queries serialise equally: term lists as sorted sets, phrases sorted, ``union`` only where true."""
    listed = lambda xs: sorted(set(xs))
    shape = {
        "v": VERSION,
        "intent": q.intent,
        "must": listed(q.must),
        "should": listed(q.should),
        "phrases": sorted(q.phrases),
        "exclude": listed(q.exclude),
        "aspects": listed(q.aspects),
        "filters": {k: q.filters[k] for k in FILTERS},
        "sort": q.sort,
    }
    if q.union:
        shape["union"] = True
    return json.dumps(shape, ensure_ascii=False, separators=(",", ":"))


def fnv1a64(units) -> str:
    """64-bit FNV-1a over integers, as 16 hex digits."""
    h = 0xCBF29CE484222325
    for unit in units:
        h = ((h ^ unit) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def query_key(q: Query) -> str:
    """The identity of a query: FNV-1a over the UTF-16 units of its canonical JSON."""
    raw = canonical_json(q).encode("utf-16-le", "surrogatepass")
    return fnv1a64(int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2))


def merge_refinement(base: Query, refined: Query) -> Query:
    """A later reading of the query may fill empty slots and add soft terms; it never overrides what is set."""
    from dataclasses import replace

    filters = {k: base.filters[k] if base.filters[k] is not None else refined.filters[k] for k in FILTERS}
    add = lambda a, b: [*a, *(x for x in b if x not in a)]
    return replace(
        base,
        must=base.must or refined.must,
        phrases=base.phrases or refined.phrases,
        exclude=base.exclude or refined.exclude,
        should=add(base.should, refined.should),
        aspects=add(base.aspects, refined.aspects),
        filters=filters,
        intent=base.intent if base.intent != "topic" else refined.intent,
    )
