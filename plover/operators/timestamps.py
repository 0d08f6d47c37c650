"""Mixed timestamp formats and time zones (problem 2).

Method: expectation-maximisation over format mixtures per source. A value contributes likelihood to every reading under
which it is valid: the order of its numbers (dmy or mdy), the meaning of its zone abbreviation (CST of Chicago or of
Shanghai), the unit of a bare number (of which only one can fall into the years taken for real). Per source the mixture
weights of these formats are fitted on counts of *signatures*, the sets of readings values admit, and the posterior
chooses. What is declared of a source (date order, zone) is worth ``DECLARED`` values that say so: it decides what the
values leave open, and many values that contradict it overrule it. What stays open is marked, not guessed.

Values are read once, by one grammar (Arrow-batched Python: as nested column expressions the templates exceed what Spark
can compile), and written; everything after that is built-in expressions. Wall times are resolved by
``to_utc_timestamp``: a time shown twice means its first showing, a skipped one counts with the offset before the jump.

Output of ``normalise``: the input plus
  format     the chosen interpretation (null: the value names no instant)
  utc_us     microseconds since 1970 (floor), ``utc_ms`` milliseconds
  zone_from  value | source | none
  status     resolved | ambiguous_order | ambiguous_zone | repeated_wall | skipped_wall | no_zone | unreadable

Edge cases: null and empty values are ``unreadable``, and so are long ones once white space is collapsed, as no
template is longer than ``MAX_LENGTH``; impossible dates too; a wall time without any zone has no instant (``no_zone``);
a posterior below ``sure`` is ambiguous and takes the likeliest reading, of equal ones the declared, then the first by
name; empty tables give empty tables; repeated rows are values of their own; other columns pass through (names starting
with ``_ts_`` are reserved).
"""

from __future__ import annotations

import re
from datetime import datetime
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.runtime import materialize

#: First and last instant taken for real, in milliseconds: 2006 to 2026.
FIRST_MS = 1136073600000
LAST_MS = 1798761599999
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

#: Offsets in minutes of zone abbreviations that are clear without a place.
ABBREVIATIONS = {
    "Z": 0,
    "UT": 0,
    "UTC": 0,
    "GMT": 0,
    "WET": 0,
    "WEST": 60,
    "CET": 60,
    "CEST": 120,
    "EET": 120,
    "EEST": 180,
    "MSK": 180,
    "JST": 540,
    "KST": 540,
    "AEST": 600,
    "AEDT": 660,
    "NZST": 720,
    "NZDT": 780,
    "NST": -210,
    "NDT": -150,
    "ADT": -180,
    "BRT": -180,
    "EDT": -240,
    "CDT": -300,
    "MDT": -360,
    "PDT": -420,
}

#: Abbreviations several zones use, the most common meaning first.
AMBIGUOUS = {
    "AST": (-240, 180),
    "BST": (60, 360),
    "CST": (-360, 480),
    "EST": (-300, 600),
    "IST": (330, 60, 120),
    "MST": (-420, 480),
    "PST": (-480, 480),
}

_ZONE = r"(?P<zone>Z|z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5})?(?P<region>\[[^\]]{1,64}\])?"
_TIME = r"(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2})(?:[.,](?P<fraction>\d{1,18}))?)?"
_HALF = r" ?(?P<half>[AaPp][Mm])?"
#: Each template names its parts; ``open`` leaves the order of its two first numbers to the value and the source.
TEMPLATES = [
    ("ymd", rf"(?P<year>\d{{4}})[-/.](?P<month>\d{{1,2}})[-/.](?P<day>\d{{1,2}})[Tt ]{_TIME} ?{_ZONE}"),
    ("compact", rf"(?P<year>\d{{4}})(?P<month>\d{{2}})(?P<day>\d{{2}})[Tt](?P<hour>\d{{2}})(?P<minute>\d{{2}})(?P<second>\d{{2}})(?:[.,](?P<fraction>\d{{1,18}}))?{_ZONE}"),
    ("day_name", rf"(?:[A-Za-z]{{3}},? )?(?P<day>\d{{1,2}}) (?P<month>[A-Za-z]{{3,9}}) (?P<year>\d{{4}}),? {_TIME} ?{_ZONE}"),
    ("unix_date", rf"[A-Za-z]{{3}} (?P<month>[A-Za-z]{{3}}) (?P<day>\d{{1,2}}) {_TIME} {_ZONE} (?P<year>\d{{4}})"),
    ("name_day", rf"(?P<month>[A-Za-z]{{3,9}}) (?P<day>\d{{1,2}}), (?P<year>\d{{4}}),? {_TIME}{_HALF}"),
    ("open", rf"(?P<a>\d{{1,2}})(?P<sep>[/.-])(?P<b>\d{{1,2}})(?P=sep)(?P<year>\d{{4}}),? {_TIME}{_HALF}"),
]
_COMPILED = [(name, re.compile(pattern, re.ASCII)) for name, pattern in TEMPLATES]
_NUMBER = re.compile(r"\d{1,20}(?:\.\d{1,12})?(?:[eE][+]?\d{1,2})?", re.ASCII)
_EPOCH = datetime(1970, 1, 1)
MAX_LENGTH = 200
#: What a declaration is worth, in values that say the same; that an abbreviation's meaning is the most common one is a mere hint.
DECLARED = 10.0
COMMON = 0.1
_FLOOR = 0.5
PARSED = "signature string, epoch_us long, dmy_us long, mdy_us long, offset_min int, region string"


def known_zones(spark) -> str:
    """Region names the JVM knows, as a SQL list; a name outside it is no zone. Fetched in one call."""
    joined = spark._jvm.java.lang.String.join(",", spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    return ", ".join(f"'{z}'" for z in sorted(joined.split(",")) if "SystemV" not in z)


def _wall(year: int, month: int, day: int, clock_us: int) -> int | None:
    try:
        return (datetime(year, month, day) - _EPOCH).days * 86400000000 + clock_us
    except ValueError:
        return None


def _clock(p: dict[str, str | None]) -> int | None:
    hour, minute, second = int(p["hour"]), int(p["minute"]), int(p["second"] or 0)
    if half := p.get("half"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half.upper() == "PM")
    if hour > 23 or minute > 59 or second > 59:
        return None
    return ((hour * 60 + minute) * 60 + second) * 1000000 + int((p.get("fraction") or "")[:6].ljust(6, "0"))


def _offset(zone: str) -> int | None:
    if zone[0] in "+-":
        digits = zone[1:].replace(":", "")
        minutes = int(digits[:2]) * 60 + int(digits[2:] or 0)
        return -minutes if zone[0] == "-" else minutes
    return ABBREVIATIONS.get(zone.upper())


def _meanings(zone: str) -> tuple[int, ...]:
    return AMBIGUOUS.get(zone.upper(), ())


def _month(name: str) -> int:
    if name.isdigit():
        return int(name)
    place = MONTHS.find(name[:3].lower())
    return place // 3 + 1 if place >= 0 and place % 3 == 0 else 0


_NOTHING = (None, None, None, None, None, None)


def read_value(value: str | None) -> tuple:
    """The fields of ``PARSED``: the formats under which the value is valid, and what it says under each."""
    if value is None:
        return _NOTHING
    text = " ".join(value.split())
    if len(text) > MAX_LENGTH:
        return _NOTHING
    if _NUMBER.fullmatch(text):
        n = Decimal(text)
        for unit, ms in (("epoch_s", n * 1000), ("epoch_ms", n), ("epoch_us", n / 1000)):
            if FIRST_MS <= ms < LAST_MS + 1:
                return (unit, int(ms * 1000 // 1), None, None, None, None)
        return _NOTHING
    for name, pattern in _COMPILED:
        if m := pattern.fullmatch(text):
            break
    else:
        return _NOTHING
    p = m.groupdict()
    clock, zone, region = _clock(p), p.get("zone"), p.get("region")
    offset = _offset(zone) if zone else None
    several = _meanings(zone) if zone else ()
    if clock is None or (zone and offset is None and not several):
        return _NOTHING
    region, year = region and region[1:-1], int(p["year"])
    if name != "open":
        wall = _wall(year, _month(p["month"]), int(p["day"]), clock)
        if wall is None:
            return _NOTHING
        signature = "|".join(f"{name}@{zone.upper()}={m}" for m in several) if several else name
        return (signature, None, wall, None, offset, region)
    a, b = int(p["a"]), int(p["b"])
    dmy, mdy = _wall(year, b, a, clock), _wall(year, a, b, clock)
    signature = "|".join(f for f, w in (("dmy", dmy), ("mdy", mdy)) if w is not None)
    return (signature, None, dmy, mdy, offset, region) if signature else _NOTHING


def _read(values: pd.Series) -> pd.DataFrame:
    frame = pd.DataFrame([read_value(v) for v in values], columns=[c.split()[0] for c in PARSED.split(", ")])
    return frame.astype({"epoch_us": "Int64", "dmy_us": "Int64", "mdy_us": "Int64", "offset_min": "Int32"})


def parsed(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with the struct ``_ts`` (fields of ``PARSED``)."""
    return rows.withColumn("_ts", F.pandas_udf(_read, PARSED)(F.col(value).cast("string")))


def fit(counts: list[tuple[str, str | None, int]]) -> dict[str, tuple[str, float]]:
    """signature -> (format, posterior) of one source. ``counts``: signature, the reading that is declared for it, values.

    MAP estimate of the mixture: each format has ``_FLOOR`` values of its own, the declared ones share ``DECLARED`` more.
    """
    weight_of: dict[str, float] = {}
    told: dict[str, float] = {}
    for signature, declared, n in counts:
        options = signature.split("|")
        for f in options:
            weight_of.setdefault(f, _FLOOR + (COMMON if f == options[0] and "@" in f and len(options) > 1 else 0.0))
        if declared in options:
            told[declared] = told.get(declared, 0.0) + n
    groups: dict[tuple[str, ...], float] = {}  # readings that compete
    for f, n in told.items():
        groups[_rivals(f)] = groups.get(_rivals(f), 0.0) + n
    prior = {f: w + (DECLARED * told[f] / groups[_rivals(f)] if f in told else 0.0) for f, w in weight_of.items()}
    whole = sum(prior.values())
    weight = {f: p / whole for f, p in prior.items()}
    total = sum(n for _, _, n in counts) + whole
    for _ in range(200):
        mass = dict(prior)
        for signature, _, n in counts:
            options = signature.split("|")
            share = sum(weight[f] for f in options)
            for f in options:
                mass[f] += n * weight[f] / share
        new = {f: m / total for f, m in mass.items()}
        moved = max(abs(new[f] - weight[f]) for f in new)
        weight = new
        if moved < 1e-9:
            break
    out = {}
    for signature, declared, _ in counts:
        options = signature.split("|")
        best = min(options, key=lambda f: (-round(weight[f], 9), f != declared, f))
        out[signature] = (best, weight[best] / sum(weight[f] for f in options))
    return out


def _rivals(reading: str) -> tuple[str, ...]:
    return ("order",) if "@" not in reading else tuple(reading.split("=")[:1])


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    found = fit(list(zip(rows["signature"], rows["declared"], rows["n"].tolist(), strict=True)))
    source = rows["source"].iloc[0]
    return pd.DataFrame([(source, s, f, p) for s, (f, p) in found.items()], columns=["source", "signature", "format", "posterior"])


def format_posteriors(marked: DataFrame) -> DataFrame:
    """source, signature, format, posterior: one row per source and signature; fitted on counts over all rows.

    ``marked``: _ts_source, _ts.signature, _ts_declared.
    """
    counts = (
        marked.filter(F.col("_ts.signature").isNotNull())
        .groupBy(F.col("_ts_source").alias("source"), F.col("_ts.signature").alias("signature"), F.col("_ts_declared").alias("declared"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("source").applyInPandas(_fit, "source string, signature string, format string, posterior double")


def normalise(rows: DataFrame, value: str, source: str, zone: str, declared: str, *, sure: float = 0.6) -> DataFrame:
    """One UTC instant per row. ``zone`` (IANA) and ``declared`` (ymd, dmy, mdy) are columns of the row's source."""
    known = known_zones(rows.sparkSession)
    wall_in = lambda wall, z: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), z))
    marked = parsed(rows, value).withColumn("_ts_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    # the reading declared for this value: its source's date order, or what the source's clock shows at that time
    local = F.expr("(_ts.dmy_us - _ts_local) div 60000000")
    by_zone = F.concat(F.regexp_extract("_ts.signature", "^[^=]*=", 0), local.cast("string"))
    marked = (
        marked.withColumn("_ts_clock", F.expr(f"CASE WHEN `{zone}` IN ({known}) THEN `{zone}` END"))
        .withColumn("_ts_local", F.when(F.contains("_ts.signature", F.lit("@")), wall_in("_ts.dmy_us", F.col("_ts_clock"))))
        .withColumn("_ts_declared", F.when(F.contains("_ts.signature", F.lit("@")), by_zone).otherwise(F.col(declared)))
        .drop("_ts_local", "_ts_clock")
    )
    marked = materialize(marked, "parsed")  # read once: for the mixture and for the result
    choices = format_posteriors(marked).select(
        F.col("source").alias("_ts_source"), F.col("signature").alias("_ts_signature"), F.col("format").alias("_ts_format"), F.col("posterior").alias("_ts_posterior")
    )
    region = f"coalesce(_ts.region, `{zone}`)"
    chosen_offset = F.regexp_extract("_ts_format", "=(-?[0-9]+)$", 1).try_cast("int")
    joined = (
        marked.withColumn("_ts_signature", F.col("_ts.signature"))
        .join(choices, ["_ts_signature", "_ts_source"], "left")
        .withColumn("_ts_offset", F.coalesce("_ts.offset_min", chosen_offset))
        .withColumn("_ts_zone", F.expr(f"CASE WHEN {region} IN ({known}) AND _ts_offset IS NULL THEN {region} END"))
        .withColumn("_ts_wall", F.when(F.col("_ts_format") == "mdy", F.col("_ts.mdy_us")).otherwise(F.col("_ts.dmy_us")))
    )
    us = F.coalesce(F.col("_ts.epoch_us"), F.col("_ts_wall") - F.col("_ts_offset").cast("long") * 60000000, wall_in("_ts_wall", F.col("_ts_zone")))
    out = joined.withColumn("utc_us", us).withColumn("utc_ms", F.expr("(utc_us - pmod(utc_us, 1000L)) div 1000"))
    shown = lambda t: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(t), F.col("_ts_zone")))
    zoned = F.col("_ts_zone").isNotNull() & F.col("_ts.epoch_us").isNull()
    later = (shown(F.col("utc_us") + 3600000000) == F.col("_ts_wall")) | (shown(F.col("utc_us") + 1800000000) == F.col("_ts_wall"))
    unsure = F.contains("_ts_signature", F.lit("|")) & (F.col("_ts_posterior") < sure)
    status = (
        F.when(F.col("_ts_signature").isNull(), "unreadable")
        .when(F.col("utc_us").isNull(), "no_zone")
        .when(unsure & chosen_offset.isNotNull(), "ambiguous_zone")
        .when(unsure, "ambiguous_order")
        .when(zoned & (shown(F.col("utc_us")) != F.col("_ts_wall")), "skipped_wall")
        .when(zoned & later, "repeated_wall")
        .otherwise("resolved")
    )
    said = F.col("_ts.epoch_us").isNotNull() | F.col("_ts_offset").isNotNull() | F.col("_ts.region").isNotNull()
    return (
        out.withColumn("status", status)
        .withColumn("zone_from", F.when(said, "value").when(F.col("_ts_zone").isNotNull(), "source").otherwise("none"))
        .withColumn("format", F.col("_ts_format"))
        .drop("_ts", "_ts_source", "_ts_signature", "_ts_format", "_ts_posterior", "_ts_zone", "_ts_wall", "_ts_declared", "_ts_offset")
    )


def instant_us(value: Column) -> Column:
    """Microseconds since 1970 of an ISO-8601 value that carries its own offset; null for anything else."""
    iso = r"^\s*\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?\s?([Zz]|[+-]\d{2}(:?\d{2})?)\s*$"
    return F.when(value.rlike(iso), F.unix_micros(F.try_to_timestamp(F.trim(value))))
