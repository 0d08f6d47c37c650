"""Canonical identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(value: Column | str) -> Column:
    """First run of ASCII digits without leading zeros; null where there is none.

    A run of zeros only has nothing left and is no id.
    """
    value = F.col(value) if isinstance(value, str) else value
    anywhere = F.regexp_extract(value, "[0-9]+", 0)
    plain = F.when(value.rlike(r"\A[1-9][0-9]*\z"), value).otherwise(F.regexp_replace(anywhere, "^0+", ""))
    return F.when(plain != "", plain)


def canonical_uuid(value: Column | str) -> Column:
    """The 32 lower-case hex digits of a uuid in any notation; null for none and for the nil uuid."""
    value = F.col(value) if isinstance(value, str) else value
    found = F.regexp_extract(
        F.lower(value), "(?<![0-9a-f])([0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})(?![0-9a-f])", 1
    )
    bare = F.regexp_replace(found, "-", "")
    return F.when((bare != "") & (bare != "0" * 32), bare)
