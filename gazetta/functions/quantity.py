"""Numbers in text, and whether a change of one matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale words and their factors.
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "trillion": 1e12}
#: The first number of a text, the letters right after it, and all that follows them.
FIRST = r"(?s)^[^0-9]*?(-?[0-9][0-9,]*(?:\.[0-9]*)?)\s*([a-z]*)(.*)$"


def _factor(low: Column) -> Column:
    return F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), F.lit(v))])[F.regexp_extract(low, FIRST, 2)]


def amount(text: Column) -> Column:
    """The first number, scaled by a scale word right after it; null without one. A minus before it counts, a plus does not matter."""
    low = F.lower(text)
    return F.replace(F.regexp_extract(low, FIRST, 1), F.lit(","), F.lit("")).try_cast("double") * F.coalesce(_factor(low), F.lit(1.0))


def unit(text: Column) -> Column:
    """``%`` where there is one, else what stands after the number and its scale up to white space; null without."""
    low = F.lower(text)
    after = F.concat(F.when(_factor(low).isNull(), F.regexp_extract(low, FIRST, 2)).otherwise(F.lit("")), F.regexp_extract(low, FIRST, 3))
    token = F.regexp_extract(after, r"^\s*(\S+)", 1)
    return F.when(F.regexp_extract(low, FIRST, 1) == "", None).when(F.contains(text, F.lit("%")), "%").when(token != "", token)


def material(old: Column, new: Column, relative: float, absolute: float, digits: int | None = None) -> Column:
    """By the absolute bar (off at 0 or less) or the relative bar (never from a base of 0); the change may be rounded to ``digits``."""
    change = F.abs(new - old if digits is None else F.round(new - old, digits))
    by_size = (change >= absolute) if absolute > 0 else F.lit(False)
    return by_size | ((old != 0) & (change / F.abs(old) >= relative))


def week_key(ts: Column, zone: str, hours: int = 6) -> Column:
    """The Monday of the local week, which begins at ``hours`` o'clock."""
    local = F.from_utc_timestamp(ts, zone) - F.expr(f"interval {hours} hours")
    return F.to_date(F.date_trunc("week", local))


def day_start(ts: Column, zone: str) -> Column:
    """The UTC time at which the local day of ``ts`` began."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths, empty or zero vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))
