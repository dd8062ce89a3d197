"""What changed between two points of a story."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazetta.functions.quantity import amount, material
from gazetta.functions.text import humanise

#: The two families of fact types.
NUMERIC = ["magnitude", "tally", "price", "percentage"]
CATEGORICAL = ["status", "position", "date"]


def classify(kind: Column, old: Column, new: Column, old_kind: Column, relative: float = 0.15, absolute: float = 0.0) -> Column:
    """The type of a change worth a note, else null.

    Types of different families don't compare; a tally must climb; numbers
    must pass the bar; words must differ once lower-cased and trimmed.
    A change is rounded to nine digits, so that from 1.00 to 1.15 is 15 %.
    """
    a, b = amount(old), amount(new)
    numeric = kind.isin(NUMERIC) & old_kind.isin(NUMERIC) & a.isNotNull() & b.isNotNull()
    words = kind.isin(CATEGORICAL) & old_kind.isin(CATEGORICAL) & old.isNotNull() & new.isNotNull()
    moved = material(a, b, relative, absolute, digits=9)
    return F.when(numeric & (kind == "tally") & (b > a) & moved, kind).when(numeric & (kind != "tally") & moved, kind).when(words & (F.lower(F.trim(old)) != F.lower(F.trim(new))), kind)


def note(label: Column, kind: Column, old: Column, new: Column, day: Column) -> Column:
    """A line for the brief; prices with their change in percent, rounded half to even."""
    a, b = amount(old), amount(new)
    change = F.bround((b - a) / F.abs(a) * 100, 0).cast("int")
    signed = F.concat(F.when(change >= 0, "+").otherwise(""), change.cast("string"), F.lit("%"))
    price = F.concat(label, F.lit(": was $"), humanise(a), F.lit(" on "), F.date_format(day, "yyyy-MM-dd"), F.lit(", now $"), humanise(b), F.lit(" ("), signed, F.lit(")"))
    return F.when((kind == "price") & a.isNotNull() & b.isNotNull() & (a != 0), price).otherwise(F.concat(label, F.lit(": was "), old, F.lit(", now "), new))
