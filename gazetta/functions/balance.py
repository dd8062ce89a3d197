"""Column expressions on source leanings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_bias(bias: Column) -> Column:
    """left, right, center or null, tested in this order."""
    low = F.lower(bias)
    middle = F.contains(low, F.lit("cent")) | F.contains(low, F.lit("middle"))
    return F.when(F.contains(low, F.lit("left")), "left").when(F.contains(low, F.lit("right")), "right").when(middle, "center")


def skew(left: Column, right: Column, placed: Column, least: int = 3, share: float = 0.75) -> Column:
    """``left n/m`` or ``right n/m`` where one side dominates and the other is absent."""

    def said(name: str, n: Column) -> Column:
        return F.concat(F.lit(name + " "), n.cast("string"), F.lit("/"), placed.cast("string"))

    enough = (placed >= least) & ~((left > 0) & (right > 0))
    return F.when(enough & (left >= placed * share), said("left", left)).when(enough & (right >= placed * share), said("right", right))


def coverage(left: Column, right: Column, center: Column) -> Column:
    """The side that all placed sources share; null with a centre or both sides."""
    return F.when((left > 0) & (right == 0) & (center == 0), "left").when((right > 0) & (left == 0) & (center == 0), "right")
