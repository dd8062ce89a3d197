"""Registry rows with their errors beside them, instead of exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validated(rows: DataFrame, required: list[str], unique: str) -> DataFrame:
    """``rows`` with an error column: the first missing field, else a duplicate key; null where a row is sound."""
    error = F.lit(None).cast("string")
    twice = F.count("*").over(Window.partitionBy(unique)) > 1
    error = F.when(twice, f"duplicate {unique}")
    for c in reversed(required):
        error = F.when(F.col(c).isNull(), f"missing {c}").otherwise(error)
    return rows.withColumn("error", error)
