"""The delivery ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_entries(parts: DataFrame, ledger: DataFrame, brief: str = "brief_id") -> DataFrame:
    """(brief, article): briefs whose parts are all confirmed and that the ledger lacks, each pair once."""
    confirmed = parts.groupBy(brief).agg(F.every(F.coalesce("confirmed", F.lit(False))).alias("ok")).where("ok").select(brief)
    fresh = confirmed.join(ledger.select(brief).distinct(), brief, "left_anti")
    return parts.join(fresh, brief, "left_semi").select(brief, "article_id").distinct()
