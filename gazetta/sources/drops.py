"""The store of drop reports, by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions.text import slug
from gazetta.session import sized


def find(store: DataFrame, wanted: DataFrame, days_back: int = 10) -> DataFrame:
    """The best report for each wanted text (wanted_id, said): newest date, an exact slug before a containing one, then position.

    ``store`` is (date, slug, position, report_id); only its newest
    ``days_back`` dates count. Substrings need a nested loop: the wanted texts,
    a user's questions, are broadcast up to a bound of rows, counted first.
    """
    newest = store.select("date").distinct().orderBy(F.desc("date")).limit(days_back)
    recent = store.join(sized(newest), "date", "left_semi")
    asked = wanted.select("wanted_id", slug(F.regexp_replace("said", r"(?i)^\s*more:\s*", "")).alias("ask"))
    hits = recent.join(sized(asked), F.contains(F.col("slug"), F.col("ask")))
    rank = F.when(F.col("slug") == F.col("ask"), 0).otherwise(1)
    n = F.row_number().over(Window.partitionBy("wanted_id").orderBy(F.desc("date"), rank, "position", "report_id"))
    return hits.withColumn("n", n).where("n = 1").select("wanted_id", "report_id")
