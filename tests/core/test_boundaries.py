"""Values that lie on a bar, or where rounding twice gives another number."""

import datetime as dt

from pyspark.sql import functions as F

from gazetta.functions import briefs, deltas
from gazetta.operators import aggregates
from gazetta.queries import QUERIES


def test_centroids_are_rounded_once(spark):
    # -0.0009724997 is -0.0009725 with nine digits, and that -0.000973 with six.
    rows = spark.createDataFrame([(1, [-0.0009724997, 0.5])], "label int, embedding array<double>")
    assert [list(r["centroid"]) for r in aggregates.centroid(rows, "label", digits=6).collect()] == [[-0.000972, 0.5]]


def test_a_brief_at_the_overrun_itself_is_just_over(spark):
    rows = spark.createDataFrame([(n, "## A\n[s](u)".ljust(n, "x")) for n in (3000, 3001, 3450, 3451)], "id int, content string")
    found = briefs.critic(rows, "id", "content", 3000, least_themes=1, overrun=1.15).collect()
    assert sorted((r["id"], r["rule"]) for r in found) == [(3001, "char_over_cap"), (3450, "char_over_cap"), (3451, "char_overrun")]
    n = rows.select("id", briefs.over_cap(F.col("id"), 3000, 1.15).alias("over"))
    assert [r["over"] for r in n.orderBy("id").collect()] == [None, None, None, 451]


def test_changes_of_the_bar_itself_are_worth_a_note(spark):
    rows = [("tally", "1.00", "1.15"), ("tally", "1.20", "1.38"), ("tally", "2.00", "2.29"), ("price", "1.15", "1.00"), ("price", "2.00", "1.70")]
    kind, old, new = (F.col(c) for c in ("k", "a", "b"))
    got = spark.createDataFrame(rows, "k string, a string, b string").select("k", "a", "b", deltas.classify(kind, old, new, kind).alias("d"))
    assert [r["a"] + " " + r["b"] for r in got.collect() if r["d"]] == ["1.00 1.15", "1.20 1.38", "2.00 1.70"]


def test_a_scan_of_a_day_has_all_from_its_start_on(spark, tmp_path):
    times = [dt.datetime(2024, 1, 2, 20, 59, 59), dt.datetime(2024, 1, 2, 21), dt.datetime(2024, 1, 3, 20), dt.datetime(2024, 1, 3, 21), dt.datetime(2024, 1, 9)]
    spark.createDataFrame(list(enumerate(times)), "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, "Title\ntext", "en", "src0", 10) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["id"] for r in QUERIES["a14_window_scan"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
