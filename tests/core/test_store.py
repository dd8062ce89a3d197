"""Stores by date, exports, and batches to two sinks with crashes between them."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gazetta.sources import run_log, store
from gazetta.streaming import jobs

DAY = dt.datetime(2026, 1, 1)


def rows(spark, days, tag="a"):
    return spark.createDataFrame([(d * 10 + i, DAY + dt.timedelta(days=d, hours=i * 5), tag) for d in days for i in range(5)], "id long, ts timestamp, tag string")


def test_a_window_reads_its_dates_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.write_dates(rows(spark, range(9)), path, "ts")
    now = DAY + dt.timedelta(days=6, hours=6)
    found = store.read_window(spark, path, "ts", F.lit(now) - F.expr("interval 24 hours"), F.lit(now))
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "date" in filters and ">=" in filters and "<=" in filters and "PushedFilters" in plan
    assert sorted(r.id for r in found.collect()) == [52, 53, 54, 60, 61]
    # Folders of other dates may go: they are not touched.
    read = {Path(f).parent.name for f in found.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert read == {"date=2026-01-06", "date=2026-01-07"}


def test_dates_are_replaced_one_by_one(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.write_dates(rows(spark, range(3)), path, "ts")
    store.write_dates(rows(spark, [1], "b").where("id < 13"), path, "ts")
    got = {(r.id, r.tag) for r in spark.read.parquet(path).collect()}
    assert got == {(i, "a") for i in (*range(5), *range(20, 25))} | {(i, "b") for i in (10, 11, 12)}


def test_export_of_briefs(spark, tmp_path):
    cited = [("x", dt.date(2026, 1, 1), 2, 7, "Second", "https://a/7", "Paper"), ("x", dt.date(2026, 1, 1), 1, 9, "First", "https://a/9", None), ("x", dt.date(2026, 1, 2), 1, 7, "Other day", None, "Paper")]
    df = spark.createDataFrame(cited, "brief string, date date, position int, id long, title string, url string, name string")
    store.export_briefs(df, str(tmp_path))
    store.export_briefs(df.where("date = '2026-01-01'"), str(tmp_path))  # once more: it replaces itself
    files = {p.parent.parent.name: p.read_text() for p in tmp_path.glob("markdown/*/*/*.txt")}
    assert files["date=2026-01-01"] == "# Brief x\n\n- [First](https://a/9) — Unknown\n- [Second](https://a/7) — Paper\n\n" and len(files) == 2
    lines = [json.loads(x) for p in tmp_path.glob("json/date=2026-01-01/*.json") for x in p.read_text().splitlines()]
    assert [[a["id"] for a in b["articles"]] for b in lines] == [[9, 7]]


RUNS = "run_id long, task string, agent string, cost decimal(18,6), status string, trace_id string, artifact_verified boolean"


@pytest.mark.parametrize("breaks", ["first", "second", "after"])
def test_a_crash_between_two_sinks_leaves_both_whole(spark, tmp_path, breaks):
    """The batch comes again under its number: nothing is missing, nothing is there twice, and the sinks agree."""
    df = spark.createDataFrame([(i, None if i % 2 else "brief", "writer" if i % 3 else None, None, "success", None, None) for i in range(20)], RUNS)
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    crashed = []

    def broken(name, sink):
        def write(part, batch):
            if name == breaks and not crashed:
                if name == "second":  # half of it is there
                    part.limit(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={batch}")
                crashed.append(batch)
                raise RuntimeError("crash")
            sink(part, batch)
            if breaks == "after" and name == "second" and not crashed:
                crashed.append(batch)
                raise RuntimeError("crash")

        return write

    def go():
        sinks = [broken(n, store.batch_sink(f"{tmp_path}/{n}")) for n in ("first", "second")]
        store.two_sinks(jobs.files(spark, f"{tmp_path}/in", df, per_trigger=1), f"{tmp_path}/cp", run_log.log_and_mirror, *sinks, f"{tmp_path}/kept").awaitTermination()

    with pytest.raises(Exception, match="crash"):
        go()
    go()
    log, mirror = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("first", "second"))
    assert sorted(r.run_id for r in log.collect()) == sorted(r.run_id for r in mirror.collect()) == list(range(20))
    assert log.join(mirror, ["run_id", "batch"]).count() == 20 and "trace_id" not in log.columns
    assert {(r.task_type, r.trace_id, r.actual_cost, r.artifact_verified) for r in mirror.collect()} == {("brief", t, 0.0, False) for t in ("solo-writer", "solo-?")}
