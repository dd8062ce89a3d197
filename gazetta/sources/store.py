"""Tables kept by date, and writes of one batch to two sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gazetta.session import stash

DATE = "date"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_dates(rows: DataFrame, path: str, ts: str | None, fmt: str = "parquet", per_file: int = 2_000_000, below: list[str] | None = None) -> None:
    """Write ``rows`` in folders by the date of ``ts`` (or their column ``date``) and the columns ``below``; folders that they fill are replaced, others stay.

    Rows are shuffled by date first, and a large date is dealt over several
    tasks by AQE, so a date has few files and no task has a date as a whole.
    Rows without a time are kept under the default partition.
    """
    dated = rows if ts is None else rows.withColumn(DATE, F.to_date(ts))
    (
        dated.hint("rebalance", F.col(DATE)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", per_file).partitionBy(DATE, *(below or [])).format(fmt).save(path)
    )


def read_window(spark: SparkSession, path: str, ts: str, since: Column, until: Column | None = None, fmt: str = "parquet") -> DataFrame:
    """Rows of ``ts`` from ``since`` on (and before ``until``): only the folders of those dates are read."""
    rows = spark.read.format(fmt).load(path)
    part = (F.col(DATE) >= F.to_date(since)) & (F.col(ts) >= since)
    if until is not None:
        part = part & (F.col(DATE) <= F.to_date(until)) & (F.col(ts) < until)
    return rows.where(part)


def export_briefs(cited: DataFrame, path: str) -> None:
    """Every brief as a JSON line, and as a Markdown file of its own, by date. cited: brief, date, position, id, title, url, name.

    Missing articles have been left out by the join that made ``cited``. A
    repeated export of a date replaces it.
    """
    item = F.struct("position", "id", "title", "url", "name")
    # Both exports are written from one result of the joins.
    briefs = stash(cited.groupBy("brief", DATE).agg(F.array_sort(F.collect_list(item)).alias("articles")))
    write_dates(briefs, f"{path}/json", None, "json")
    line = lambda x: F.concat(F.lit("- ["), F.coalesce(x["title"], F.lit("")), F.lit("]("), F.coalesce(x["url"], F.lit("")), F.lit(") — "), F.coalesce(x["name"], F.lit("Unknown")))
    text = F.concat(F.lit("# Brief "), F.col("brief").cast("string"), F.lit("\n\n"), F.array_join(F.transform("articles", line), "\n"), F.lit("\n"))
    # A text file has one column besides its folders.
    write_dates(briefs.select(text.alias("value"), DATE, "brief"), f"{path}/markdown", None, "text", below=["brief"])


Sink = Callable[[DataFrame, str], None]


def batch_sink(path: str) -> Sink:
    """A sink whose batches are folders: a batch that is written again replaces itself, so nothing is there twice or half."""

    def write(rows: DataFrame, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def two_sinks(stream: DataFrame, checkpoint: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], first: Sink, second: Sink, keep: str) -> StreamingQuery:
    """Each batch to two sinks from one pass, both under the batch's number.

    ``split`` is applied once: its input is written to ``keep`` and read back
    for both sinks, so that they agree whatever they cost to make. After a crash
    anywhere the batch comes again with its number; what was
    written of it is replaced, and the kept rows are used if they are whole.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        place = f"{keep}/batch={number}"
        # _SUCCESS is written last: without it the rows may be there in part.
        if not _exists(spark, f"{place}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(place)
        one, other = split(spark.read.schema(rows.schema).parquet(place))
        first(one, str(number))
        second(other, str(number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
