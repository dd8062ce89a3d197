"""Structured Streaming jobs. Each has a batch twin that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def files(spark, path: str, like: DataFrame, per_trigger: int = 16) -> DataFrame:
    """Landed Parquet files as a stream with a known schema."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what has landed, then stop. The next call goes on from the checkpoint."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def first_seen(rows: DataFrame, key: str, ts: str, delay: str = "7 days") -> DataFrame:
    """Each key once within the delay; a stream or a table.

    On a table the first row by time is kept; a stream keeps the first to arrive.
    """
    if rows.isStreaming:
        return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    n = F.row_number().over(Window.partitionBy(key).orderBy(ts))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def _marked(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    return rows.withWatermark(ts, delay) if rows.isStreaming else rows


def windowed_cost(runs: DataFrame, ts: str = "created_at", length: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Runs, errors and cost in tumbling or sliding windows."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    cost = F.round(F.sum(F.coalesce(F.col("cost").cast("double"), F.lit(0.0))), 6)
    out = _marked(runs, ts, delay).groupBy(w).agg(F.count("*").alias("runs"), F.count_if(F.col("status") != "success").alias("errors"), cost.alias("cost"))
    return out.select(F.unix_seconds("window.start").alias("start"), F.unix_seconds("window.end").alias("end"), "runs", "errors", "cost")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Each key's sessions: first second, length, events."""
    out = _marked(events, ts, delay).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return out.select(key, F.unix_seconds("session_window.start").alias("start"), "n")


def daily_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions rolled up by the day they end in: how many, their events, the longest. Two stateful steps in one query.

    A session closes when the watermark passes its end, and a day when it
    passes the day's; the first step's watermark is the second's.
    """
    one = _marked(events, ts, delay).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    # window_time keeps the event time of a session, so that the day's window can follow it.
    timed = one.select(F.window_time("session_window").alias("ended"), "n", (F.unix_micros("session_window.end") - F.unix_micros("session_window.start")).alias("micros"))
    out = timed.groupBy(F.window("ended", "1 day")).agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("most"), F.max("micros").alias("longest"))
    return out.select(F.unix_seconds("window.start").alias("start"), "sessions", "events", "most", "longest")


def ledger_rows(spark, ledger: str, key: DataFrame, stage: str) -> DataFrame | None:
    """What a stage (claimed, confirmed) of the ledger holds; null where nothing was entered yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{stage}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(key.schema.add("batch_id", "long")).parquet(f"{ledger}/{stage}")


def deliver_once(stream: DataFrame, ledger: str, checkpoint: str, key: list[str], send: Callable[[DataFrame], None]) -> StreamingQuery:
    """Send rows that the ledger lacks, each key once at most.

    Keys are claimed before they are sent and confirmed after. A batch that is
    repeated finds its claims: it sends nothing again, and keys claimed but
    never confirmed are left for a person to look at (``unconfirmed``).
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates(key)
        had = ledger_rows(spark, ledger, fresh.select(*key), "claimed")
        if had is not None:
            fresh = fresh.join(had.select(*key), key, "left_anti")
        # The claim is written first, and what is sent is what was claimed.
        place = f"batch_id={batch_id}/try={uuid.uuid4().hex}"
        fresh.write.parquet(f"{ledger}/rows/{place}")
        mine = spark.read.schema(fresh.schema).parquet(f"{ledger}/rows/{place}")
        mine.select(*key).write.mode("append").parquet(f"{ledger}/claimed/batch_id={batch_id}")
        send(mine)
        mine.select(*key).write.mode("append").parquet(f"{ledger}/confirmed/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unconfirmed(spark, ledger: str, key: DataFrame) -> DataFrame:
    """Keys that were claimed and never confirmed: sent or not, nobody knows."""
    claimed, done = (ledger_rows(spark, ledger, key, stage) for stage in ("claimed", "confirmed"))
    if claimed is None:
        return key.limit(0)
    rows = claimed.select(*key.columns).distinct()
    return rows if done is None else rows.join(done.select(*key.columns), key.columns, "left_anti")
