"""J rows: the batch twins of the streaming jobs, and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta import models
from gazetta.functions.quantity import week_key
from gazetta.models import with_models
from gazetta.queries.registry import query
from gazetta.operators import filters
from gazetta.plans import threads
from gazetta.session import stash_dir, table
from gazetta.streaming import jobs, ordered


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as the table may be one file or a folder of files.
    return jobs.files(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events"))


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream over the landed files yields, written to the shared folder."""
    spark = stream.sparkSession
    base = f"{stash_dir(spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_available(stream, f"{base}/out", f"{base}/checkpoint", mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("j01_first_seen_batch", "SELECT min(event_id) AS event_id, user_id, event_type FROM events WHERE (user_id, event_type, ts) IN (SELECT (user_id, event_type, min(ts)) FROM events GROUP BY user_id, event_type) GROUP BY ALL")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("at"), F.concat_ws("/", "user_id", "event_type").alias("key"))
    return jobs.first_seen(rows, "key", "at").select("event_id", "user_id", "event_type")


@query("j01_first_seen_stream", "SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds FROM events")
def first_seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event lands twice; each comes out once."""
    rows = _landed(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return _drained(jobs.first_seen(rows, "event_id", "ts")).select("event_id", F.unix_seconds("ts").alias("seconds"))


@query(
    "j04_gap_refresh",
    "WITH l AS (SELECT max(event_id) AS m FROM events) SELECT event_id, CASE WHEN event_id < m // 2 THEN 1 ELSE 2 END AS run FROM events, l WHERE (event_id < m // 2 AND ts >= TIMESTAMP '2024-01-03 21:00:00' - INTERVAL '72' HOUR) OR (event_id >= m // 2 AND ts >= TIMESTAMP '2024-01-03 21:00:00' - INTERVAL '6' HOUR)",
)
def gap_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs a day over one landing folder: the first with the sources' own window, the second, over what has landed since, with the gap as its cap."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    half = (e.agg(F.max("event_id")).first()[0] or 0) // 2
    base = f"{stash_dir(spark)}/stream-{uuid.uuid4().hex}"
    for run, part, cap in ((1, F.col("event_id") < half, None), (2, F.col("event_id") >= half, 6)):
        e.where(part).write.mode("append").parquet(f"{base}/landed")
        hours = filters.freshness_window(F.lit(72), cap=cap)
        fresh = jobs.files(spark, f"{base}/landed", e).where(filters.in_window(F.col("ts"), models.as_of(), hours)).select("event_id", F.lit(run).alias("run"))
        jobs.run_available(fresh, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(fresh.schema).parquet(f"{base}/out")


@query(
    "j07_delivered_once",
    "SELECT DISTINCT o_custkey AS brief, 'acct' || CAST(o_custkey % 3 AS VARCHAR) AS account, CAST(1 AS BIGINT) AS sent, CAST(0 AS BIGINT) AS unconfirmed FROM orders WHERE o_orderstatus = 'F'",
)
def delivered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries streamed twice, the second time without a checkpoint, as after its loss: the ledger keeps each from being sent again."""
    account = F.concat(F.lit("acct"), (F.col("o_custkey") % 3).cast("string"))
    rows = table(spark, sf_dir, "orders")
    base = f"{stash_dir(spark)}/stream-{uuid.uuid4().hex}"
    for run in (1, 2):
        stream = jobs.files(spark, f"{sf_dir}/orders.parquet*", rows).where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("brief"), account.alias("account"))
        jobs.deliver_once(stream, f"{base}/ledger", f"{base}/checkpoint{run}", ["brief", "account"], lambda x: x.write.mode("append").parquet(f"{base}/sent")).awaitTermination()
    sent = spark.read.schema(stream.schema).parquet(f"{base}/sent")
    open_keys = jobs.unconfirmed(spark, f"{base}/ledger", sent).withColumn("open", F.lit(1))
    out = sent.groupBy("brief", "account").agg(F.count("*").alias("sent")).join(open_keys, ["brief", "account"], "left")
    return out.select("brief", "account", "sent", F.coalesce("open", F.lit(0)).cast("long").alias("unconfirmed"))


DAYS = "SELECT CAST(epoch_us(date_trunc('day', created_at)) // 1000000 AS BIGINT) AS start, CAST(epoch_us(date_trunc('day', created_at)) // 1000000 AS BIGINT) + 86400 AS \"end\", count(*) AS runs, count(*) FILTER (status <> 'success') AS errors, round(CAST(sum(coalesce(cost, 0)) AS DOUBLE), 6) AS cost FROM runs GROUP BY 1, 2"


@query("j05_daily_cost", with_models(DAYS))
def daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.windowed_cost(models.runs(spark, sf_dir))


@query(
    "j05_sliding_cost",
    with_models(", w AS (SELECT CAST(epoch_us(created_at) // 3600000000 * 3600 AS BIGINT) - 3600 * unnest(range(24)) AS start, cost, status FROM runs) SELECT start, start + 86400 AS \"end\", count(*) AS runs, count(*) FILTER (status <> 'success') AS errors, round(CAST(sum(coalesce(cost, 0)) AS DOUBLE), 6) AS cost FROM w GROUP BY start"),
)
def sliding_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.windowed_cost(models.runs(spark, sf_dir), length="24 hours", slide="1 hour")


@query(
    "j05_daily_cost_stream",
    with_models(DAYS.replace("SELECT CAST", "SELECT * FROM (SELECT CAST", 1) + ") WHERE \"end\" <= (SELECT epoch_us(max(created_at)) FROM runs) / 1000000.0 - 3600"),
)
def daily_cost_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a stream: windows that no late row can reach any more."""
    e = _landed(spark, sf_dir)
    runs = e.select(F.col("value").cast("decimal(18,6)").alias("cost"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("ts").cast("timestamp").alias("created_at"))
    return _drained(jobs.windowed_cost(runs))


SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) // 1000000 AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, s.n"""


@query("j05_sessions", SESSIONS)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.sessions(rows, "user_id", "ts")


ENDED = "(SELECT epoch_ms(max(ts)) - 3600000 FROM events)"


@query("j05_sessions_stream", f"SELECT * FROM ({SESSIONS.replace('count(*) AS n FROM s', 'count(*) AS n, max(ts) AS last FROM s')}) x WHERE epoch_ms(last) + 1800000 <= {ENDED}".replace("SELECT * FROM (", "SELECT user_id, start, n FROM (", 1))
def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a stream: sessions that no late row can lengthen any more."""
    rows = _landed(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(jobs.sessions(rows, "user_id", "ts"))


@query("j05_sliding_cost_stream", with_models(", w AS (SELECT CAST(epoch_us(created_at) // 3600000000 * 3600 AS BIGINT) - 3600 * unnest(range(24)) AS start, cost, status FROM runs) SELECT start, start + 86400 AS \"end\", count(*) AS runs, count(*) FILTER (status <> 'success') AS errors, round(CAST(sum(coalesce(cost, 0)) AS DOUBLE), 6) AS cost FROM w WHERE start + 86400 <= (SELECT epoch_us(max(created_at)) FROM runs) / 1000000.0 - 3600 GROUP BY start"))
def sliding_cost_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _landed(spark, sf_dir)
    runs = e.select(F.col("value").cast("decimal(18,6)").alias("cost"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("ts").cast("timestamp").alias("created_at"))
    return _drained(jobs.windowed_cost(runs, length="24 hours", slide="1 hour"))


ROLLED = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
o AS (SELECT user_id, s.n, count(*) AS k, epoch_us(max(ts)) + 1800000000 AS ends, epoch_us(min(ts)) AS begins FROM s GROUP BY ALL)
SELECT (ends - 1) // 86400000000 * 86400 AS start, count(*) AS sessions, CAST(sum(k) AS BIGINT) AS events, max(k) AS most, max(ends - begins) AS longest FROM o GROUP BY 1"""


@query("j05_daily_sessions", ROLLED)
def daily_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.daily_sessions(rows, "user_id", "ts")


@query("j05_daily_sessions_stream", f"SELECT * FROM ({ROLLED}) x WHERE (start + 86400) * 1000 <= {ENDED}")
def daily_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows and the daily roll-up in one streaming query: days that are over."""
    rows = _landed(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(jobs.daily_sessions(rows, "user_id", "ts"))


MOVES = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS m, event_id AS tie, value FROM events WHERE value IS NOT NULL),
p AS (SELECT *, lag(value) OVER w AS before, lag(m) OVER w AS since FROM e WINDOW w AS (PARTITION BY key ORDER BY m, tie)),
f AS (SELECT key, m, tie, CASE WHEN m - since <= 86400000 THEN before END AS old, value FROM p)
SELECT key, m AS "at", tie, old, value FROM f WHERE old IS NOT NULL AND (abs(value - old) >= 30 OR (old <> 0 AND abs(value - old) / abs(old) >= 5))"""


def _facts(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), "value")


@query("j08_moved_facts", MOVES)
def moved_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values as facts; a day without one ends what is known."""
    return ordered.moved_facts(_facts(table(spark, sf_dir, "events")), 5.0, 30.0, idle=86_400_000)


@query("j08_moved_facts_stream", f"{MOVES} AND m <= {ENDED}")
def moved_facts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(ordered.moved_facts(_facts(_landed(spark, sf_dir)), 5.0, 30.0, idle=86_400_000))


GATE = """
WITH m AS (SELECT conv_id % 7 AS chat, conv_id AS conversation, turn, CASE WHEN role = 'user' AND conv_id % 9 > 0 THEN 'guest' ELSE 'owner' END AS sender, lower(coalesce(text, '')) AS t,
  1704067200000 + (conv_id * 37 % 97) * 3600000 + turn * 60000 AS ms FROM conversations),
k AS (SELECT *, ms // 86400000 AS day, CASE WHEN sender = 'owner' THEN 'owner' WHEN chat = 6 THEN 'ignored' WHEN contains(t, 'schst') OR contains(t, 'aipa') THEN 'approval' ELSE 'guest' END AS said FROM m),
t AS (SELECT *, sum(CAST(said = 'guest' AS INTEGER)) OVER (PARTITION BY chat, conversation ORDER BY ms, conversation, turn) AS talk FROM k),
d AS (SELECT *, sum(CAST(said = 'guest' AND talk <= 2 AS INTEGER)) OVER (PARTITION BY chat, day ORDER BY ms, conversation, turn) AS used FROM t)
SELECT chat, conversation, turn, CASE WHEN said <> 'guest' THEN said WHEN talk > 2 THEN 'turn cap' WHEN used <= 3 THEN 'answer' ELSE 'daily cap' END AS decision,
  CASE WHEN contains(t, 'eaux') OR contains(t, 'ther') THEN 'ur' ELSE 'en' END AS language FROM d"""


def _decided(c: DataFrame) -> DataFrame:
    """Talks begin at hours that their numbers scatter over four days, so they arrive out of order; turns are a minute apart."""
    guest = (F.col("role") == "user") & (F.col("conv_id") % 9 > 0)
    ts = F.timestamp_millis(F.lit(1704067200000) + (F.col("conv_id") * 37 % 97) * 3600000 + F.col("turn") * 60000)
    rows = c.select((F.col("conv_id") % 7).alias("chat"), F.col("conv_id").alias("conversation"), "turn", F.when(guest, "guest").otherwise("owner").alias("sender"), "text", ts.alias("ts"))
    return ordered.decided(rows, read_only=F.col("chat") == 6, writes=["schst", "aipa"], markers=["eaux", "ther"], per_talk=2, per_day=3)


@query("j06_message_gate", GATE)
def message_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(table(spark, sf_dir, "conversations"))


@query("j06_message_gate_stream", f"{GATE} WHERE ms <= (SELECT max(ms) - 3600000 FROM m)")
def message_gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with state: a chat's day, what it has used, its talks."""
    return _drained(_decided(jobs.files(spark, f"{sf_dir}/conversations.parquet*", table(spark, sf_dir, "conversations"), per_trigger=1_000_000)))


def _stories(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors as the stories of three accounts' runs, one every three hours; the value of their document's event is the fact."""
    v = vectors.select(F.col("vec_id").alias("event_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    ts = F.timestamp_seconds((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 10800) + 1) * 10800)
    kind = F.element_at(F.array(F.lit("magnitude"), F.lit("tally"), F.lit("price"), F.lit("status")), (F.col("event_id") % 4 + 1).cast("int"))
    value = F.when(kind == "status", F.col("event_type")).otherwise(F.round("value", 1).cast("string"))
    return events.join(v, "event_id").select(
        F.concat(F.lit("acct"), (F.col("event_id") % 3).cast("string")).alias("account"),
        week_key(ts, "UTC").cast("string").alias("week"),
        ts.alias("ts"),
        F.col("event_id").alias("place"),
        F.col("event_id").alias("story_id"),
        F.concat(F.lit("story "), F.col("event_id").cast("string")).alias("label"),
        "vector",
        (F.col("event_id") % 4 != 0).alias("many"),
        F.when(F.col("event_id") % 10 != 3, kind).alias("kind"),
        value.alias("value"),
        F.lit(None).cast("string").alias("unit"),
        (F.col("event_id") % 8 / 8.0).alias("confidence"),
        F.array("event_id", F.col("event_id") + 1).alias("ids"),
    )


RULES = threads.Rules(similarity=0.3, confidence=0.2)


@query("j02_threads")
def story_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each story gave its thread, and what changed. ``tests/core/test_threads.py`` has the rule one story after the other."""
    return threads.track(_stories(table(spark, sf_dir, "events"), table(spark, sf_dir, "embeddings")), RULES)


@query("j02_threads_stream")
def story_threads_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as state, with a week's threads dropped by a timer: the runs that are over."""
    return _drained(threads.track(_stories(_landed(spark, sf_dir), table(spark, sf_dir, "embeddings")), RULES))


@query("j03_replay")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's last seven runs from an empty state, with deltas; no week ends in a replay."""
    return threads.replay(_stories(table(spark, sf_dir, "events"), table(spark, sf_dir, "embeddings")), 7, RULES)
