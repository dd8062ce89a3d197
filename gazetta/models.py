"""Articles, sources and the other model tables, as views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.session import table

#: Every operator takes its time as a parameter; the queries use this one.
AS_OF = "2024-01-03 21:00:00"


def as_of(ts: str = AS_OF):
    return F.lit(ts).cast("timestamp")


def topic_list(title):
    """The first five distinct lower-case words of five letters or more."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("[a-z]{5,}"), F.lit(0))), 1, 5)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, source_no, name, category, bias: a row for each supplier."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    no = (F.col("s_suppkey") - 1).alias("source_no")
    found = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    bias = F.element_at(F.array(F.lit("Left"), F.lit("Center"), F.lit("Lean Right"), F.lit(None)), (F.pmod(F.col("s_suppkey") - 1, F.lit(4)) + 1).cast("int"))
    return found.select(F.concat(F.lit("src"), (F.col("s_suppkey") - 1).cast("string")).alias("source_id"), no, F.col("s_name").alias("name"), F.col("r_name").alias("category"), bias.alias("bias"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, published_at, title, body, source_id, n_chars, relevance, actionability, topics."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    # The title is cut before the join, so whole texts are shuffled only for those who read the body.
    d = table(spark, sf_dir, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    return d.join(e, F.col("doc_id") == F.col("event_id")).select(
        F.col("doc_id").alias("id"),
        F.col("ts").cast("timestamp").alias("published_at"),
        "title",
        F.col("text").alias("body"),
        F.col("source").alias("source_id"),
        "n_chars",
        (F.col("n_chars") % 11).cast("int").alias("relevance"),
        (F.col("doc_id") * 7 % 4).cast("int").alias("actionability"),
        topic_list(F.col("title")).alias("topics"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored subset: one row per labelled document."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), "quality", "toxic")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, account, from finished orders."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.select(F.col("o_orderkey").alias("article_id"), F.concat(F.lit("acct"), (F.col("o_custkey") % 3).cast("string")).alias("account"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per step run: task, agent, cost, status, created_at."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.nullif("event_type", F.lit("signup")).alias("task"),
        F.concat(F.lit("agent"), (F.col("user_id") % 5).cast("string")).alias("agent"),
        F.col("value").cast("decimal(18,6)").alias("cost"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


#: The same views for DuckDB, as a list of common table expressions.
SQL = """
src AS (
  SELECT 'src' || CAST(s_suppkey - 1 AS VARCHAR) AS source_id, s_suppkey - 1 AS source_no, s_name AS name, r_name AS category,
    CASE (s_suppkey - 1) % 4 WHEN 0 THEN 'Left' WHEN 1 THEN 'Center' WHEN 2 THEN 'Lean Right' END AS bias
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
), base AS (
  SELECT doc_id AS id, ts AS published_at, split_part(text, chr(10), 1) AS title, text AS body, source AS source_id, n_chars,
    CAST(n_chars % 11 AS INTEGER) AS relevance, CAST(doc_id * 7 % 4 AS INTEGER) AS actionability,
    regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]{5,}') AS w
  FROM documents JOIN events ON event_id = doc_id
), art AS (
  SELECT * EXCLUDE (w), list_filter(w, lambda x, i: list_position(w, x) = i)[1:5] AS topics FROM base
), scored AS (SELECT doc_id AS article_id, quality, toxic FROM labels
), dlv AS (SELECT o_orderkey AS article_id, 'acct' || CAST(o_custkey % 3 AS VARCHAR) AS account FROM orders WHERE o_orderstatus = 'F'
), runs AS (
  SELECT event_id AS run_id, nullif(event_type, 'signup') AS task, 'agent' || CAST(user_id % 5 AS VARCHAR) AS agent,
    CAST(value AS DECIMAL(18, 6)) AS cost, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ts AS created_at FROM events
)
"""


def with_models(body: str) -> str:
    return f"WITH RECURSIVE {SQL.strip()}{body if body.lstrip().startswith(',') else ' ' + body}"
