"""A rows: landed data to article rows, ledgers and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta import models
from gazetta.functions import html
from gazetta.functions.text import contains_any
from gazetta.models import as_of, with_models
from gazetta.operators import filters, joins
from gazetta.queries.registry import query
from gazetta.session import sized, stash_dir, table
from gazetta.sources import run_log, store
from gazetta.streaming import jobs

ANCHORS = r"""
WITH x AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS u, regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS t FROM pages),
l AS (SELECT page_id, unnest(u) AS url, trim(regexp_replace(unnest(t), '<[^>]*>', '', 'g')) AS title, generate_subscripts(u, 1) - 1 AS position FROM x)"""


@query("a02_html_links", ANCHORS + " SELECT page_id, CAST(position AS INTEGER) AS position, url, title FROM l WHERE length(title) > 2")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_links(table(spark, sf_dir, "pages"), "page_id", "html", 2, http_only=False)


@query("a04_listing_rows", ANCHORS + ", r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS rank FROM l WHERE length(title) > 2) SELECT page_id, CAST(rank AS INTEGER) AS rank, url, title FROM r WHERE rank <= 4 AND NOT contains(lower(title), 'the')")
def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = html.html_links(table(spark, sf_dir, "pages"), "page_id", "html", 2, http_only=False)
    return html.listing_rows(links, "page_id", 4, contains_any(F.col("title"), ["the"])).select("page_id", "rank", "url", "title")


@query(
    "a05_registry",
    "WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_nationkey AS VARCHAR) END AS category FROM supplier UNION ALL SELECT s_suppkey + 1000, s_name, 'again' FROM supplier WHERE s_suppkey % 11 = 0) SELECT s_suppkey, name, CASE WHEN name IS NULL THEN 'missing name' WHEN category IS NULL THEN 'missing category' WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'duplicate name' END AS error FROM r",
)
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazetta.sources.registry import validated

    s = table(spark, sf_dir, "supplier")
    rows = s.select("s_suppkey", F.when(F.col("s_suppkey") % 7 > 0, F.col("s_name")).alias("name"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey").cast("string")).alias("category"))
    again = s.where("s_suppkey % 11 = 0").select((F.col("s_suppkey") + 1000).alias("s_suppkey"), F.col("s_name").alias("name"), F.lit("again").alias("category"))
    return validated(rows.unionByName(again), ["name", "category"], "name").select("s_suppkey", "name", "error")


@query(
    "a07_append",
    with_models("""
, n AS (SELECT art.*, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id) AS c FROM art),
f AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY source_id, c) AS k FROM n WHERE c <= 25),
s AS (SELECT DISTINCT title FROM art WHERE id % 10 = 0)
SELECT id, source_id FROM f WHERE k = 1 AND length(title) >= 15 AND title NOT IN (SELECT title FROM s)"""),
)
def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cap, then batch duplicates, then junk, then what is there already; titles stand in for addresses."""
    from pyspark.sql import Window

    a = models.articles(spark, sf_dir).select("id", "source_id", "title", "published_at")
    capped = a.withColumn("c", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("published_at"), "id"))).where("c <= 25")
    first = capped.withColumn("k", F.row_number().over(Window.partitionBy("title").orderBy("source_id", "c"))).where("k = 1 and length(title) >= 15")
    return joins.unseen(first, a.where("id % 10 = 0"), "title").select("id", "source_id")


@query("a09_score_sink", with_models("SELECT id AS article_id, relevance FROM art WHERE id NOT IN (SELECT article_id FROM scored)"))
def score_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "relevance")
    return joins.unseen(rows, models.scores(spark, sf_dir), "article_id")


@query(
    "a10_delivery_ledger",
    "WITH ok AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R')) SELECT DISTINCT l_orderkey AS brief_id, l_partkey AS article_id FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM ok) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey = l_orderkey)",
)
def delivery_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brief is entered if all of its parts are confirmed and it is not in the ledger yet."""
    from gazetta.sources.ledger import new_entries

    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("brief_id"), F.col("l_partkey").alias("article_id"), (F.col("l_returnflag") != "R").alias("confirmed"))
    had = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("brief_id"))
    return new_entries(parts, had)


@query(
    "a11_brief_export",
    with_models("""
, b AS (SELECT o_custkey % 50 AS brief, o_orderkey AS id FROM orders),
c AS (SELECT brief, CAST(published_at AS DATE) AS date, art.id, regexp_extract(title, '^[a-zA-Z]+') AS title, 'https://example.com/' || art.id AS url, coalesce(name, 'Unknown') AS name FROM b JOIN art ON art.id = b.id LEFT JOIN src USING (source_id))
SELECT brief, date, count(*) AS n, list(id ORDER BY id) AS ids, '# Brief ' || brief || chr(10) || chr(10) || string_agg('- [' || title || '](' || url || ') — ' || name, chr(10) ORDER BY id) AS markdown FROM c GROUP BY brief, date"""),
)
def brief_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fifty groups of customers cite of a day, exported as JSON and Markdown by date, and read back."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("brief"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("position"))
    a = models.articles(spark, sf_dir).select("id", "source_id", F.to_date("published_at").alias("date"), F.regexp_extract("title", "^[a-zA-Z]+", 0).alias("title"), F.concat(F.lit("https://example.com/"), F.col("id").cast("string")).alias("url"))
    rows = joins.with_source(o.join(a, "id"), models.sources(spark, sf_dir))
    base = f"{stash_dir(spark)}/briefs-{uuid.uuid4().hex}"
    store.export_briefs(rows, base)
    article = "array<struct<position:bigint,id:bigint,title:string,url:string,name:string>>"
    made = spark.read.schema(f"brief long, articles {article}, date date").json(f"{base}/json")
    text = spark.read.schema("value string, date date, brief long").text(f"{base}/markdown", wholetext=True)
    text = text.select("brief", "date", F.rtrim("value", F.lit("\n")).alias("markdown"))
    return made.select("brief", "date", F.size("articles").cast("long").alias("n"), F.col("articles.id").alias("ids")).join(text, ["brief", "date"])


@query(
    "a13_run_mirror",
    with_models("""
SELECT run_id, task, agent, CAST(cost AS DOUBLE) AS cost, status, coalesce(task, 'brief') AS task_type, 'gazetta' AS project, coalesce(CAST(cost AS DOUBLE), 0) AS actual_cost, CASE WHEN run_id % 3 = 0 THEN 'run-' || run_id // 100 ELSE 'solo-' || coalesce(agent, '?') END AS trace_id, run_id % 5 = 1 AS artifact_verified FROM runs"""),
)
def run_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as a stream to two sinks: the log, and the mirror with its defaults and two fields of its own."""
    base = f"{stash_dir(spark)}/stream-{uuid.uuid4().hex}"
    runs = models.runs(spark, sf_dir)
    runs = runs.select("run_id", "task", "agent", "cost", "status", F.when(F.col("run_id") % 3 == 0, F.concat(F.lit("run-"), F.floor(F.col("run_id") / 100).cast("string"))).alias("trace_id"), F.when(F.col("run_id") % 5 < 2, F.col("run_id") % 5 == 1).alias("artifact_verified"))
    runs.write.parquet(f"{base}/landed")
    stream = jobs.files(spark, f"{base}/landed", runs)
    store.two_sinks(stream, f"{base}/checkpoint", run_log.log_and_mirror, store.batch_sink(f"{base}/log"), store.batch_sink(f"{base}/mirror"), f"{base}/kept").awaitTermination()
    log, mirror = run_log.log_and_mirror(runs)
    log, mirror = spark.read.schema(log.schema).parquet(f"{base}/log"), spark.read.schema(mirror.schema).parquet(f"{base}/mirror")
    both = log.select("run_id", "task", F.col("cost").cast("double").alias("cost"), "status").join(mirror.drop("status"), "run_id")
    return both.select("run_id", "task", "agent", "cost", "status", "task_type", "project", "actual_cost", "trace_id", "artifact_verified")


@query("a14_window_scan", with_models("SELECT id, source_id FROM art WHERE published_at >= TIMESTAMP '2024-01-03 21:00:00' - INTERVAL '24' HOUR"))
def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store by date has from 24 hours ago on: only the folders from that date on are read."""
    base = f"{stash_dir(spark)}/articles-{uuid.uuid4().hex}"
    store.write_dates(models.articles(spark, sf_dir).select("id", "source_id", "published_at"), base, "published_at")
    return store.read_window(spark, base, "published_at", as_of() - F.expr("interval 24 hours")).select("id", "source_id")


@query(
    "a15_drop_candidates",
    with_models("SELECT id, quality FROM art JOIN scored ON article_id = id JOIN src USING (source_id) WHERE category = 'EUROPE' AND published_at >= TIMESTAMP '2024-01-03 21:00:00' - INTERVAL '168' HOUR AND NOT EXISTS (SELECT 1 FROM dlv WHERE dlv.article_id = id AND account = 'acct2')"),
)
def drop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow = models.sources(spark, sf_dir).where("category = 'EUROPE'").select("source_id")
    rows = models.articles(spark, sf_dir).where(filters.in_window(F.col("published_at"), as_of(), F.lit(168))).join(sized(slow), "source_id", "left_semi")
    rows = joins.undelivered(rows, models.deliveries(spark, sf_dir), "acct2")
    return rows.join(models.scores(spark, sf_dir), F.col("id") == F.col("article_id")).select("id", "quality")
