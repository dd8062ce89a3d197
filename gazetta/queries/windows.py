"""E rows: rankings, quotas and capped selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta import models
from gazetta.functions.balance import normalise_bias
from gazetta.models import as_of, with_models
from gazetta.operators import aggregates, filters, joins, windows
from gazetta.queries.registry import query
from gazetta.session import sized, table


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_source(models.articles(spark, sf_dir), models.sources(spark, sf_dir))


@query(
    "e01_newest_per_source",
    with_models("""
, r AS (SELECT art.*, CASE WHEN category = 'ASIA' THEN 30 ELSE greatest(1, CAST(floor(30 * (1.0 + source_no % 3) / 3) AS INTEGER)) END AS cap,
  row_number() OVER (PARTITION BY art.source_id ORDER BY published_at DESC, id) AS n FROM art JOIN src USING (source_id))
SELECT id, source_id FROM r WHERE n <= cap"""),
)
def newest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = models.sources(spark, sf_dir).select("source_id", windows.source_cap((1.0 + F.col("source_no") % 3) / 3, F.col("category") == "ASIA", 30).alias("cap"))
    rows = models.articles(spark, sf_dir).select("id", "source_id", "published_at").join(sized(s), "source_id")
    return windows.newest_per_source(rows, F.col("cap")).select("id", "source_id")


@query(
    "e02_first_by_host",
    r"""
WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END, page_id) AS n FROM h)
SELECT page_id, host FROM r WHERE n = 1""",
)
def first_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    return windows.first_by_url(rows, "host", [F.when(F.startswith("url", F.lit("https")), 0).otherwise(1), F.col("page_id")]).select("page_id", "host")


@query("e03_safety_sample", with_models("SELECT id, source_id FROM art ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 300"))
def safety_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.safety_sample(models.articles(spark, sf_dir).select("id", "source_id"), 300)


@query("e04_scoring_queue", with_models("SELECT id, source_id FROM art WHERE id NOT IN (SELECT article_id FROM scored) ORDER BY published_at DESC, id LIMIT 100"))
def scoring_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.articles(spark, sf_dir).select("id", "source_id", "published_at")
    done = models.scores(spark, sf_dir).select(F.col("article_id").alias("id"))
    return joins.unseen(rows, done, "id").orderBy(F.desc("published_at"), "id").limit(100).select("id", "source_id")


@query(
    "e05_representatives",
    with_models("""
, m AS (SELECT art.*, category, CASE WHEN contains(lower(bias), 'left') THEN 'left' WHEN contains(lower(bias), 'right') THEN 'right' WHEN contains(lower(bias), 'cent') THEN 'center' END AS lean,
  CAST(floor(id / 12) AS BIGINT) AS cluster FROM art LEFT JOIN src USING (source_id)),
a AS (SELECT *, count(*) OVER p AS size, bool_or(coalesce(category = 'EUROPE', false)) OVER p AS biased,
  row_number() OVER (PARTITION BY cluster ORDER BY published_at, id) AS early,
  row_number() OVER (PARTITION BY cluster ORDER BY published_at DESC, n_chars DESC, id DESC) AS late FROM m WINDOW p AS (PARTITION BY cluster)),
b AS (SELECT *, early = 1 OR late = 1 AS ends, row_number() OVER (PARTITION BY cluster, lean ORDER BY published_at DESC, n_chars DESC, id DESC) AS side FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY cluster, ends ORDER BY n_chars DESC, published_at, id) AS f, sum(CAST(ends AS INTEGER)) OVER (PARTITION BY cluster) AS e FROM b)
SELECT cluster, id, ends OR f <= least(5, size) - e OR (biased AND lean IS NOT NULL AND side = 1) AS keep FROM c"""),
)
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _known(spark, sf_dir).select(F.floor(F.col("id") / 12).cast("long").alias("cluster"), "id", "published_at", "n_chars", "category", normalise_bias(F.col("bias")).alias("lean"))
    return windows.representatives(rows, 5, ["EUROPE"]).select("cluster", "id", "keep")


@query(
    "e06_diverse_top",
    with_models("""
, r AS (SELECT id, source_id, category, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, id) AS rank FROM art JOIN src USING (source_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY category, source_id ORDER BY rank) > 1 AS over1 FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY over1, rank) AS position FROM o)
SELECT category, id, source_id, CAST(position AS INTEGER) AS position FROM p WHERE position <= 3"""),
)
def diverse_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _known(spark, sf_dir).where("category is not null").select("id", "source_id", "category", "published_at")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("published_at"), "id")))
    return windows.diverse_top(rows, 3, by=["category"]).select("category", "id", "source_id", "position")


@query(
    "e07_highlights",
    with_models("""
, r AS (SELECT id, category, relevance * 10 + actionability * 15 AS score, row_number() OVER (PARTITION BY category ORDER BY relevance * 10 + actionability * 15 DESC, published_at DESC, id) AS n
  FROM art JOIN src USING (source_id) WHERE relevance >= 5)
SELECT id, category, score FROM r WHERE n <= 8"""),
)
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _known(spark, sf_dir).where("category is not null and relevance >= 5").withColumn("score", filters.composite(F.col("relevance"), F.col("actionability")))
    n = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), F.desc("published_at"), "id"))
    return rows.withColumn("n", n).where("n <= 8").select("id", "category", "score")


BACKOFF = """
, q AS (SELECT id, category, relevance, actionability, CASE WHEN actionability >= 2 THEN 0 WHEN relevance >= 1 THEN greatest(0, 9 - relevance) END AS need
  FROM art JOIN src USING (source_id) WHERE actionability < 2 AND published_at >= TIMESTAMP '2024-01-03 21:00:00' - INTERVAL '24' HOUR),
h AS (SELECT category, need, sum(count(*)) OVER (PARTITION BY category ORDER BY need) AS c FROM q WHERE need <= 4 GROUP BY category, need),
f AS (SELECT category, coalesce(min(need) FILTER (c >= 30), 4) AS relax FROM h GROUP BY category)
SELECT q.category, id, relevance, CAST(relax AS INTEGER) AS relax FROM q JOIN f USING (category) WHERE need <= relax"""


@query("e08_relevance_backoff", with_models(BACKOFF))
def relevance_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _known(spark, sf_dir).where("category is not null and actionability < 2")
    rows = rows.where(filters.in_window(F.col("published_at"), as_of(), F.lit(24)))
    return windows.relevance_backoff(rows, "category", 9, 5, 30).select("category", "id", "relevance", "relax")


CLUSTERS = """
, k AS (SELECT CAST(date_trunc('day', published_at) AS DATE) AS day, category AS bundle, CAST(id % 9 AS INTEGER) AS g, count(*) AS size, sum(relevance * 10 + actionability * 15) AS score
  FROM art LEFT JOIN src USING (source_id) WHERE relevance >= 6 OR actionability >= 2 GROUP BY ALL),
c AS (SELECT day, bundle, size, CAST(row_number() OVER (PARTITION BY day ORDER BY score DESC, bundle NULLS LAST, g) AS INTEGER) AS cluster_rank FROM k)"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _known(spark, sf_dir).where(filters.entry_gate(F.col("relevance"), F.col("actionability"), 6))
    rows = rows.groupBy(F.to_date("published_at").alias("day"), F.col("category").alias("bundle"), (F.col("id") % 9).cast("int").alias("g"))
    rows = rows.agg(F.count("*").alias("size"), F.sum(filters.composite(F.col("relevance"), F.col("actionability"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("score"), F.asc_nulls_last("bundle"), "g"))
    return rows.select("day", "bundle", "size", rank.alias("cluster_rank"))


@query(
    "e10_eligible",
    with_models(CLUSTERS + ", e AS (SELECT *, bundle IS NOT NULL AND row_number() OVER (PARTITION BY day, bundle ORDER BY cluster_rank) = 1 AS first FROM c) SELECT day, bundle, size, cluster_rank FROM e WHERE size >= 12 OR first"),
)
def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.eligible(_clusters(spark, sf_dir), "day", 12)


@query(
    "e11_quota",
    with_models(
        CLUSTERS
        + """
, r AS (SELECT *, row_number() OVER (PARTITION BY day, bundle ORDER BY cluster_rank) AS rn FROM c WHERE bundle IS NOT NULL),
t AS (SELECT day, greatest(least(ceil(count(DISTINCT bundle) * 1.5), 14), count(DISTINCT bundle)) AS target FROM r GROUP BY day),
o AS (SELECT r.*, target, row_number() OVER (PARTITION BY day ORDER BY rn > 1, cluster_rank) AS nth FROM r JOIN t USING (day) WHERE rn <= 2)
SELECT day, bundle, size, cluster_rank, CAST(row_number() OVER (PARTITION BY day ORDER BY cluster_rank) AS INTEGER) AS position FROM o WHERE rn = 1 OR nth <= target"""
    ),
)
def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.quota(_clusters(spark, sf_dir), "day", 1, 2, 1.5, 14)


@query(
    "e12_demote",
    with_models(CLUSTERS + " SELECT day, bundle, cluster_rank, CASE WHEN bundle IS NULL OR row_number() OVER (PARTITION BY day, bundle ORDER BY cluster_rank) <= 3 THEN 'theme' ELSE 'highlight' END AS role FROM c"),
)
def demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.demote(_clusters(spark, sf_dir), "day", 3).select("day", "bundle", "cluster_rank", "role")


@query(
    "e13_best_brief",
    with_models("""
, b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN CAST(published_at AS DATE) = DATE '2024-01-03' THEN 0 ELSE 1 END, length(body) DESC, published_at DESC, id) AS n
  FROM art WHERE length(body) > 0 AND published_at >= TIMESTAMP '2024-01-03 21:00:00' - INTERVAL '20' HOUR)
SELECT source_id, id, CAST(length(body) AS INTEGER) AS chars FROM b WHERE n = 1"""),
)
def best_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.articles(spark, sf_dir).select("id", "source_id", F.col("published_at").alias("created_at"), F.col("body").alias("content"))
    return windows.best_brief(rows, ["source_id"], as_of(), 20).select("source_id", "id", F.length("content").alias("chars"))


@query(
    "e15_capped_run",
    with_models("""
, s AS (SELECT id, source_id, published_at, CAST(relevance >= 3 AS INTEGER) AS checked, CAST(relevance >= 8 AS INTEGER) AS noted FROM art),
c AS (SELECT *, coalesce(sum(checked) OVER w, 0) AS a, coalesce(sum(noted) OVER w, 0) AS b FROM s WINDOW w AS (PARTITION BY source_id ORDER BY published_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source_id, id FROM c WHERE a < 40 AND b < 5"""),
)
def capped_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.articles(spark, sf_dir).select("id", "source_id", F.struct("published_at", "id").alias("at"), (F.col("relevance") >= 3).alias("checked"), (F.col("relevance") >= 8).alias("noted"))
    return windows.capped_run(rows, "source_id", "at", "checked", "noted").select("source_id", "id")


@query(
    "e17_latest_runs",
    with_models("SELECT run_id, agent, status FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 20"),
)
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.runs(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("run_id")).limit(20).select("run_id", "agent", "status")


@query(
    "d10_cluster_category",
    with_models("""
, m AS (SELECT CAST(floor(id / 12) AS BIGINT) AS cluster, category, id FROM art LEFT JOIN src USING (source_id)),
n AS (SELECT cluster, category, count(*) AS n, min(id) AS met FROM m WHERE category IS NOT NULL GROUP BY ALL),
l AS (SELECT cluster, count(*) AS leaders, arg_min(category, met) AS leader FROM n WHERE n.n = (SELECT max(x.n) FROM n x WHERE x.cluster = n.cluster) GROUP BY cluster),
f AS (SELECT cluster, category AS first FROM m WHERE id IN (SELECT min(id) FROM m GROUP BY cluster))
SELECT f.cluster, CASE WHEN leaders = 1 THEN leader ELSE coalesce(first, leader) END AS category FROM f LEFT JOIN l USING (cluster)"""),
)
def cluster_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _known(spark, sf_dir).select(F.floor(F.col("id") / 12).cast("long").alias("cluster"), "category", "id")
    return aggregates.cluster_category(rows, "cluster", "category", "id")
