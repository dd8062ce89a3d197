"""D rows: summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta import models
from gazetta.functions.quantity import cosine
from gazetta.models import as_of, with_models
from gazetta.operators import aggregates, filters, joins
from gazetta.queries.registry import query
from gazetta.session import table


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_source(models.articles(spark, sf_dir), models.sources(spark, sf_dir))


#: The words as a DuckDB list.
PRICE_LIST = ", ".join(f"'{w}'" for w in aggregates.PRICE_WORDS)


@query(
    "d01_cluster_summary",
    with_models("""
, m AS (SELECT CAST(floor(id / 7) AS BIGINT) AS cluster, id, published_at, lower(title || ' ' || substr(body, 1, 300)) AS t FROM art),
p AS (SELECT *, len(list_filter([PRICE_WORDS], lambda w: contains(t, w))) > 0 AS price FROM m),
v AS (SELECT vec_id, CAST(floor(vec_id / 7) AS BIGINT) AS cluster, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings),
e AS (SELECT x.cluster, min(round(list_cosine_similarity(x.w, y.w), 9)) AS low FROM v x JOIN v y ON x.cluster = y.cluster AND x.vec_id < y.vec_id WHERE round(list_cosine_similarity(x.w, y.w), 9) >= 0.1 GROUP BY 1),
s AS (SELECT cluster, count(*) AS members, CASE WHEN count(published_at) >= 2 THEN round((epoch_us(max(published_at)) - epoch_us(min(published_at))) / 3.6e9, 6) ELSE 0 END AS span_hours,
  bool_or(price) AS price, arg_max(id, (published_at, id)) AS latest, arg_min(id, (published_at, id)) AS earliest FROM p GROUP BY cluster HAVING count(*) >= 2),
k AS (SELECT s.*, round(coalesce(low, 1.0), 6) AS min_similarity, CASE WHEN span_hours <= 0.45 AND price THEN 'price_event' ELSE 'analysis' END AS kind FROM s LEFT JOIN e USING (cluster))
SELECT cluster, members, span_hours, min_similarity, kind, CASE WHEN kind = 'price_event' THEN latest ELSE earliest END AS primary_id, kind = 'analysis' AND min_similarity < 0.9 AS review FROM k""".replace("PRICE_WORDS", PRICE_LIST)),
)
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven articles in a row are a cluster; its edges are the similar pairs of vectors within it."""
    members = models.articles(spark, sf_dir).withColumn("cluster", F.floor(F.col("id") / 7).cast("long"))
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 7).cast("long").alias("cluster"), F.col("vec_id").alias("x"), F.transform("embedding", lambda e: e.cast("double")).alias("w"))
    both = v.join(v.select("cluster", F.col("x").alias("y"), F.col("w").alias("u")), "cluster").where("x < y")
    edges = both.select("cluster", F.round(cosine(F.col("w"), F.col("u")), 9).alias("similarity")).where("similarity >= 0.1")
    out = aggregates.cluster_summary(members, edges, price_hours=0.45)
    return out.withColumn("min_similarity", F.round("min_similarity", 6))


@query(
    "d05_cost_rollup",
    with_models("SELECT task, agent, CAST(level AS INTEGER) AS level, round(CAST(cost AS DOUBLE), 6) AS cost, n AS runs FROM (SELECT task, agent, grouping(task, agent) AS level, sum(cost) AS cost, count(*) AS n FROM (SELECT coalesce(task, 'other') AS task, coalesce(agent, 'unknown') AS agent, coalesce(cost, 0) AS cost FROM runs) GROUP BY ROLLUP (task, agent))"),
)
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.cost_rollup(models.runs(spark, sf_dir))


@query(
    "d05_day_cost",
    with_models("SELECT CAST(created_at AS DATE) AS day, round(CAST(sum(coalesce(cost, 0)) AS DOUBLE), 6) AS cost, round(round(CAST(sum(coalesce(cost, 0)) AS DOUBLE), 6) / 7000 * 100, 2) AS percent, sum(coalesce(cost, 0)) > 7000 AS over FROM runs GROUP BY 1"),
)
def day_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.day_cost(models.runs(spark, sf_dir), 7000.0)


@query("d06_distribution", with_models("SELECT coalesce(category, 'unlabelled') AS category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM art LEFT JOIN src USING (source_id) GROUP BY 1"))
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.distribution(_known(spark, sf_dir), "category")


LEAN = "CASE WHEN contains(lower(bias), 'left') THEN 'left' WHEN contains(lower(bias), 'right') THEN 'right' WHEN contains(lower(bias), 'cent') OR contains(lower(bias), 'middle') THEN 'center' END"


@query(
    "d07_bias_spread",
    with_models(f", n AS (SELECT coalesce({LEAN}, 'unknown') AS lean, count(*) AS n FROM art LEFT JOIN src USING (source_id) WHERE category = 'EUROPE' GROUP BY 1) SELECT s.lean, coalesce(n, 0) AS n FROM (VALUES ('left'), ('center'), ('right'), ('unknown')) s(lean) LEFT JOIN n USING (lean)"),
)
def bias_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.bias_spread(_known(spark, sf_dir).where("category = 'EUROPE'"))


@query(
    "d08_source_balance",
    with_models(f"""
, m AS (SELECT CAST(floor(id / 4) AS BIGINT) AS theme, source_id, id, {LEAN} AS lean FROM art LEFT JOIN src USING (source_id)),
v AS (SELECT theme, source_id, arg_min_null(lean, id) AS lean FROM m GROUP BY ALL),
c AS (SELECT theme, count(*) AS sources, count(*) FILTER (lean = 'left') AS n_left, count(*) FILTER (lean = 'center') AS n_center, count(*) FILTER (lean = 'right') AS n_right FROM v GROUP BY theme),
p AS (SELECT *, n_left + n_center + n_right AS placed, n_left + n_center + n_right >= 3 AND NOT (n_left > 0 AND n_right > 0) AS ok FROM c)
SELECT theme, sources, n_left, n_center, n_right,
  CASE WHEN ok AND n_left >= placed * 0.75 THEN 'left ' || n_left || '/' || placed WHEN ok AND n_right >= placed * 0.75 THEN 'right ' || n_right || '/' || placed END AS skew,
  CASE WHEN n_left > 0 AND n_right = 0 AND n_center = 0 THEN 'left' WHEN n_right > 0 AND n_left = 0 AND n_center = 0 THEN 'right' END AS coverage FROM p"""),
)
def source_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.source_balance(_known(spark, sf_dir).withColumn("theme", F.floor(F.col("id") / 4).cast("long")), ["theme"])


@query(
    "d11_majority",
    with_models(", n AS (SELECT CAST(floor(id / 12) AS BIGINT) AS story, category, count(*) AS n, min(id) AS met FROM art JOIN src USING (source_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY n DESC, met) AS k FROM n) SELECT story, category FROM r WHERE k = 1"),
)
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.majority(_known(spark, sf_dir).withColumn("story", F.floor(F.col("id") / 12).cast("long")), "story", "category", "id")


@query(
    "d12_window_audit",
    with_models(", a AS (SELECT source_id, (epoch_us(TIMESTAMP '2024-01-03 21:00:00') - epoch_us(published_at)) / 3.6e9 AS age FROM art) SELECT source_id, count(*) AS n, round(max(age), 3) AS oldest, round(min(age), 3) AS newest, count(*) FILTER (age <= 6) AS fresh FROM a GROUP BY 1"),
)
def window_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.window_audit(models.articles(spark, sf_dir), as_of(), 6, ["source_id"])


@query(
    "d13_run_health",
    """
WITH r AS (SELECT event_id AS id, ts, ['fetcher', 'classifier', 'deduplicator', 'analyst', 'writer', 'chat'][user_id % 6 + 1] AS agent, event_type = 'error' AS e FROM events),
runs AS (SELECT id, ts, agent, CASE WHEN NOT e OR id % 4 > 1 AND agent <> 'writer' THEN 'success' WHEN id % 4 = 0 THEN 'Partial' WHEN id % 4 = 1 THEN 'failed' WHEN id % 4 = 2 THEN 'quiet_day_no_articles' ELSE 'no_clusters' END AS status,
  CASE WHEN id % 3 > 0 THEN 'e' || id END AS error FROM r WHERE agent <> 'chat'),
slots AS (SELECT CAST(d AS DATE) AS slot, d + INTERVAL '6' HOUR AS begins, d + INTERVAL '12' HOUR AS ends FROM (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events), (SELECT date_trunc('day', max(ts)) FROM events) + INTERVAL '2' DAY, INTERVAL '1' DAY)) AS d)),
own AS (SELECT slot, runs.* FROM slots JOIN runs ON ts >= begins AND ts < ends),
f AS (SELECT slot, arg_max(status, (ts, id)) FILTER (agent = 'writer' AND status IN ('quiet_day_no_articles', 'no_clusters')) AS skip FROM own GROUP BY slot),
b AS (SELECT slot, arg_max(event_id, (ts, event_id)) AS brief FROM slots JOIN events ON ts >= begins AND ts < ends WHERE user_id = 7 AND event_type IN ('purchase', 'click') GROUP BY slot)
SELECT slot, 'alert' AS severity, agent AS stage, lower(status) || ': ' || coalesce(error, 'no detail') AS detail FROM own WHERE status IN ('Partial', 'failed')
UNION ALL SELECT slot, 'alert', 'pipeline', 'no engine runs recorded since the slot start' FROM slots WHERE slot NOT IN (SELECT slot FROM f)
UNION ALL SELECT slot, CASE WHEN skip IS NULL THEN 'alert' ELSE 'info' END, 'writer', CASE WHEN skip IS NULL THEN 'no fresh brief produced' ELSE 'no brief (writer status=' || skip || ')' END FROM f WHERE slot NOT IN (SELECT slot FROM b)
UNION ALL SELECT slot, 'alert', 'delivery', 'brief built but not recorded as delivered' FROM f JOIN b USING (slot) WHERE brief % 2 = 1""",
)
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morning slots of every day and two days more; events as runs, a user's as briefs."""
    e = table(spark, sf_dir, "events").withColumn("created_at", F.col("ts").cast("timestamp"))
    i = F.col("event_id")
    agent = F.element_at(F.array(*[F.lit(x) for x in (*aggregates.ENGINES, "chat")]), (F.col("user_id") % 6 + 1).cast("int"))
    runs = e.select(i.alias("run_id"), agent.alias("agent"), "created_at", F.col("event_type"), F.when(i % 3 > 0, F.concat(F.lit("e"), i.cast("string"))).alias("error"))
    said = F.when((F.col("event_type") != "error") | ((F.col("run_id") % 4 > 1) & (F.col("agent") != "writer")), "success").when(F.col("run_id") % 4 == 0, "Partial").when(F.col("run_id") % 4 == 1, "failed")
    runs = runs.withColumn("status", said.when(F.col("run_id") % 4 == 2, "quiet_day_no_articles").otherwise("no_clusters"))
    briefs = e.where("user_id = 7 and event_type in ('purchase', 'click')").select(i.alias("brief"), "created_at")
    ends = e.agg(F.to_date(F.min("created_at")).alias("a"), F.date_add(F.to_date(F.max("created_at")), 2).alias("b")).where("a is not null")
    slots = ends.select(F.explode(F.sequence("a", "b")).alias("slot")).select("slot", *[(F.col("slot").cast("timestamp") + F.expr(f"interval {h} hours")).alias(n) for n, h in (("start", 6), ("end", 12))])
    return aggregates.run_health(slots, runs, briefs, briefs.where("brief % 2 = 0"))


@query(
    "d14_token_cost",
    "WITH p(model, price_in, price_out) AS (VALUES ('click', 0.10, 0.40), ('purchase', 1.0, 5.0)) SELECT event_type AS model, round(sum(coalesce(value * 100 / 1e6 * CAST(price_in AS DOUBLE) + value * 10 / 1e6 * CAST(price_out AS DOUBLE), 0)), 6) AS cost, count(*) AS calls FROM events LEFT JOIN p ON model = event_type GROUP BY 1",
)
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("value") * 100).alias("tokens_in"), (F.col("value") * 10).alias("tokens_out"))
    prices = spark.createDataFrame([("click", 0.10, 0.40), ("purchase", 1.0, 5.0)], "model string, price_in double, price_out double")
    return aggregates.token_cost(usage, prices)


@query(
    "d15_centroid",
    "WITH p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(CAST(x AS DOUBLE)) AS m FROM p GROUP BY ALL) SELECT label, list(round(m, 6) ORDER BY d) AS centroid FROM m GROUP BY label",
)
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.centroid(table(spark, sf_dir, "embeddings"), "label", digits=6)


@query("d17_sources_by_category", with_models("SELECT category, count(*) FILTER (source_no % 2 = 0) AS active, count(*) AS total FROM src GROUP BY 1"))
def sources_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.sources(spark, sf_dir).groupBy("category").agg(F.count_if(F.col("source_no") % 2 == 0).alias("active"), F.count("*").alias("total"))


@query(
    "d18_funnel",
    with_models("""
, f AS (SELECT id, category, title, cluster_id, published_at >= TIMESTAMP '2024-01-03 21:00:00' - INTERVAL '24' HOUR AS recent, article_id IS NOT NULL AS scored, relevance >= 6 OR actionability >= 2 AS good,
    EXISTS (SELECT 1 FROM dlv WHERE dlv.article_id = id AND account = 'acct1') AS sent FROM (SELECT *, CASE WHEN id % 5 > 0 THEN id % 400 END AS cluster_id FROM art) a LEFT JOIN src USING (source_id) LEFT JOIN scored ON article_id = id),
g AS (SELECT *, min(id) OVER (PARTITION BY cluster_id) = id OR cluster_id IS NULL AS kept FROM f WHERE recent),
n AS (SELECT category, 'fetched' AS stage FROM f UNION ALL SELECT category, 'recent' FROM f WHERE recent UNION ALL SELECT category, 'unique' FROM g WHERE kept UNION ALL SELECT category, 'scored' FROM g WHERE kept AND scored
  UNION ALL SELECT category, 'qualifying' FROM g WHERE kept AND scored AND good UNION ALL SELECT category, 'undelivered' FROM g WHERE kept AND scored AND good AND NOT sent UNION ALL SELECT category, 'delivered' FROM g WHERE kept AND scored AND good AND sent)
SELECT c.category, s.stage, (SELECT count(*) FROM n WHERE n.category IS NOT DISTINCT FROM c.category AND n.stage = s.stage) AS n
FROM (SELECT DISTINCT category FROM f) c, (SELECT unnest(['fetched', 'recent', 'unique', 'scored', 'qualifying', 'undelivered', 'delivered']) AS stage) s"""),
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven stages of each category's articles, from fetched to delivered."""
    from pyspark.sql import Window

    rows = _known(spark, sf_dir).withColumn("cluster_id", F.when(F.col("id") % 5 > 0, F.col("id") % 400)).withColumn("category", F.coalesce("category", F.lit("none")))
    recent = rows.where(filters.in_window(F.col("published_at"), as_of(), F.lit(24)))
    first = F.row_number().over(Window.partitionBy(F.coalesce("cluster_id", -F.col("id") - 1)).orderBy("id"))
    unique = recent.withColumn("_n", first).where("_n = 1")
    scored = unique.join(models.scores(spark, sf_dir).select(F.col("article_id").alias("id")).distinct(), "id", "left_semi")
    good = scored.where(filters.entry_gate(F.col("relevance"), F.col("actionability"), 6))
    had = models.deliveries(spark, sf_dir).where("account = 'acct1'").select(F.col("article_id").alias("id")).distinct()
    stages = [("fetched", rows), ("recent", recent), ("unique", unique), ("scored", scored), ("qualifying", good), ("undelivered", good.join(had, "id", "left_anti")), ("delivered", good.join(had, "id", "left_semi"))]
    out = aggregates.funnel(stages, "category")
    return out.withColumn("category", F.nullif("category", F.lit("none")))


@query("d19_step_status", with_models("SELECT task, agent, count(*) AS runs, count(*) FILTER (status <> 'success') AS errors, CASE WHEN count(*) FILTER (status <> 'success') > 0 THEN 'partial' ELSE 'success' END AS status FROM runs GROUP BY task, agent"))
def step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.step_status(models.runs(spark, sf_dir), ["task", "agent"])


@query(
    "d19_fetch_status",
    """WITH f AS (SELECT user_id % 20 AS step, event_id AS met, 'src' || (event_id % 100) AS source, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'insert' ELSE 'fetch' END END AS kind FROM events),
n AS (SELECT step, source, met, row_number() OVER (PARTITION BY step ORDER BY met, source) AS k FROM f WHERE kind = 'fetch'), g AS (SELECT step, string_agg(source, ', ' ORDER BY k) AS names FROM n WHERE k <= 10 GROUP BY step),
c AS (SELECT step, count(*) AS runs, count(*) FILTER (kind = 'fetch') AS a, count(*) FILTER (kind = 'insert') AS b FROM f GROUP BY step)
SELECT step, runs, CASE WHEN a + b > 0 THEN 'partial' ELSE 'success' END AS status, CASE WHEN a + b > 0 THEN a || ' source(s) failed to fetch, ' || b || ' insert error(s)' END AS error, names FROM c LEFT JOIN g USING (step)""",
)
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "insert").otherwise("fetch"))
    rows = e.select((F.col("user_id") % 20).alias("step"), F.col("event_id").alias("at"), F.concat(F.lit("src"), (F.col("event_id") % 100).cast("string")).alias("source"), kind.alias("kind"))
    return aggregates.fetch_status(rows, ["step"])


@query(
    "d20_ordered_ids",
    "WITH f AS (SELECT user_id, event_type, min(event_id) AS met FROM events GROUP BY ALL) SELECT user_id, list(event_type ORDER BY met) AS ids FROM f GROUP BY user_id",
)
def ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.ordered_ids(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query(
    "d21_story_groups",
    with_models("""
, m AS (SELECT id, category AS brief, CASE WHEN id % 5 > 0 THEN id % 40 END AS cluster_id, title, relevance AS theme FROM art JOIN src USING (source_id))
SELECT brief, coalesce(cluster_id, id + 1000000) AS story, CAST(count(*) AS BIGINT) AS members, arg_min(substr(title, 1, 80), id) AS label, list(id ORDER BY id) AS ids, min(theme) AS first_theme, max(cluster_id) IS NULL AS single FROM m GROUP BY 1, 2"""),
)
def story_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _known(spark, sf_dir).where("category is not null").withColumn("cluster_id", F.when(F.col("id") % 5 > 0, F.col("id") % 40))
    return rows.groupBy(F.col("category").alias("brief"), F.coalesce("cluster_id", F.col("id") + 1000000).alias("story")).agg(
        F.count("*").alias("members"),
        F.min_by(F.substring("title", 1, 80), "id").alias("label"),
        F.array_sort(F.collect_list("id")).alias("ids"),
        F.min("relevance").alias("first_theme"),
        F.max("cluster_id").isNull().alias("single"),
    )


@query(
    "d22_thin_day",
    with_models(", q AS (SELECT CAST(published_at AS DATE) AS day, source_id, count(*) FILTER (relevance >= 9) AS qualifying FROM art GROUP BY ALL) SELECT day, source_id, qualifying, CASE WHEN qualifying >= 3 THEN 'normal' WHEN qualifying >= 1 THEN 'quiet' ELSE 'skip: quiet_day_no_articles' END AS status, CASE WHEN qualifying >= 3 THEN 3 WHEN qualifying >= 1 THEN 1 ELSE 0 END AS min_themes FROM q"),
)
def thin_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.articles(spark, sf_dir).groupBy(F.to_date("published_at").alias("day"), "source_id").agg(F.count_if(F.col("relevance") >= 9).alias("qualifying"))
    return aggregates.thin_day(rows)
