"""C05, H and I rows: similarity, components, greedy selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta import models
from gazetta.models import as_of, with_models
from gazetta.operators import aggregates, filters, graphs, greedy, joins, windows
from gazetta.plans import briefs as briefs_plan
from gazetta.queries.registry import query
from gazetta.session import stash, table

PAIRS = """
WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS similarity FROM u a JOIN u b ON a.vec_id < b.vec_id AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.4)"""


@query("c05_similar_pairs", PAIRS + " SELECT a, b, round(similarity, 6) AS similarity FROM e")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.similar_pairs(table(spark, sf_dir, "embeddings"), 0.4).withColumn("similarity", F.round("similarity", 6))


@query("h02_lsh_pairs", PAIRS + " SELECT a, b, round(similarity, 6) AS similarity FROM e")
def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of the exact join here: at this threshold the hash saves nothing below some million rows, and the operator says so."""
    return graphs.lsh_pairs(table(spark, sf_dir, "embeddings"), 0.4).withColumn("similarity", F.round("similarity", 6))


@query(
    "h02_cap_index",
    PAIRS.replace("a.vec_id < b.vec_id AND", "a.vec_id <> b.vec_id AND a.vec_id % 10 = 0 AND") + " SELECT (SELECT count(*) FROM embeddings) AS n, (SELECT count(*) FROM e) AS expected, true AS recalled, true AS pays",
)
def cap_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of caps over all vectors, held against brute force for every tenth: recall of 0.9 and more, from fewer comparisons than a tenth of all squared."""
    vectors = table(spark, sf_dir, "embeddings")
    pairs, compared = graphs.cap_pairs(vectors, 0.4)
    # Both ways round in one pass: two passes over the pairs would compare the caps twice.
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = pairs.where("a % 10 = 0 or b % 10 = 0").select(F.inline(ways)).where("a % 10 = 0")
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    exact = graphs.matches(rows.where("id % 10 = 0"), rows, 0.4)
    got = exact.join(both.withColumn("found", F.lit(True)), ["a", "b"], "left").agg(F.count("*").alias("expected"), F.count("found").alias("found"))
    n = vectors.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(got)).select("n", "expected", (F.col("found") >= 0.9 * F.col("expected")).alias("recalled"), (F.lit(compared).cast("long") * 10 < F.col("n") * F.col("n")).alias("pays"))


COMPONENTS = PAIRS + """,
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, far) AS (SELECT a, a FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.far = s.a),
c AS (SELECT id, min(far) AS cluster FROM r GROUP BY id)"""


@query("h03_components", COMPONENTS + " SELECT id, cluster FROM c")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.similar_components(table(spark, sf_dir, "embeddings"), 0.4)


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per member of a cluster among the articles of 48 hours: cluster, id, action, kind."""
    recent = models.articles(spark, sf_dir).where(filters.in_window(F.col("published_at"), as_of(), F.lit(48)) & (F.col("published_at") <= as_of()))
    recent = stash(recent.select("id", "published_at", "title", "body"))
    vectors = table(spark, sf_dir, "embeddings").join(recent.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    pairs = stash(graphs.lsh_pairs(vectors, 0.4))
    parts = graphs.connected_components(pairs)
    members = recent.join(parts, "id")
    edges = pairs.join(parts, F.col("a") == F.col("id")).select("cluster", "similarity")
    summary = aggregates.cluster_summary(members, edges)
    rows = members.select("id", "cluster").join(summary, "cluster")
    action = F.when(F.col("review"), "review").when(F.col("id") == F.col("primary_id"), "keep").otherwise("drop")
    return rows.select("primary_id", "id", "kind", action.alias("action"), "members")


RESOLVED = (
    """
WITH RECURSIVE ev AS (SELECT doc_id AS id, source, ts, lower(split_part(text, chr(10), 1) || ' ' || substr(text, 1, 300)) AS t FROM documents JOIN events ON event_id = doc_id
  WHERE ts >= TIMESTAMP '2024-01-03 21:00:00' - INTERVAL '48' HOUR AND ts <= TIMESTAMP '2024-01-03 21:00:00'),
u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IN (SELECT id FROM ev)),
e AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS similarity FROM u a JOIN u b ON a.vec_id < b.vec_id AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.4),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, far) AS (SELECT a, a FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.far = s.a),
c AS (SELECT id, min(far) AS cluster FROM r GROUP BY id), m AS (SELECT cluster, ev.* FROM c JOIN ev USING (id)),
low AS (SELECT cluster, min(similarity) AS low FROM e JOIN c ON a = id GROUP BY cluster),
z AS (SELECT cluster, count(*) AS members, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS span, bool_or(len(list_filter([PRICE_WORDS], lambda w: contains(t, w))) > 0) AS price,
  arg_max(id, (ts, id)) AS latest, arg_min(id, (ts, id)) AS earliest FROM m GROUP BY cluster HAVING count(*) >= 2),
k AS (SELECT z.*, CASE WHEN round(span, 6) <= 12 AND price THEN 'price_event' ELSE 'analysis' END AS kind, low < 0.9 AS weak FROM z JOIN low USING (cluster)),
f AS (SELECT *, CASE WHEN kind = 'price_event' THEN latest ELSE earliest END AS primary_id FROM k),
plan AS (SELECT primary_id, id, kind, CASE WHEN kind = 'analysis' AND weak THEN 'review' WHEN id = primary_id THEN 'keep' ELSE 'drop' END AS action, members FROM m JOIN f USING (cluster))"""
).replace("PRICE_WORDS", ", ".join(f"'{w}'" for w in aggregates.PRICE_WORDS))


@query("h04_resolve_duplicates", RESOLVED + " SELECT * FROM plan")
def resolve_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query(
    "a08_soft_delete",
    RESOLVED
    + """, d AS (SELECT doc_id AS id, source AS source_id FROM documents JOIN events ON event_id = doc_id)
SELECT id, source_id, primary_id AS cluster_id, coalesce(action = 'drop', false) AS deleted, CASE WHEN action = 'drop' THEN primary_id END AS duplicate_of FROM d LEFT JOIN plan USING (id)""",
)
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _resolved(spark, sf_dir).select("id", F.col("primary_id").alias("cluster_id"), (F.col("action") == "drop").alias("lost"))
    rows = models.articles(spark, sf_dir).select("id", "source_id").join(plan, "id", "left")
    lost = F.coalesce("lost", F.lit(False))
    return rows.select("id", "source_id", "cluster_id", lost.alias("deleted"), F.when(lost, F.col("cluster_id")).alias("duplicate_of"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their place in their category: a total order."""
    a = joins.with_source(models.articles(spark, sf_dir), models.sources(spark, sf_dir)).where("category is not null")
    score = filters.composite(F.col("relevance"), F.col("actionability"))
    a = a.select("id", "category", "topics", "relevance", "actionability", "source_id", "published_at", score.alias("score"))
    return windows.placed(a, "category", F.desc("score"), F.desc("published_at"), F.col("id")).withColumnRenamed("place", "rank")


THEMES = """
, a AS (SELECT id, category, topics, row_number() OVER (PARTITION BY category ORDER BY relevance * 10 + actionability * 15 DESC, published_at DESC, id) AS n FROM art JOIN src USING (source_id)),
walk(category, n, id, seed, open) AS (
  SELECT category, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS STRUCT(s BIGINT, t VARCHAR[], k INTEGER)[]) FROM (SELECT DISTINCT category FROM a)
  UNION ALL
  SELECT category, n, id, coalesce(hit, id),
    CASE WHEN hit IS NULL THEN list_append(open, {'s': id, 't': topics, 'k': CASE WHEN len(topics) = 0 THEN 0 ELSE 5 END})
      ELSE list_transform(open, lambda x: CASE WHEN x.s = hit THEN {'s': x.s, 't': x.t, 'k': x.k - 1} ELSE x END) END
  FROM (
    SELECT a.category, a.n, a.id, a.topics, open, list_filter(open, lambda x: x.k > 0 AND (len(list_intersect(x.t, a.topics)) >= 2 OR (len(list_intersect(x.t, a.topics)) = 1 AND least(len(x.t), len(a.topics)) <= 2)))[1].s AS hit
    FROM walk JOIN a ON a.category = walk.category AND a.n = walk.n + 1
  )
)
SELECT id, seed FROM walk WHERE n > 0"""


@query("i01_topic_themes", with_models(THEMES))
def topic_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy themes in every category on its own. The SQL walks the articles one by one."""
    return greedy.topic_themes(_ranked(spark, sf_dir), 6, scope="category").select("id", "seed")


@query("i02_thin_highlights")
def thin_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that share three topics and all of them: a clique, of which the best meets each other one."""
    rows = stash(_ranked(spark, sf_dir).where("relevance >= 5").select("id", "category", "topics", "rank"))
    return greedy.thin_highlights(rows.select("id", "rank"), joins.same_topics(rows, "rank", 3, scope="category"))


@query("i03_brief_selection")
def brief_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The briefs of three accounts on three evenings, in one run: what each cites, in order."""
    return _briefs(spark, sf_dir)[0]


@query("d22_brief_status")
def brief_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of these briefs are normal, quiet or skipped, and why."""
    return _briefs(spark, sf_dir)[1]


def _briefs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = joins.with_source(models.articles(spark, sf_dir), models.sources(spark, sf_dir)).where("category is not null")
    # A document's label class stands for the story that the deduplicator found.
    story = F.when(F.col("id") % 5 == 0, F.col("id") % 40)
    rows = rows.select("id", "category", "source_id", story.alias("story"), "topics", "relevance", "actionability", "published_at")
    deliveries = models.deliveries(spark, sf_dir)
    day = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("back")
    made = deliveries.select("account").distinct().select("account", day)
    briefs = made.select(F.concat_ws("/", "account", F.col("back").cast("string")).alias("brief"), "account", (as_of() - F.make_dt_interval(F.col("back"))).alias("as_of"))
    classes = spark.createDataFrame([("ASIA", 72), ("EUROPE", 72)], "category string, window_hours int")
    return briefs_plan.brief_selection(rows, stash(briefs), deliveries, models.scores(spark, sf_dir), classes, ["EUROPE"])
