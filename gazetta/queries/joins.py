"""B, C and F rows: filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta import models
from gazetta.functions import quantity, text
from gazetta.models import as_of, with_models
from gazetta.operators import filters, joins, overlaps
from gazetta.queries.registry import query
from gazetta.session import sized, table

NOW = "TIMESTAMP '2024-01-03 21:00:00'"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_source(models.articles(spark, sf_dir), models.sources(spark, sf_dir))


@query(
    "b01_freshness_window",
    with_models(f"SELECT art.id FROM art JOIN src USING (source_id) WHERE published_at >= {NOW} - to_hours(CAST(least(greatest(CASE WHEN source_no % 4 > 0 THEN source_no % 4 * 10 ELSE 24 END, 20), 30) AS INTEGER))"),
)
def freshness_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = models.sources(spark, sf_dir).select("source_id", filters.freshness_window((F.col("source_no") % 4 * 10).cast("int"), 24, True, 20, 30).alias("hours"))
    rows = models.articles(spark, sf_dir).select("id", "source_id", "published_at").join(sized(s), "source_id")
    return rows.where(filters.in_window(F.col("published_at"), as_of(), F.col("hours"))).select("id")


@query(
    "b02_scheduled_sources",
    with_models("SELECT source_id, name FROM src WHERE source_no % 3 IN (0, 1)"),
)
def scheduled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sources of one third have no calendar, one third has Thursday (the day in this zone), one third has not.
    s = models.sources(spark, sf_dir)
    days = F.when(F.col("source_no") % 3 == 0, F.lit(None)).when(F.col("source_no") % 3 == 1, "Thursday, Saturday").otherwise("Monday")
    return s.where(filters.scheduled(days, as_of(), "Asia/Tokyo")).select("source_id", "name")


@query(
    "b03_paid_content",
    with_models("SELECT id FROM art JOIN src USING (source_id) WHERE NOT (source_no % 2 = 0 AND (contains(lower(title), 'the') OR contains(lower(title), 'sponsored') OR contains(lower(title), 'partner')))"),
)
def paid_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = models.sources(spark, sf_dir).select("source_id", F.when(F.col("source_no") % 2 == 0, "Avoid PR articles").alias("notes"))
    rows = models.articles(spark, sf_dir).select("id", "title", "source_id").join(sized(s), "source_id")
    words = F.coalesce(F.contains("notes", F.lit("Avoid PR articles")), F.lit(False)) & text.contains_any(F.col("title"), ["the"])
    return rows.where(~(filters.paid_content(F.col("title"), F.col("notes")) | words)).select("id")


PATTERNS = "pats(pattern, pattern_type, active, position) AS (VALUES ('/en/1', 'url_contains', true, 1), ('.html', 'url_endswith', true, 2), ('utm_', 'url_contains', true, 3), ('on the', 'title_contains', true, 4), ('http', 'url_contains', false, 5))"


def _patterns(spark: SparkSession) -> DataFrame:
    rows = [("/en/1", "url_contains", True, 1), (".html", "url_endswith", True, 2), ("utm_", "url_contains", True, 3), ("on the", "title_contains", True, 4), ("http", "url_contains", False, 5)]
    return spark.createDataFrame(rows, "pattern string, pattern_type string, active boolean, position int")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


HIT = "((pattern_type = 'url_contains' AND contains(lower(url), pattern)) OR (pattern_type = 'url_endswith' AND ends_with(lower(url), pattern)) OR (pattern_type = 'title_contains' AND contains(lower(title), pattern)))"


@query(
    "b04_junk_filter",
    f"WITH {PATTERNS}, p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) SELECT page_id, url FROM p WHERE url LIKE 'http%' AND length(url) >= 30 AND length(title) >= 15 AND NOT EXISTS (SELECT 1 FROM pats WHERE active AND {HIT})",
)
def junk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_junk(_listed(spark, sf_dir), _patterns(spark)).select("page_id", "url")


@query(
    "k14_junk_audit",
    f"WITH {PATTERNS}, p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) SELECT page_id, arg_min(pattern, position) AS signature FROM p JOIN pats ON active AND {HIT} GROUP BY page_id",
)
def junk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.junk_signature(_listed(spark, sf_dir), _patterns(spark)).select("page_id", "signature")


@query("b05_work_queue", with_models(f"SELECT id FROM art WHERE published_at >= {NOW} - INTERVAL '30' HOUR AND length(title) > 0 AND NOT EXISTS (SELECT 1 FROM scored WHERE article_id = id)"))
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.articles(spark, sf_dir).where(filters.in_window(F.col("published_at"), as_of(), F.lit(30)) & (F.length("title") > 0)).select("id")
    return joins.unseen(rows, models.scores(spark, sf_dir).withColumnRenamed("article_id", "id"), "id")


@query("b06_topic_match", with_models("SELECT id FROM art WHERE contains(array_to_string(topics, ' '), 'ther') OR contains(array_to_string(topics, ' '), 'ción')"))
def topic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.articles(spark, sf_dir).where(filters.topic_match(F.col("topics"), ["ther", "ción"])).select("id")


@query(
    "b07_chat_admission",
    with_models("""
, r(chat, category, inc, exc) AS (VALUES ('one', 'a', ['ther', 'ing'], ['tion']), ('one', 'b', ['ein'], []), ('one', '*', [], ['eau']), ('two', 'a', ['tion'], ['the'])),
n AS (SELECT chat, exc AS never FROM r WHERE category = '*'),
x AS (SELECT id, array_to_string(topics, ' ') AS t FROM art)
SELECT DISTINCT r.chat, id FROM x JOIN r ON category <> '*' LEFT JOIN n USING (chat)
WHERE len(list_filter(inc, lambda w: contains(t, w))) > 0 AND len(list_filter(list_concat(exc, coalesce(never, [])), lambda w: contains(t, w))) = 0"""),
)
def chat_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("one", "a", ["ther", "ing"], ["tion"]), ("one", "b", ["ein"], []), ("one", "*", [], ["eau"]), ("two", "a", ["tion"], ["the"])]
    rules = spark.createDataFrame(rows, "chat string, category string, include array<string>, exclude array<string>")
    return filters.admitted(models.articles(spark, sf_dir).select("id", "topics"), rules)


@query(
    "b08_cadence_window",
    with_models(f"SELECT id FROM art LEFT JOIN src USING (source_id) WHERE (epoch_us({NOW}) - epoch_us(published_at)) / 3.6e9 <= CASE category WHEN 'ASIA' THEN 48 WHEN 'EUROPE' THEN 12 ELSE 24 END"),
)
def cadence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([("ASIA", 48), ("EUROPE", 12)], "category string, window_hours int")
    return filters.cadence_window(_known(spark, sf_dir), classes, as_of()).select("id")


@query("b09_scope", with_models("SELECT id, category FROM art JOIN src USING (source_id) WHERE category IN ('ASIA', 'AFRICA')"))
def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(F.lit("ASIA"), F.lit("AFRICA"))
    return _known(spark, sf_dir).where(F.array_contains(wanted, F.col("category")) | F.array_contains(wanted, F.lit("*"))).select("id", "category")


@query("b10_fresh", with_models(f"SELECT id, coalesce(published_at >= {NOW} - INTERVAL '6' HOUR, false) AS fresh FROM art"))
def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.articles(spark, sf_dir).select("id", F.coalesce(filters.in_window(F.col("published_at"), as_of(), F.lit(6)), F.lit(False)).alias("fresh"))


@query("b11_pool_split", with_models("SELECT id, CASE WHEN category = 'EUROPE' THEN 'drop' ELSE 'news' END AS pool FROM art LEFT JOIN src USING (source_id)"))
def pool_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow = models.sources(spark, sf_dir).where("category = 'EUROPE'").select("source_id")
    rows = models.articles(spark, sf_dir).select("id", "source_id")
    news = rows.join(sized(slow), "source_id", "left_anti").withColumn("pool", F.lit("news"))
    drops = rows.join(sized(slow), "source_id", "left_semi").withColumn("pool", F.lit("drop"))
    return news.unionByName(drops).select("id", "pool")


@query("b12_entry_gate", with_models("SELECT id, relevance * 10 + actionability * 15 AS composite FROM art WHERE relevance >= 6 OR actionability >= 2"))
def entry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.articles(spark, sf_dir).where(filters.entry_gate(F.col("relevance"), F.col("actionability"), 6))
    return rows.select("id", filters.composite(F.col("relevance"), F.col("actionability")).alias("composite"))


@query("b13_confidence_gate", "SELECT event_id FROM events WHERE CASE WHEN event_type <> 'view' THEN value / 20 END IS NULL OR value / 20 >= 0.5")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("confidence", F.when(F.col("event_type") != "view", F.col("value") / 20))
    return rows.where("confidence is null or confidence >= 0.5 or value / 20 >= 0.5").select("event_id")


@query(
    "b16_snippets",
    with_models("SELECT id, replace(substr(body, 1, 120), chr(10), ' ') AS snippet, md5(trim(title || chr(10) || chr(10) || substr(body, 1, 500))) AS embed_md5 FROM art"),
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.articles(spark, sf_dir)
    return rows.select("id", text.snippet(F.col("body"), 120).alias("snippet"), F.md5(text.embedding_text(F.col("title"), F.col("body")).cast("binary")).alias("embed_md5"))


@query("c01_source_lookup", with_models("SELECT id, coalesce(name, 'Unknown') AS name, category, bias FROM art LEFT JOIN src USING (source_id)"))
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).select("id", "name", "category", "bias")


@query(
    "c02_unseen_urls",
    "SELECT page_id, url FROM pages p WHERE page_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM pages s WHERE s.page_id % 2 = 0 AND regexp_extract(s.url, '^https?://([^/]+)', 1) = regexp_extract(p.url, '^https?://([^/]+)', 1))",
)
def unseen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    return joins.unseen(pages.where("page_id % 2 = 1"), pages.where("page_id % 2 = 0"), "host").select("page_id", "url")


@query("c03_undelivered", with_models("SELECT id FROM art WHERE NOT EXISTS (SELECT 1 FROM dlv WHERE article_id = id AND account = 'acct1')"))
def undelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.undelivered(models.articles(spark, sf_dir), models.deliveries(spark, sf_dir), "acct1").select("id")


@query("c04_scored", with_models("SELECT id, quality, toxic FROM art JOIN scored ON article_id = id"))
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.articles(spark, sf_dir).join(models.scores(spark, sf_dir), F.col("id") == F.col("article_id")).select("id", "quality", "toxic")


@query(
    "c06_best_match",
    """
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT s.vec_id AS story_id, t.vec_id AS thread_id, round(list_cosine_similarity(s.v, t.v), 9) AS similarity FROM u s JOIN u t ON s.label >= 3 AND t.label < 3),
b AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY similarity DESC, thread_id) AS n FROM p WHERE similarity > 0)
SELECT story_id, CASE WHEN similarity >= 0.3 THEN thread_id END AS thread_id, CASE WHEN similarity >= 0.3 THEN similarity END AS similarity
FROM (SELECT vec_id AS story_id FROM u WHERE label >= 3) LEFT JOIN (SELECT * FROM b WHERE n = 1) USING (story_id)""",
)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    stories, threads = (v.where(which).select(F.col("vec_id").alias(name), F.col("embedding").alias("vector")) for which, name in (("label >= 3", "story_id"), ("label < 3", "thread_id")))
    return joins.best_match(stories, threads, 0.3)


@query(
    "c07_map_back",
    "WITH r AS (SELECT conv_id AS batch_id, turn % 3 AS item_id, turn AS position, length(text) AS n FROM conversations WHERE role = 'assistant'), b AS (SELECT DISTINCT conv_id AS batch_id, turn AS item_id FROM conversations) SELECT b.batch_id, b.item_id, CAST(arg_min(n, position) AS INTEGER) AS answer_chars FROM b JOIN r USING (batch_id, item_id) GROUP BY ALL",
)
def map_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    replies = c.where("role = 'assistant'").select(F.col("conv_id").alias("batch_id"), (F.col("turn") % 3).alias("item_id"), F.col("turn").alias("position"), F.length("text").alias("answer_chars"))
    batches = c.select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("item_id")).distinct()
    return joins.map_back(batches, replies)[0]


@query(
    "c07_retry_set",
    "WITH r AS (SELECT conv_id AS batch_id, turn % 3 AS item_id FROM conversations WHERE role = 'assistant') SELECT DISTINCT conv_id AS batch_id, turn AS item_id FROM conversations WHERE (conv_id, turn) NOT IN (SELECT (batch_id, item_id) FROM r)",
)
def retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    replies = c.where("role = 'assistant'").select(F.col("conv_id").alias("batch_id"), (F.col("turn") % 3).alias("item_id"), F.col("turn").alias("position"), F.length("text").alias("answer_chars"))
    return joins.map_back(c.select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("item_id")).distinct(), replies)[1]


@query(
    "c08_merge_plan",
    """
WITH o AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS weight FROM supplier WHERE s_suppkey % 3 <> 0), n AS (SELECT s_suppkey AS k, 'new ' || s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 END AS weight FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT k, coalesce(n.name, o.name) AS name, coalesce(n.weight, o.weight) AS weight, CASE WHEN n.name IS NULL THEN 'keep' WHEN o.name IS NULL THEN 'insert' ELSE 'update' END AS action FROM o FULL JOIN n USING (k)""",
)
def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("weight"))
    new = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("new "), "s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") + 1).alias("weight"))
    return joins.merge_rows(new, old, "k")


@query(
    "c10_topic_overlap",
    with_models("""
, t AS (SELECT id, len(topics) AS n, unnest(topics) AS topic FROM art),
p AS (SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, count(*) AS shared FROM t a JOIN t b ON a.topic = b.topic AND a.id < b.id GROUP BY ALL)
SELECT a, b, shared FROM p WHERE shared >= 2 OR n_a <= 2 OR n_b <= 2"""),
)
def topic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.topic_overlap(models.articles(spark, sf_dir))


@query(
    "c10_topic_links",
    with_models("""
, t AS (SELECT id, len(topics) AS n, unnest(topics) AS topic FROM art),
p AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.topic = b.topic AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 2 OR a.n <= 2 OR b.n <= 2),
k AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT id, CASE WHEN len(topics) = 0 THEN id ELSE min(id) OVER (PARTITION BY list_sort(topics)) END AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS links FROM art LEFT JOIN k ON a = id"""),
)
def topic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's class of equal topics and number of overlapping articles, without pairs."""
    return overlaps.topic_links(models.articles(spark, sf_dir))


@query(
    "c12_woven",
    with_models("""
, d AS (SELECT art.*, category FROM art JOIN src USING (source_id)), m AS (SELECT category, flatten(list(topics)) AS main FROM d WHERE relevance = 10 GROUP BY category)
SELECT id, category FROM d JOIN m USING (category) WHERE relevance < 5 AND list_has_any(topics, main)"""),
)
def woven(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _known(spark, sf_dir).where("category is not null")
    return joins.woven(rows.where("relevance < 5"), rows.where("relevance = 10"), "category").select("id", "category")


@query("c13_prior_point", "SELECT event_id, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prior_value FROM events")
def prior_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return joins.prior_point(rows, ["user_id", "event_type"], F.struct("ts", "event_id"), ["value"]).select("event_id", "prior_value")


@query(
    "f01_pool_union",
    with_models("SELECT id, 'priority' AS tier FROM art JOIN src USING (source_id) WHERE category = 'ASIA' UNION ALL SELECT id, 'news' FROM art JOIN src USING (source_id) WHERE category = 'EUROPE'"),
)
def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _known(spark, sf_dir).select("id", "category")
    return rows.where("category = 'ASIA'").select("id", F.lit("priority").alias("tier")).unionByName(rows.where("category = 'EUROPE'").select("id", F.lit("news").alias("tier")))


@query("f02_except", with_models("SELECT id FROM art EXCEPT ALL SELECT article_id FROM scored"))
def minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.articles(spark, sf_dir).select("id").exceptAll(models.scores(spark, sf_dir).select("article_id"))


@query("f03_intersect", with_models("SELECT unnest(topics) AS topic FROM art WHERE actionability = 0 INTERSECT SELECT unnest(topics) FROM art WHERE actionability = 3"))
def common(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.articles(spark, sf_dir).select("actionability", F.explode("topics").alias("topic"))
    return rows.where("actionability = 0").select("topic").intersect(rows.where("actionability = 3").select("topic"))


@query("f04_distinct_sources", with_models("SELECT DISTINCT source_id, category FROM art LEFT JOIN src USING (source_id)"))
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).select("source_id", "category").distinct()


@query(
    "g16_topic_jaccard",
    with_models("""
, t AS (SELECT id, topics FROM art), p AS (SELECT a.id AS a, b.id AS b, a.topics AS x, b.topics AS y FROM t a JOIN t b ON b.id = a.id + 1)
SELECT a, b, round(CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END, 9) AS jaccard FROM p"""),
)
def topic_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = models.articles(spark, sf_dir).select("id", "topics")
    nxt = t.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("topics").alias("y"))
    return t.select(F.col("id").alias("a"), F.col("topics").alias("x")).join(nxt, "a").select("a", "b", F.round(quantity.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))
