"""L rows and the reply logic of G, with offline models so that results can be checked; and what is left of C, D, H and K."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta import models
from gazetta.functions import briefs, deltas, html, replies, text
from gazetta.models import with_models
from gazetta.operators import graphs, joins, windows
from gazetta.plans import inference
from gazetta.queries.registry import query
from gazetta.session import sized, stash, stash_dir, table
from gazetta.sources import store
from gazetta.streaming import jobs


@query("l01_embed_missing", "SELECT doc_id, CAST(64 AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS stored FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a stored vector keep it; the others get one."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.embedding_text(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text")).alias("said"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    out = inference.embed_missing(d.join(v, "doc_id", "left"), "said", "vector").select("doc_id", "vector")
    kept = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5)
    return out.join(v.select("doc_id", F.lit(True).alias("had")), "doc_id", "left").select("doc_id", F.size("vector").alias("n"), F.when(F.col("had"), kept).alias("stored"))


def _label_prompt(frame: pd.DataFrame) -> str:
    return json.dumps([[int(i), text] for i, text in sorted(zip(frame["item_id"], frame["said"], strict=True))])


def _label_model(prompt: str) -> str:
    """An offline model that reads texts: labels by their letters, leaves some out, names one foreign id, fails where the first text has nine i, or eighteen, or none."""
    items = json.loads(prompt)
    if items[0][1].count("i") % 9 == 0:
        raise RuntimeError("no answer")
    rows = [{"article_id": str(i), "label": "KEEP_WARM" if s.count("e") % 3 else "IMMEDIATE", "relevance_score": s.count("e") % 12, "actionability": s.count("n") % 5, "topics": [s[:3]]} for i, s in items if s.count("a") % 7]
    return "Sure:\n```json\n" + json.dumps([*rows, {"article_id": "-5", "label": "IMMEDIATE"}]) + "\n```"


def _answers(batches: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    got = raw.select("batch_id", F.posexplode(replies.items(F.col("raw"))).alias("position", "x"))
    got = got.select("batch_id", F.col("x.article_id").try_cast("long").alias("item_id"), "position", replies.clean_score(F.col("x"), []).alias("score"))
    return joins.map_back(batches.select("batch_id", "item_id"), got)


def _queue(articles: DataFrame) -> DataFrame:
    return inference.in_batches(articles.select("id", F.col("source_id").alias("queue"), F.coalesce(F.substring("body", 1, 80), F.lit("")).alias("said")), [F.col("id")])


FIRST = """
, q AS (SELECT id, source_id, coalesce(substr(body, 1, 80), '') AS s, (row_number() OVER (PARTITION BY source_id ORDER BY id) - 1) // 10 AS b FROM art),
k AS (SELECT *, length(s) - length(replace(s, 'e', '')) AS e, length(s) - length(replace(s, 'n', '')) AS n, length(s) - length(replace(s, 'a', '')) AS a, length(s) - length(replace(s, 'i', '')) AS i FROM q),
m AS (SELECT *, first_value(i) OVER (PARTITION BY source_id, b ORDER BY id) AS head FROM k)"""


@query("l02_batched_labels", with_models(FIRST + " SELECT id, CASE WHEN e % 3 = 0 THEN 'IMMEDIATE' ELSE 'KEEP_WARM' END AS label FROM m WHERE head % 9 <> 0 AND a % 7 <> 0"))
def batched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = stash(_queue(models.articles(spark, sf_dir)))
    got, _ = _answers(batches, stash(inference.ask(batches, _label_prompt, _label_model)))
    return got.select(F.col("item_id").alias("id"), F.col("score.label").alias("label"))


SCORED = (
    FIRST
    + """,
f AS (SELECT *, a % 7 <> 0 AND (head % 9 <> 0 OR i % 9 <> 0) AS answered, CASE WHEN e % 12 <= 10 THEN e % 12 ELSE 0 END AS r, CASE WHEN n % 5 <= 3 THEN n % 5 ELSE 0 END AS act FROM m),
z AS (SELECT id, CAST(r AS INTEGER) AS relevance, CAST(CASE WHEN r >= 8 AND e % 3 = 0 THEN greatest(2, act) ELSE act END AS INTEGER) AS actionability, head % 9 = 0 AS retried, answered FROM f)"""
)


def _scored(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, dead letters): rows that the first pass left out are asked one by one; those left then are the dead letters."""
    batches = stash(_queue(articles))
    got, left = _answers(batches, stash(inference.ask(batches, _label_prompt, _label_model)))
    texts = batches.select("batch_id", "item_id", "said")
    single = stash(left.join(texts, ["batch_id", "item_id"]).withColumn("batch_id", F.concat(F.lit("one-"), F.col("item_id").cast("string"))))
    again, dead = _answers(single, stash(inference.ask(single, _label_prompt, _label_model)))
    out = got.withColumn("retried", F.lit(False)).unionByName(again.withColumn("retried", F.lit(True)))
    return out.select(F.col("item_id").alias("id"), "score.relevance", "score.actionability", "retried"), dead.select(F.col("item_id").alias("id"))


@query("l03_scores_with_retry", with_models(SCORED + " SELECT id, relevance, actionability, retried FROM z WHERE answered"))
def scores_with_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(models.articles(spark, sf_dir))[0]


@query("l03_two_sinks", with_models(SCORED + " SELECT id, CASE WHEN answered THEN relevance END AS relevance, NOT answered AS dead FROM z"))
def scores_and_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as a stream: scores to one sink and what no pass answered to another, from one pass under the batch's number."""
    base = f"{stash_dir(spark)}/stream-{uuid.uuid4().hex}"
    landed = models.articles(spark, sf_dir).select("id", "source_id", F.substring("body", 1, 80).alias("body"))
    landed.write.parquet(f"{base}/landed")
    stream = jobs.files(spark, f"{base}/landed", landed, per_trigger=1_000_000)
    store.two_sinks(stream, f"{base}/checkpoint", _scored, store.batch_sink(f"{base}/scores"), store.batch_sink(f"{base}/dead"), f"{base}/kept").awaitTermination()
    scores = spark.read.schema("id long, relevance int").parquet(f"{base}/scores").select("id", "relevance", F.lit(False).alias("dead"))
    dead = spark.read.schema("id long").parquet(f"{base}/dead").select("id", F.lit(None).cast("int").alias("relevance"), F.lit(True).alias("dead"))
    return scores.unionByName(dead)


@query("g14_clean_scores", "SELECT doc_id, CAST(CASE WHEN n_chars % 13 <= 10 THEN n_chars % 13 ELSE 0 END AS INTEGER) AS relevance, CASE WHEN doc_id % 2 = 0 THEN 'NEW_SIGNAL' ELSE 'NOISE' END AS label, [lower(source)] AS topics, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE -1 END AS alignment FROM documents")
def clean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = F.format_string(
        'noise {"article_id": "%d", "relevance_score": %d, "label": "%s", "topics": ["%s ", ""], "hypotheses": [{"id": "h1", "alignment": %s}, {"id": "zz", "alignment": 1}], "actionability": 1} tail',
        "doc_id", F.col("n_chars") % 13, F.when(F.col("doc_id") % 2 == 0, "NEW_SIGNAL").otherwise("OTHER"), F.upper("source"), F.when(F.col("doc_id") % 3 == 0, "7.9").otherwise("-1.5"),
    )
    x = d.select("doc_id", replies.clean_score(replies.items(raw)[0], ["h1"]).alias("s"))
    return x.select("doc_id", "s.relevance", "s.label", "s.topics", F.col("s.hypotheses")[0]["alignment"].alias("alignment"))


@query("d16_duplicate_counts", "WITH r AS (SELECT l_orderkey, l_partkey % 50 AS part, l_linenumber, l_suppkey % 50 AS listed FROM lineitem) SELECT l_orderkey, l_linenumber, part, CAST(1 + (SELECT count(*) FROM r x WHERE x.l_orderkey = r.l_orderkey AND x.listed <> r.part AND x.listed IN (SELECT y.part FROM r y WHERE y.l_orderkey = r.l_orderkey)) AS BIGINT) AS duplicates FROM r")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plus the listed ids that are in the batch and not the row itself; repeats count."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("part"), (F.col("l_suppkey") % 50).alias("listed"))
    batch = r.groupBy("l_orderkey").agg(F.collect_set("part").alias("parts"), F.collect_list("listed").alias("all"))
    own = F.filter("all", lambda x: F.array_contains("parts", x) & (x != F.col("part")))
    return r.join(batch, "l_orderkey").select("l_orderkey", "l_linenumber", "part", (F.size(own) + 1).cast("long").alias("duplicates"))


@query("c14_hypotheses", "WITH h AS (SELECT doc_id, unnest([doc_id % 5, doc_id % 7]) AS h, generate_subscripts([0, 0], 1) - 2 AS alignment FROM documents), t(h, topic, stance) AS (VALUES (0, 'rates', 'up'), (1, 'chips', 'down'), (2, 'grain', 'up')) SELECT doc_id, topic, stance, CAST(alignment AS INTEGER) AS alignment FROM h JOIN t USING (h)")
def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pairs = F.array(F.struct((F.col("doc_id") % 5).alias("h"), F.lit(-1).alias("alignment")), F.struct((F.col("doc_id") % 7).alias("h"), F.lit(0).alias("alignment")))
    known = spark.createDataFrame([(0, "rates", "up"), (1, "chips", "down"), (2, "grain", "up")], "h long, topic string, stance string")
    return d.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.*").join(sized(known), "h").select("doc_id", "topic", "stance", "alignment")


@query(
    "a03_markdown_links",
    r"""
WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS u, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages),
l AS (SELECT page_id, 'https://h.example' || unnest(u) AS url, trim(regexp_replace(unnest(t), '\s+', ' ', 'g')) AS title, generate_subscripts(u, 1) AS position FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY position) AS k FROM l WHERE length(title) > 2 AND NOT regexp_matches(url, '[)\s]') AND NOT contains(title, ']'))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY position) AS INTEGER) AS rank, url, title FROM f WHERE k = 1""",
)
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose anchors are written as Markdown first."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', r"[$2](https://h.example$1)").alias("md"))
    return html.markdown_links(p, "page_id", "md", 2)


@query("e14_trajectories", "SELECT user_id, list(value ORDER BY event_id)[-3:] AS points FROM events GROUP BY 1")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("p"))
    return g.select("user_id", F.slice("p", -F.least(F.lit(3), F.size("p")), 3).alias("points"))


@query("e09_fresh_admission", with_models(", c AS (SELECT id FROM art WHERE relevance >= 8 OR actionability >= 2) SELECT id, true AS chosen FROM c UNION ALL SELECT id, false FROM art WHERE relevance >= 4 AND published_at >= TIMESTAMP '2024-01-03 21:00:00' - INTERVAL '6' HOUR AND id NOT IN (SELECT id FROM c)"))
def fresh_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazetta.models import as_of
    from gazetta.operators import filters

    a = models.articles(spark, sf_dir)
    over = filters.entry_gate(F.col("relevance"), F.col("actionability"), 8)
    fresh = filters.in_window(F.col("published_at"), as_of(), F.lit(6)) & (F.col("relevance") >= 4)
    return a.where(over | fresh).select("id", over.alias("chosen"))


COPIES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)] END)) AS sh FROM w WHERE len(words) > 0),
r AS (SELECT min(doc_id) AS id, sh FROM s GROUP BY sh), x AS (SELECT id, len(sh) AS n, unnest(sh) AS g FROM r),
p AS (SELECT a.id AS a, b.id AS b, CAST(count(*) AS INTEGER) AS shared, CAST(a.n + b.n - count(*) AS INTEGER) AS either FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*)))"""


@query("h06_text_copies", COPIES + " SELECT * FROM p")
def text_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.text_copies(table(spark, sf_dir, "documents"))


@query(
    "h06_copy_links",
    COPIES + """, m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sh) AS class_id, count(*) OVER (PARTITION BY sh) AS copies FROM s),
k AS (SELECT x.c AS c, sum(y.n) AS links FROM (SELECT a AS c, b AS d FROM p UNION ALL SELECT b, a FROM p) x JOIN (SELECT class_id, count(*) AS n FROM m GROUP BY 1) y ON y.class_id = x.d GROUP BY 1)
SELECT doc_id, class_id, copies, CAST(coalesce(links, 0) AS BIGINT) AS links FROM m LEFT JOIN k ON c = class_id
UNION ALL SELECT doc_id, doc_id, 1, 0 FROM documents WHERE NOT coalesce(regexp_matches(lower(text), '[a-z0-9]'), false)""",
)
def copy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of equal shingles and number of near copies outside it."""
    return graphs.copy_links(table(spark, sf_dir, "documents"))


@query("g11_deltas", "WITH p AS (SELECT event_id, event_type, value, lag(value) OVER w AS old, lag(event_type) OVER w AS old_kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, 'tally' AS delta FROM p WHERE event_type <> 'error' AND old_kind <> 'error' AND value > old AND old <> 0 AND round(value - old, 9) / old >= 0.15")
def fact_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as text, as a model gives them; errors are facts of the other family."""
    e = table(spark, sf_dir, "events")
    points = e.select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.col("value").cast("decimal(18,2)").cast("string").alias("value"), F.when(F.col("event_type") == "error", "status").otherwise("tally").alias("kind"))
    rows = joins.prior_point(points, ["user_id"], F.col("at"), ["value", "kind"])
    delta = deltas.classify(F.col("kind"), F.col("prior_value"), F.col("value"), F.col("prior_kind"))
    return rows.where(F.col("kind") == "tally").select("event_id", delta.alias("delta")).where("delta is not null")


def _phrases(words: list[str], column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


TENSES = (
    r"""
WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
h AS (SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(substr(before, 1, 1000), '') || CASE WHEN length(before) % 3 = 0 THEN '' ELSE ' plans' || chr(10) || 'to sell' END, '\s+', ' ', 'g'))) AS source,
  lower(trim(regexp_replace('- ' || replace(text, chr(10), ' ') || CASE WHEN length(text) % 2 = 0 THEN ' has signed' ELSE '' END || ' [s](https://e.example/' || turn || ')', '\s+', ' ', 'g'))) AS bullet FROM t)
SELECT conv_id, turn FROM h WHERE """
    + _phrases(briefs.HEDGED, "source")
    + " AND "
    + _phrases(briefs.DONE, "bullet")
)


@query("k05_tense_mismatch", TENSES)
def tense_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a brief with a cited bullet a turn; the highlight behind it is the turn before."""
    rows = joins.prior_point(table(spark, sf_dir, "conversations"), ["conv_id"], F.col("turn"), ["text"])
    url = F.concat(F.lit("https://e.example/"), F.col("turn").cast("string"))
    line = F.concat(F.lit("- "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.when(F.length("text") % 2 == 0, " has signed").otherwise(""), F.lit(" [s]("), url, F.lit(")"))
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    written = rows.groupBy("conv_id").agg(text_of.alias("content"))
    none = F.lit(None).cast("string")
    hedge = F.when(F.length("prior_text") % 3 == 0, "").otherwise("plans\nto sell")
    highlights = rows.select("conv_id", "turn", url.alias("url"), none.alias("title"), none.alias("differentiator"), F.concat(F.substring("prior_text", 1, 1000), F.lit(" "), hedge).alias("reasoning"), none.alias("body"))
    # A first turn has nothing before it: what is left of the source is the hedge alone.
    highlights = highlights.withColumn("reasoning", F.coalesce("reasoning", F.lit("plans to sell")))
    return briefs.overstated(highlights, written, "conv_id", "content").select("conv_id", "turn")


TAILS = r"""
WITH l AS (SELECT doc_id, length(text) AS size, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, size, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l),
n AS (SELECT *, sum(CAST(trim(line, ' ') <> '' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
s AS (SELECT doc_id, max(pos) AS last FROM n WHERE trim(line, ' ') <> '' AND (regexp_matches(line, '[.!?:;"'')\]*_]\s*$') OR starts_with(line, '#') OR trim(line, ' ') = '---' OR coalesce(before, 0) >= 5) GROUP BY 1),
k AS (SELECT doc_id, size, length(array_to_string(lines[1:coalesce(last, 0)], chr(10))) AS kept FROM l LEFT JOIN s USING (doc_id))
SELECT doc_id, CAST(kept AS INTEGER) AS kept, CAST(size - kept AS INTEGER) AS cut FROM k"""


@query("k07_truncated_tails", TAILS)
def truncated_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    kept = briefs.truncated_tail(F.col("text"))
    return d.select("doc_id", F.length(kept).alias("kept"), (F.length("text") - F.length(kept)).alias("cut"))


@query(
    "k12_digest_blocks",
    with_models("""
, a AS (SELECT art.*, category, name, id % 4 + 1 AS cluster_rank, lower(bias) AS lean FROM art JOIN src USING (source_id) WHERE relevance >= 9),
h AS (SELECT id, unnest([id % 5, id % 7]) AS h, generate_subscripts([0, 0], 1) AS n FROM a), k(h, topic, stance) AS (VALUES (0, 'rates', 'up'), (1, 'chips', 'down'), (2, 'grain', 'up')),
m AS (SELECT id, string_agg('matches ' || chr(39) || topic || chr(39) || ' (stance ' || stance || '), alignment ' || CASE WHEN n = 1 THEN '-1' ELSE '+2' END, '; ' ORDER BY n) AS hyp FROM h JOIN k USING (h) GROUP BY id),
v AS (SELECT DISTINCT category, cluster_rank, source_id, CASE WHEN contains(lean, 'left') THEN 'left' WHEN contains(lean, 'right') THEN 'right' WHEN contains(lean, 'cent') THEN 'center' END AS side FROM a),
g AS (SELECT category, cluster_rank, CASE WHEN count(*) FILTER (side = 'left') > 0 AND count(*) FILTER (side IN ('right', 'center')) = 0 THEN 'left' WHEN count(*) FILTER (side = 'right') > 0 AND count(*) FILTER (side IN ('left', 'center')) = 0 THEN 'right' END AS coverage FROM v GROUP BY ALL),
t AS (SELECT category, cluster_rank, relevance, id, array_to_string(['Article:', '  url: https://example.com/' || id, '  source: ' || name, '  title: ' || title, '  published: ' || strftime(published_at, '%Y-%m-%d %H:%M'), '  relevance: ' || relevance, '  actionability: ' || actionability,
  '  topics: ' || array_to_string(topics, ', '), '  reasoning: (none)', '  hypotheses: ' || coalesce(hyp, 'none'), '  snippet: ' || replace(substr(body, 1, 80), chr(10), ' ')], chr(10)) AS s FROM a LEFT JOIN m USING (id)),
c AS (SELECT category, cluster_rank, count(*) AS n, string_agg(s, chr(10) || chr(10) ORDER BY relevance DESC, id) AS body FROM t GROUP BY ALL),
b AS (SELECT category, cluster_rank, '=== Cluster ' || cluster_rank || ' (' || n || ' articles)' || CASE WHEN coverage IS NULL THEN '' ELSE ' [one-sided coverage: ' || coverage || ']' END || ' ===' || chr(10) || chr(10) || body AS s FROM c JOIN g USING (category, cluster_rank))
SELECT category, string_agg(s, chr(10) || chr(10) ORDER BY cluster_rank) AS block FROM b GROUP BY category"""),
)
def digest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is given of each category: four clusters, their coverage, articles with their hypotheses."""
    from gazetta.operators import aggregates

    a = joins.with_source(models.articles(spark, sf_dir), models.sources(spark, sf_dir)).where("category is not null and relevance >= 9")
    pairs = F.array(F.struct((F.col("id") % 5).alias("id"), F.lit(-1).alias("alignment")), F.struct((F.col("id") % 7).alias("id"), F.lit(2).alias("alignment")))
    rows = a.withColumns({"cluster_rank": F.col("id") % 4 + 1, "at": -F.col("relevance"), "url": F.concat(F.lit("https://example.com/"), F.col("id").cast("string")), "reasoning": F.lit(None).cast("string"), "matches": pairs})
    known = spark.createDataFrame([(0, "rates", "up"), (1, "chips", "down"), (2, "grain", "up")], "id long, topic string, stance string")
    clusters = aggregates.source_balance(rows, ["category", "cluster_rank"])
    return briefs.digest_blocks(rows, clusters, known, "category", 80)


@query("h05_representative_job", None)
def representative_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of text copies, equal ones too, a confirm rule, then the representatives; clusters that aren't confirmed keep all."""
    parts, pairs = graphs.copy_clusters(table(spark, sf_dir, "documents"))
    parts = stash(parts)
    a = joins.with_source(models.articles(spark, sf_dir), models.sources(spark, sf_dir)).join(parts, "id")
    done = models.scores(spark, sf_dir).select(F.col("article_id").alias("id"))
    a = joins.unseen(a, done, "id").withColumn("lean", F.lower("bias"))
    # Equal sets overlap wholly, so only pairs of different ones can speak against a cluster.
    low = pairs.join(parts, F.col("a") == F.col("id")).groupBy("cluster").agg(F.min(F.col("shared") / F.col("either")).alias("low"))
    doubted = low.where("low < 0.86").select("cluster", F.lit(True).alias("doubted"))
    out = windows.representatives(a.select("cluster", "id", "published_at", "n_chars", "category", "lean"), 2)
    return out.join(doubted, "cluster", "left").select("cluster", "id", (F.col("keep") | F.col("doubted").isNotNull()).alias("keep"))


def _fact_model(prompt: str) -> str:
    """An offline model that reads the text: its first number and the word after it; no number, no reply. It names an id of its own, which must not count."""
    import re

    found = re.search(r"([0-9]+) ([a-z]+)", prompt.split("\n\n", 1)[1])
    if not found:
        raise RuntimeError("no answer")
    kind = {0: "tally", 1: "magnitude", 2: "rumour"}[len(found[2]) % 3]
    return "Here:\n```json\n" + json.dumps({"delta_type": kind, "value": "" if found[1] == "0" else found[1], "unit": found[2] if len(found[2]) > 3 else "", "short_fact": found[0], "article_ids": [-1]}) + "\n```"


@query(
    "l05_fact_extraction",
    "WITH f AS (SELECT doc_id, regexp_extract(substr(text, 1, 1200), '([0-9]+) ([a-z]+)', 1) AS value, regexp_extract(substr(text, 1, 1200), '([0-9]+) ([a-z]+)', 2) AS word FROM documents) SELECT doc_id, CASE length(word) % 3 WHEN 0 THEN 'tally' ELSE 'magnitude' END AS delta_type, value, CASE WHEN length(word) > 3 THEN word END AS unit, substr(value || ' ' || word, 1, 120) AS short_fact FROM f WHERE word <> '' AND value <> '0' AND length(word) % 3 < 2",
)
def fact_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    got = inference.facts(d, _fact_model, "source", "text", ["magnitude", "tally", "status"])
    return got.select("doc_id", "delta_type", "value", "unit", "short_fact")


def _summary_model(prompt: str) -> str:
    """An offline model: the first sentence and the first 300 characters of the content; none without a sentence."""
    content = prompt.split("\ncontent:\n", 1)[1]
    if ". " not in content:
        raise RuntimeError("no answer")
    return json.dumps({"short": " " + content.split(". ")[0], "long": content[:300] + " "})


@query(
    "l06_drop_summaries",
    "WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, substr(text, 1, 6000) AS body FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(CASE WHEN contains(body, '. ') THEN substr(trim(split_part(body, '. ', 1), ' '), 1, 280) ELSE substr(title, 1, 280) END) AS short_md5, md5(CASE WHEN contains(body, '. ') THEN trim(substr(body, 1, 300), ' ') ELSE '' END) AS long_md5, NOT contains(body, '. ') AS fallback FROM d",
)
def drop_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text", none.alias("differentiator"), none.alias("reasoning"))
    got = inference.summaries(d, _summary_model, "title", "text", "differentiator", "reasoning")
    return got.select("doc_id", F.md5(F.col("short").cast("binary")).alias("short_md5"), F.md5(F.col("long").cast("binary")).alias("long_md5"), "fallback")
