"""Further rows: feeds, lookups, links, per-chat selection, threads, section assembly, SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta import models
from gazetta.functions import deltas, html, quantity, registry, text
from gazetta.models import as_of, with_models
from gazetta.operators import filters, joins
from gazetta.plans import briefs, inference
from gazetta.queries.registry import query
from gazetta.queries.scalars import QUANTITY
from gazetta.session import sized, stash, table
from gazetta.sources import drops, feeds


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_source(models.articles(spark, sf_dir), models.sources(spark, sf_dir))


@query(
    "a01_feed_entries",
    with_models("""
, d AS (SELECT id, source_id, trim(title, ' ') AS title, CASE WHEN id % 5 = 4 THEN NULL WHEN id % 5 = 2 THEN published_at WHEN id % 5 = 3 THEN date_trunc('minute', published_at) ELSE date_trunc('second', published_at) END AS dated FROM art),
f AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(dated, TIMESTAMP '2024-01-03 21:00:00') DESC, 'https://example.com/' || id) AS n FROM d
  WHERE title <> '' AND (dated IS NULL OR dated >= TIMESTAMP '2024-01-03 21:00:00' - INTERVAL '48' HOUR) AND NOT contains(lower(title), 'partner') AND NOT contains(lower(title), 'sponsored'))
SELECT id, source_id, md5(title) AS title_md5, CAST(epoch_us(coalesce(dated, TIMESTAMP '2024-01-03 21:00:00')) // 1000000 AS BIGINT) AS seconds FROM f WHERE n <= 10"""),
)
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as feed items, and read back as entries: mail dates in two zones, ISO dates, Atom entries, undated ones."""
    a = models.articles(spark, sf_dir)
    link = F.concat(F.lit("https://example.com/"), F.col("id").cast("string"))
    mail = F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    tokyo = F.concat(F.date_format(F.from_utc_timestamp("published_at", "Asia/Tokyo"), "d MMM yy HH:mm:ss"), F.lit(" +0900"))
    eastern = F.concat(F.date_format(F.col("published_at") - F.expr("interval 5 hours"), "d MMM yyyy HH:mm"), F.lit(" EST"))
    said = F.when(F.col("id") % 5 == 0, mail).when(F.col("id") % 5 == 1, tokyo).when(F.col("id") % 5 == 3, eastern)
    title, body = feeds.escape(F.col("title")), feeds.escape(F.substring("body", 1, 200))
    dated = F.coalesce(F.concat(F.lit("<pubDate>"), said, F.lit("</pubDate>")), F.lit(""))
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link>"), dated, F.lit("<description>"), body, F.lit("</description></item>"))
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    atom = F.concat(F.lit("<entry><title>"), title, F.lit('</title><link rel="self" href="https://example.com/feed"/><link rel="alternate" href="'), link, F.lit('"/><published>'), iso, F.lit("</published><summary>"), body, F.lit("</summary></entry>"))
    xml = F.when(F.col("id") % 5 == 2, atom).otherwise(rss)
    got = feeds.entries(a.select("id", "source_id", xml.alias("xml")), "xml", "source_id", as_of(), 48, 10, keep=["id"])
    return got.select("id", "source_id", F.md5(F.col("title").cast("binary")).alias("title_md5"), F.unix_seconds("published_at").alias("seconds"))


def _slug(said: str) -> str:
    """The first four runs of letters and digits, joined by hyphens, 40 characters, else ``drop``; for DuckDB."""
    made = f"rtrim(substr(array_to_string(regexp_extract_all(lower({said}), '[a-z0-9]+')[1:4], '-'), 1, 40), '-')"
    return f"CASE WHEN coalesce({made}, '') = '' THEN 'drop' ELSE {made} END"


LOOKUP = with_models(
    f"""
, st AS (SELECT CAST(published_at AS DATE) AS date, {_slug("title")} AS slug, relevance AS position, id AS report_id FROM art), days AS (SELECT DISTINCT date FROM st ORDER BY date DESC LIMIT 10),
q AS (SELECT item_id AS wanted_id, {_slug("split_part(text, ' ', 2)")} AS ask FROM benchmark),
h AS (SELECT wanted_id, report_id, row_number() OVER (PARTITION BY wanted_id ORDER BY date DESC, CASE WHEN slug = ask THEN 0 ELSE 1 END, position, report_id) AS n FROM st JOIN days USING (date) JOIN q ON contains(slug, ask))
SELECT wanted_id, report_id FROM h WHERE n = 1"""
)


@query("a12_drop_lookup", LOOKUP)
def drop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's second word is a question to the store of articles."""
    store = models.articles(spark, sf_dir).select(F.to_date("published_at").alias("date"), text.slug(F.col("title")).alias("slug"), F.col("relevance").alias("position"), F.col("id").alias("report_id"))
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("wanted_id"), F.concat(F.lit("more: "), F.split_part("text", F.lit(" "), F.lit(2))).alias("said"))
    return drops.find(store, wanted)


@query("b14_context", "SELECT p_partkey AS topic_id, CASE WHEN p_type = 'ECONOMY' THEN 'interest' ELSE 'hypothesis' END AS kind FROM part WHERE p_type = 'ECONOMY' OR p_size % 5 IN (0, 1, 2)")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interests, and hypotheses in a live status; sizes stand for statuses."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("topic_id"), F.when(F.col("p_type") == "ECONOMY", "interest").otherwise("hypothesis").alias("kind"), (F.col("p_size") % 5).alias("status"))
    return p.where((F.col("kind") == "interest") | F.col("status").isin(0, 1, 2)).select("topic_id", "kind")


@query("b17_routes", with_models("SELECT source_id, CASE WHEN source_no % 3 = 0 THEN 'feed' ELSE 'listing' END AS route, CASE WHEN source_no % 2 = 0 THEN 0 ELSE 2 END AS links FROM src"))
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed where there is one; a listing prefers Markdown links, even an empty list, to anchors."""
    s = models.sources(spark, sf_dir)
    feed = F.when(F.col("source_no") % 3 == 0, "https://feed")
    none = F.array().cast("array<string>")
    found = F.coalesce(F.when(F.col("source_no") % 2 == 0, none), F.array(F.lit("a"), F.lit("b")))
    return s.select("source_id", F.when(feed.isNotNull(), "feed").otherwise("listing").alias("route"), F.size(found).alias("links"))


@query(
    "b17_listing_links",
    with_models(r"""
, pg AS (SELECT page_id, source_id, html, page_id % 4 AS k FROM pages JOIN src ON source_no = page_id % 10 WHERE NOT (source_no % 3 = 0 AND source_no % 2 = 0)),
mx AS (SELECT page_id, source_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS u, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pg WHERE k >= 2),
ml AS (SELECT page_id, source_id, 'https://h.example' || unnest(u) AS url, trim(regexp_replace(unnest(t), '\s+', ' ', 'g')) AS title, generate_subscripts(u, 1) AS position FROM mx),
mf AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY position) AS f FROM ml WHERE length(title) > 2 AND NOT regexp_matches(url, '[)\s]') AND NOT contains(title, ']')),
hx AS (SELECT page_id, source_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS u, regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS t FROM pg WHERE k = 0),
hl AS (SELECT page_id, source_id, unnest(u) AS url, trim(regexp_replace(unnest(t), '<[^>]*>', '', 'g')) AS title, generate_subscripts(u, 1) AS position FROM hx)
SELECT page_id, source_id, 'markdown' AS via, CAST(row_number() OVER (PARTITION BY page_id ORDER BY position) AS INTEGER) AS rank, url, title FROM mf WHERE f = 1
UNION ALL SELECT page_id, source_id, 'html', CAST(row_number() OVER (PARTITION BY page_id ORDER BY position) AS INTEGER), url, title FROM hl WHERE length(title) > 2"""),
)
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages of sources without a usable feed; a quarter of the pages came without Markdown, a quarter with none in it."""
    s = models.sources(spark, sf_dir).select("source_id", "source_no")
    has_feed, address = F.col("source_no") % 3 == 0, F.when(F.col("source_no") % 2 == 0, "https://feed").otherwise("")
    listed = s.where(html.is_listing(has_feed, address))
    p = table(spark, sf_dir, "pages").withColumn("source_no", F.col("page_id") % 10).join(sized(listed), "source_no")
    written = F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', r"[$2](https://h.example$1)")
    came = F.when(F.col("page_id") % 4 == 1, "").when(F.col("page_id") % 4 >= 2, written)
    pages = p.select("page_id", "source_id", "html", came.alias("md"))
    return html.listing_links(pages, "page_id", "md", "html", 2, http_only=False).join(pages.select("page_id", "source_id"), "page_id")


@query("c16_story_links", with_models(", b AS (SELECT o_custkey AS story, min(o_orderkey) AS first FROM orders GROUP BY 1) SELECT story, '[' || coalesce(name, 'Unknown') || '](https://example.com/' || first || ')' AS link FROM b JOIN art ON id = first LEFT JOIN src USING (source_id)"))
def story_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link of a story is its first article's."""
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("story")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    first = b.select("story", F.element_at("ids", 1).alias("id"))
    rows = joins.with_source(first.join(models.articles(spark, sf_dir).select("id", "source_id"), "id"), models.sources(spark, sf_dir))
    return rows.select("story", F.concat(F.lit("["), "name", F.lit("](https://example.com/"), F.col("id").cast("string"), F.lit(")")).alias("link"))


@query("g10_override", with_models(", o(category, relative) AS (VALUES ('ASIA', 0.5), ('EUROPE', NULL)) SELECT source_id, CAST(coalesce(relative, 0.15) AS DOUBLE) AS relative FROM src LEFT JOIN o USING (category)"))
def override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global bars, overlaid by those of a category."""
    o = spark.createDataFrame([("ASIA", 0.5), ("EUROPE", None)], "category string, relative double")
    return models.sources(spark, sf_dir).join(sized(o), "category", "left").select("source_id", F.coalesce("relative", F.lit(0.15)).alias("relative"))


def _shown(x: str) -> str:
    """A number of text ``x`` as a note shows it, for DuckDB."""
    size = f"abs(CAST({x} AS DOUBLE))"

    def unit(by: str, mark: str) -> str:
        t = f"CAST(floor({size} / {by} * 10 + 0.5) AS BIGINT)"
        return f"({t} // 10) || CASE WHEN {t} % 10 = 0 THEN '' ELSE '.' || ({t} % 10) END || '{mark}'"

    return f"CASE WHEN CAST({x} AS DOUBLE) < 0 THEN '-' ELSE '' END || CASE WHEN {size} >= 1e6 THEN {unit('1e6', 'M')} WHEN {size} >= 1e3 THEN {unit('1e3', 'K')} ELSE {unit('1e0', '')} END"


NOTES = f"""
WITH e AS (SELECT event_id, user_id, event_type, ts, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS v FROM events),
p AS (SELECT *, lag(v) OVER w AS old, lag(ts) OVER w AS day FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
n AS (SELECT *, CAST(v AS DOUBLE) AS b, CAST(old AS DOUBLE) AS a FROM p WHERE CAST(old AS DOUBLE) <> 0),
c AS (SELECT *, CAST(round_even((b - a) / abs(a) * 100, 0) AS INTEGER) AS change FROM n WHERE abs(b - a) / abs(a) >= 0.5)
SELECT event_id, event_type || CASE WHEN event_type = 'purchase' THEN ': was $' || {_shown("old")} || ' on ' || strftime(day, '%Y-%m-%d') || ', now $' || {_shown("v")} || ' (' || CASE WHEN change >= 0 THEN '+' ELSE '' END || change || '%)'
  ELSE ': was ' || old || ', now ' || v END AS note FROM c"""


@query("g19_shift_notes", NOTES)
def shift_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(18,2)").cast("string").alias("value"))
    rows = joins.prior_point(e, ["user_id", "event_type"], F.struct("ts", "event_id"), ["value", "ts"])
    kind = F.when(F.col("event_type") == "purchase", "price").otherwise("tally")
    moved = quantity.material(quantity.amount(F.col("prior_value")), quantity.amount(F.col("value")), 0.5, 0)
    return rows.where(moved).select("event_id", deltas.note(F.col("event_type"), kind, F.col("prior_value"), F.col("value"), F.col("prior_ts")).alias("note"))


@query("g22_tolerant_timestamps", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(epoch_us(ts) // 1000000 AS BIGINT) - CASE WHEN event_id % 4 = 2 THEN 32400 ELSE 0 END END AS seconds FROM events")
def tolerant_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text: with Z, without a zone, with an offset, and not a time."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    said = F.when(F.col("event_id") % 4 == 0, F.concat("t", F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.col("t")).when(F.col("event_id") % 4 == 2, F.concat("t", F.lit("+09:00"))).otherwise(F.concat(F.lit("about "), "t"))
    return e.select("event_id", F.unix_seconds(text.tolerant_timestamp(said)).alias("seconds"))


@query("k13_assembled", with_models(", s AS (SELECT source_id, CASE WHEN relevance >= 8 THEN 1 WHEN relevance >= 5 THEN 2 ELSE 3 END AS part, id FROM art WHERE relevance >= 3) SELECT source_id, string_agg(CASE part WHEN 1 THEN 'Themes' WHEN 2 THEN 'Highlights' ELSE 'Drops' END || ': ' || ids, ' | ' ORDER BY part) AS brief FROM (SELECT source_id, part, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM s GROUP BY ALL) GROUP BY source_id"))
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in the configured order; an empty section leaves no trace."""
    order = spark.createDataFrame([(1, "Themes"), (2, "Highlights"), (3, "Drops")], "part int, name string")
    a = models.articles(spark, sf_dir).where("relevance >= 3")
    part = F.when(F.col("relevance") >= 8, 1).when(F.col("relevance") >= 5, 2).otherwise(3)
    s = a.groupBy("source_id", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    s = s.join(sized(order), "part").withColumn("t", F.concat("name", F.lit(": "), "ids"))
    return s.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda x: x["t"]), " | ").alias("brief"))


def _confirm_model(prompt: str) -> str:
    """An offline model: true, false, maybe or no JSON at all, by the titles' first letters; fails on a single title."""
    titles = prompt.split("\n")
    if len(titles) < 2:
        raise RuntimeError("no answer")
    first = {t[2:3].lower() for t in titles}
    return '{"same_event": true}' if len(first) == 1 else '{"same_event": "maybe"}' if len(first) == 2 else "no idea"


@query("l04_cluster_confirm", with_models(", t AS (SELECT CAST(floor(id / 3) AS BIGINT) AS cluster, split_part(title, chr(10), 1) AS title FROM art) SELECT cluster, count(*) >= 2 AND count(DISTINCT lower(substr(title, 1, 1))) = 1 AS same FROM t GROUP BY cluster"))
def cluster_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three articles in a row are a cluster; a reply counts only if it says true."""
    a = models.articles(spark, sf_dir).select(F.floor(F.col("id") / 3).cast("long").alias("cluster"), "title")
    return inference.confirmed(a.groupBy("cluster").agg(F.collect_list("title").alias("titles")), _confirm_model).select("cluster", "same")


@query("l07_topic_nudge", with_models(", i(word, weight) AS (VALUES ('ther', 3), ('tion', -2), ('ing', 1)), h AS (SELECT id, sum(weight) AS points FROM art JOIN i ON contains(array_to_string(topics, ' '), word) GROUP BY id) SELECT id, CAST(least(10, greatest(0, relevance + coalesce(points, 0))) AS INTEGER) AS relevance FROM art LEFT JOIN h USING (id)"))
def topic_nudge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance moved by the weights of the interests that the topics hit."""
    weights = {"ther": 3, "tion": -2, "ing": 1}
    a = models.articles(spark, sf_dir).select("id", "relevance", "topics")
    points = sum((F.when(filters.topic_match(F.col("topics"), [w]), n).otherwise(0) for w, n in weights.items()), F.lit(0))
    return a.select("id", F.least(F.lit(10), F.greatest(F.lit(0), F.col("relevance") + points)).alias("relevance"))


@query("l08_sql_functions", with_models("SELECT normalized AS lean, count(*) AS n FROM (SELECT CASE WHEN contains(lower(bias), 'left') THEN 'left' WHEN contains(lower(bias), 'right') THEN 'right' WHEN contains(lower(bias), 'cent') THEN 'center' END AS normalized FROM art LEFT JOIN src USING (source_id)) GROUP BY 1"))
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry.register(spark)
    return spark.sql("SELECT normalize_bias(bias) AS lean, count(*) AS n FROM {rows} GROUP BY 1", rows=_known(spark, sf_dir).select("bias"))


@query("l08_parse_quantity", f"SELECT doc_id, amount FROM ({QUANTITY})")
def sql_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry.register(spark)
    return spark.sql("SELECT doc_id, amount FROM (SELECT doc_id, parse_quantity(text) AS amount FROM {rows}) WHERE amount IS NOT NULL", rows=table(spark, sf_dir, "documents"))


@query("i04_chat_selection")
def chat_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chat's brief in one run; the customers are the chats, and ask for one of few sets of categories and lengths."""
    rules = spark.createDataFrame([("a", ["ther", "ing"], ["eau"]), ("b", ["tion", "ein"], []), ("*", [], ["zzz"])], "category string, include array<string>, exclude array<string>")
    lengths = spark.createDataFrame([("short", 7, 5, 3, 2, 4), ("long", 6, 4, 3, 5, 6)], "length string, bar int, floor int, least int, max_themes int, per_theme int")
    c = table(spark, sf_dir, "customer")
    wanted = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("a"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b")))
    chats = c.select(F.col("c_custkey").alias("chat"), wanted.alias("categories"), F.when(F.col("c_custkey") % 2 == 0, "short").otherwise("long").alias("length"))
    a = _known(spark, sf_dir).select("id", "topics", "category", F.when(F.col("id") % 5 == 0, F.col("id") % 40).alias("story"), "relevance", "actionability", "published_at")
    return briefs.chat_selection(a, chats, rules, lengths, models.as_of(), window=72)
