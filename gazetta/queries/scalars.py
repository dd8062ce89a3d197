"""G and K rows: column logic and text audits over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazetta import models
from gazetta.functions import balance, briefs, quantity, text
from gazetta.models import with_models
from gazetta.operators.slugs import free_slugs
from gazetta.queries.registry import query
from gazetta.session import table


@query("g01_bias", with_models("SELECT source_id, CASE WHEN contains(lower(bias), 'left') THEN 'left' WHEN contains(lower(bias), 'right') THEN 'right' WHEN contains(lower(bias), 'cent') OR contains(lower(bias), 'middle') THEN 'center' END AS lean FROM src"))
def bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.sources(spark, sf_dir).select("source_id", balance.normalise_bias(F.col("bias")).alias("lean"))


QUANTITY = r"""
WITH t AS (SELECT doc_id, text, lower(text) AS low FROM documents),
a AS (SELECT doc_id, text, regexp_extract(low, '-?[0-9][0-9,]*(\.[0-9]*)?') AS n, low FROM t),
b AS (SELECT *, ltrim(substr(low, strpos(low, n) + length(n)), chr(9) || chr(10) || chr(12) || chr(13) || ' ') AS rest FROM a WHERE n <> ''),
c AS (SELECT *, regexp_extract(rest, '^[a-z]+') AS w FROM b),
f AS (SELECT *, CASE WHEN w IN ('k', 'thousand') THEN 1e3 WHEN w IN ('m', 'mn', 'million') THEN 1e6 WHEN w IN ('b', 'bn', 'billion') THEN 1e9 WHEN w = 'trillion' THEN 1e12 END AS scale FROM c),
u AS (SELECT *, CASE WHEN scale IS NULL THEN rest ELSE ltrim(substr(rest, length(w) + 1), chr(9) || chr(10) || chr(12) || chr(13) || ' ') END AS after FROM f)
SELECT doc_id, CAST(replace(n, ',', '') AS DOUBLE) * coalesce(scale, 1) AS amount, CASE WHEN contains(text, '%') THEN '%' ELSE nullif(regexp_extract(after, '^\S+'), '') END AS unit FROM u"""


@query("g02_quantity", QUANTITY)
def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", quantity.amount(F.col("text")).alias("amount"), quantity.unit(F.col("text")).alias("unit")).where("amount is not null")


TENTHS = "CAST(floor(o_totalprice / {by} * 10 + 0.5) AS BIGINT)"


def _shown(by: str, mark: str) -> str:
    t = TENTHS.format(by=by)
    return f"({t} // 10) || CASE WHEN {t} % 10 = 0 THEN '' ELSE '.' || ({t} % 10) END || '{mark}'"


@query("g04_humanise", f"SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN {_shown('1e6', 'M')} WHEN o_totalprice >= 1e3 THEN {_shown('1e3', 'K')} ELSE {_shown('1e0', '')} END AS shown FROM orders")
def humanise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.humanise(F.col("o_totalprice")).alias("shown"))


SLUGS = """
WITH RECURSIVE t AS (SELECT doc_id, source, TITLE AS title FROM documents),
d AS (SELECT doc_id, source, coalesce(nullif(rtrim(substr(array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+')[1:4], '-'), 1, 40), '-'), ''), 'drop') AS base, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM t),
walk(source, n, doc_id, slug, taken) AS (
  SELECT source, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT source FROM d)
  UNION ALL
  SELECT source, n, doc_id, made, list_append(taken, made) FROM (
    SELECT d.source, d.n, d.doc_id, taken, CASE WHEN NOT list_contains(taken, base) THEN base ELSE base || '-' || list_filter(range(2, len(taken) + 3), lambda k: NOT list_contains(taken, base || '-' || k))[1] END AS made
    FROM walk JOIN d ON d.source = walk.source AND d.n = walk.n + 1)
)
SELECT doc_id, slug FROM walk WHERE n > 0""".replace(
    "TITLE", "CASE WHEN doc_id % 3 = 0 THEN 'Top story' WHEN doc_id % 11 = 1 THEN 'top story 2' WHEN doc_id % 13 = 2 THEN 'Top story 2 2' WHEN doc_id % 5 = 3 THEN 'top story ' || (doc_id % 10) ELSE split_part(text, chr(10), 1) END"
)


@query("g05_slugs", SLUGS)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of titles of which many are alike and some end in a number that others need. The SQL goes document by document."""
    i = F.col("doc_id")
    title = F.when(i % 3 == 0, "Top story").when(i % 11 == 1, "top story 2").when(i % 13 == 2, "Top story 2 2").when(i % 5 == 3, F.concat(F.lit("top story "), (i % 10).cast("string"))).otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", text.slug(title).alias("slug"))
    return free_slugs(rows, "source", "doc_id").select("doc_id", "slug")


@query(
    "g06_labels",
    r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS t FROM documents),
c AS (SELECT doc_id, CASE WHEN length(t) <= 48 THEN t WHEN contains(substr(t, 1, 48), ' ') THEN regexp_replace(substr(t, 1, 48), ' [^ ]*$', '') ELSE substr(t, 1, 48) END AS t FROM f)
SELECT doc_id, coalesce(nullif(regexp_replace(t, '[ ,.;:\-]+$', ''), ''), 'story') AS label FROM c""",
)
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_label(F.split_part("text", F.lit("\n"), F.lit(1))).alias("label"))


@query(
    "g09_material_moves",
    "WITH p AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM events) SELECT event_id FROM p WHERE old IS NOT NULL AND (abs(value - old) >= 40 OR (old <> 0 AND abs(value - old) / abs(old) >= 0.5))",
)
def material_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.lag("value").over(w).alias("old")).where("old is not null")
    return rows.where(quantity.material(F.col("old"), F.col("value"), 0.5, 40)).select("event_id")


@query("g12_week_key", "SELECT event_id, CAST(date_trunc('week', ts + INTERVAL '9' HOUR - INTERVAL '6' HOUR) AS DATE) AS week FROM events")
def week_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", quantity.week_key(F.col("ts").cast("timestamp"), "Asia/Tokyo").alias("week"))


@query("g13_day_start", "SELECT event_id, epoch_us(date_trunc('day', ts + INTERVAL '9' HOUR) - INTERVAL '9' HOUR) // 1000000 AS day_start FROM events")
def day_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(quantity.day_start(F.col("ts").cast("timestamp"), "Asia/Tokyo")).alias("day_start"))


@query(
    "g17_chat_budgets",
    """
WITH c AS (SELECT c_custkey AS chat, CASE c_custkey % 5 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' WHEN 2 THEN 'long' WHEN 3 THEN 'endless' END AS length, CASE c_nationkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'L' WHEN 2 THEN 'XL' END AS surface FROM customer),
n AS (SELECT o_custkey AS chat, count(*) AS themes, count(*) FILTER (o_orderstatus = 'F') AS highlights FROM orders GROUP BY 1),
l AS (SELECT chat, coalesce(themes, 0) AS themes, coalesce(highlights, 0) AS highlights, CASE length WHEN 'short' THEN 'S' WHEN 'medium' THEN 'M' WHEN 'long' THEN 'L' ELSE CASE WHEN surface IN ('S', 'L') THEN surface ELSE 'M' END END AS level FROM c LEFT JOIN n USING (chat))
SELECT chat, level, CAST((CASE level WHEN 'S' THEN 800 WHEN 'L' THEN 3200 ELSE 1600 END + 500) * themes + 250 * highlights AS BIGINT) AS cap FROM l""",
)
def chat_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as chats with a length or none, their orders as themes."""
    c = table(spark, sf_dir, "customer")
    length = F.element_at(F.array(*[F.lit(x) for x in ("short", "medium", "long", "endless", None)]), (F.col("c_custkey") % 5 + 1).cast("int"))
    surface = F.element_at(F.array(*[F.lit(x) for x in ("S", "L", "XL", None)]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("chat")).agg(F.count("*").alias("themes"), F.count_if(F.col("o_orderstatus") == "F").alias("highlights"))
    rows = c.select(F.col("c_custkey").alias("chat"), briefs.size_level(length, surface).alias("level")).join(n, "chat", "left")
    themes, highlights = (F.coalesce(x, F.lit(0)) for x in ("themes", "highlights"))
    return rows.select("chat", "level", briefs.char_cap(briefs.theme_target(F.col("level")), themes, highlights, per_source=500).cast("long").alias("cap"))


@query(
    "g17_char_budget",
    with_models(", b AS (SELECT source_id, count(*) AS themes, count(*) FILTER (relevance >= 5) AS highlights FROM art GROUP BY 1) SELECT source_id, (1600 + 500) * themes + 250 * highlights AS cap, least(12000, greatest(2000, ((1600 + 500) * themes + 250 * highlights) // 3 + 500)) AS tokens FROM b"),
)
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = models.articles(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("themes"), F.count_if(F.col("relevance") >= 5).alias("highlights"))
    cap = briefs.char_cap(briefs.theme_target(F.lit("M")), F.col("themes"), F.col("highlights"), per_source=500)
    return b.select("source_id", cap.alias("cap"), F.least(F.lit(12000), F.greatest(F.lit(2000), F.floor(cap / 3) + 500)).alias("tokens"))


@query(
    "g18_script_ratio",
    r"SELECT doc_id, round(CASE WHEN len(regexp_extract_all(text, '\p{L}')) > 0 THEN len(regexp_extract_all(text, '[\x{00C0}-\x{00FF}]')) / len(regexp_extract_all(text, '\p{L}')) ELSE 0 END, 9) AS ratio FROM documents",
)
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.script_ratio(F.col("text"), "[\\x{00C0}-\\x{00FF}]"), 9).alias("ratio"))


@query(
    "g18_translated",
    r"""
WITH c AS (SELECT conv_id, turn, text AS t, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations),
n AS (SELECT conv_id, turn, length(regexp_replace(coalesce(t, ''), '^\s+|\s+$', '', 'g')) AS chars, source, len(regexp_extract_all(t, '\p{L}')) AS letters, len(regexp_extract_all(t, '[äöüßéèêç]')) AS own FROM c WHERE source IS NOT NULL)
SELECT conv_id, turn, chars >= 0.25 * greatest(source, 1) AS long_enough, chars >= 0.25 * greatest(source, 1) AND letters > 0 AND CAST(own AS DOUBLE) / letters >= 0.2 AS translated FROM n""",
)
def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as translations of the turn before, accented letters as the script."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("source", F.lag(F.length("text")).over(w)).where("source is not null")
    both = [text.in_script(F.col("text"), F.col("source"), ranges).alias(n) for n, ranges in (("long_enough", None), ("translated", "[äöüßéèêç]"))]
    return rows.select("conv_id", "turn", *both)


@query(
    "g20_contacts",
    r"""
WITH x AS (SELECT doc_id, lower(text) AS low, regexp_replace(regexp_extract(text, '\+[0-9][0-9 ().-]{6,}[0-9]'), '[^0-9+]', '', 'g') AS p FROM documents)
SELECT doc_id, CASE WHEN length(p) >= 9 THEN p END AS phone, list_filter(['the', 'Schein', 'eaux', 'tion'], lambda w: contains(low, lower(w))) AS topics,
  list_filter(['short', 'ing', 'ung'], lambda w: contains(low, w))[1] AS length FROM x WHERE length(p) >= 9 OR doc_id % 4 = 0""",
)
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as free-text sign-ups: a phone number, the offered topics and the length that they name."""
    said = text.sign_up(F.col("text"), ["the", "Schein", "eaux", "tion"], ["short", "ing", "ung"]).alias("s")
    return table(spark, sf_dir, "documents").select("doc_id", said).where("s.phone is not null or doc_id % 4 = 0").select("doc_id", "s.*")


@query("g21_url_hash", "SELECT page_id, md5(url) AS hash FROM pages")
def url_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.col("url").cast("binary")).alias("hash"))


BRIEFS = """
WITH b AS (SELECT conv_id AS id, string_agg(CASE WHEN role = 'user' THEN '## ' || replace(substr(text, 1, 30), chr(10), ' ') || CASE WHEN conv_id % 5 = 0 THEN ' Highlights' ELSE '' END ELSE text || CASE WHEN turn % 4 = 1 THEN ' [s](https://example.com/' || turn || ')' ELSE '' END END, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1)"""


def _briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as briefs: a user's turn is a heading, an answer its body."""
    c = table(spark, sf_dir, "conversations")
    head = F.concat(F.lit("## "), F.translate(F.substring("text", 1, 30), "\n", " "), F.when(F.col("conv_id") % 5 == 0, " Highlights").otherwise(""))
    body = F.concat("text", F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" [s](https://example.com/"), F.col("turn").cast("string"), F.lit(")"))).otherwise(""))
    part = F.struct("turn", F.when(F.col("role") == "user", head).otherwise(body).alias("t"))
    return c.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n").alias("content"))


SECTIONS = BRIEFS + """,
p AS (SELECT id, unnest(string_split(chr(10) || content, chr(10) || '## ')[2:]) AS part, generate_subscripts(string_split(chr(10) || content, chr(10) || '## ')[2:], 1) AS position FROM b),
s AS (SELECT id, position, trim(split_part(part, chr(10), 1)) AS heading, CASE WHEN contains(part, chr(10)) THEN substr(part, strpos(part, chr(10)) + 1) ELSE '' END AS body FROM p)"""


@query("k01_sections", SECTIONS + " SELECT id, CAST(position AS INTEGER) AS position, heading, md5(body) AS body_md5, NOT contains(lower(heading), 'highlights') AND NOT contains(lower(heading), 'investigations') AS is_theme FROM s")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = briefs.sections(_briefs(spark, sf_dir), "id", "content")
    return out.select("id", "position", "heading", F.md5(F.col("body").cast("binary")).alias("body_md5"), "is_theme")


FAULTS = (
    SECTIONS
    + """, t AS (SELECT *, NOT contains(lower(heading), 'highlights') AND NOT contains(lower(heading), 'investigations') AS theme FROM s), n AS (SELECT id, count(*) FILTER (theme) AS themes FROM t GROUP BY 1), o AS (SELECT b.*, coalesce(themes, 0) AS themes FROM b LEFT JOIN n USING (id) WHERE trim(content) <> '')
SELECT id, 'no_themes' AS rule, 'critical' AS severity, NULL AS subject FROM o WHERE themes = 0
UNION ALL SELECT id, 'few_themes', 'minor', NULL FROM o WHERE themes BETWEEN 1 AND 2
UNION ALL SELECT id, 'no_citations', 'critical', NULL FROM o WHERE NOT contains(content, '](')
UNION ALL SELECT id, 'char_overrun', 'important', NULL FROM o WHERE length(content) > 3000 * 1.15
UNION ALL SELECT id, 'char_over_cap', 'minor', NULL FROM o WHERE length(content) > 3000 AND length(content) <= 3000 * 1.15
UNION ALL SELECT id, 'empty_section', 'important', heading FROM t WHERE trim(body) = ''
UNION ALL SELECT id, 'theme_no_citation', 'important', heading FROM t WHERE theme AND trim(body) <> '' AND NOT contains(body, '](')
UNION ALL SELECT id, 'empty_brief', 'critical', NULL FROM b WHERE trim(content) = ''"""
)


@query("k02_critic", FAULTS)
def critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefs.critic(_briefs(spark, sf_dir), "id", "content", 3000, overrun=1.15)


@query(
    "k02_gate",
    FAULTS.replace("SELECT id, 'no_themes'", ", every AS (SELECT id, 'no_themes'", 1)
    + """), w AS (SELECT id, count(*) AS faults, min(CASE severity WHEN 'critical' THEN 1 WHEN 'important' THEN 2 ELSE 3 END) AS r FROM every GROUP BY id)
SELECT id, coalesce(faults, 0) AS faults, CASE r WHEN 1 THEN 'critical' WHEN 2 THEN 'important' WHEN 3 THEN 'minor' END AS worst, coalesce(r <= 2, false) AS alert FROM b LEFT JOIN w USING (id)""",
)
def critic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before a brief is sent: its worst fault, and whether that is worth an alert."""
    rows = _briefs(spark, sf_dir)
    return briefs.gate(rows, briefs.critic(rows, "id", "content", 3000, overrun=1.15), "id")


@query("k06_bare_urls", BRIEFS + " SELECT id, CAST(len(regexp_extract_all(content || ' http://x https://y', 'https?://')) - len(regexp_extract_all(content, '\\]\\(https?://')) AS INTEGER) AS bare FROM b")
def bare_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _briefs(spark, sf_dir).select("id", F.concat("content", F.lit(" http://x https://y")).alias("content"))
    return rows.select("id", text.bare_urls(F.col("content")).alias("bare"))


@query("k08_over_cap", BRIEFS + " SELECT id, CASE WHEN length(content) > 2000 * 1.15 THEN length(content) - 2000 END AS over, round(length(content) * 100.0 / 2000, 2) AS percent FROM b")
def over_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("content").cast("long")
    return _briefs(spark, sf_dir).select("id", briefs.over_cap(n, 2000, 1.15).alias("over"), F.round(n * 100.0 / 2000, 2).alias("percent"))


#: Briefs with everything that a surface rewrites: bullets, bold, citations in both shapes, article lists.
CITING = """
WITH b AS (SELECT conv_id AS id, list(CASE turn % 7
    WHEN 0 THEN '## ' || replace(substr(text, 1, 30), chr(10), ' ') || '  '
    WHEN 1 THEN '*Articles:* ' || turn
    WHEN 2 THEN '  [' || turn || '] ' || split_part(replace(text, chr(10), ' '), ' ', 1) || ' said — [Paper ' || conv_id || '](https://example.com/' || turn || ') '
    WHEN 3 THEN '- **' || split_part(replace(text, chr(10), ' '), ' ', 1) || ' rose** – as seen [3] [Wire](http://example.com/w' || turn || ')'
    WHEN 4 THEN '* plain **bold** and [a link](https://x.y/z) here [12]'
    WHEN 5 THEN '[' || turn || '] listed — no link'
    ELSE '' END ORDER BY turn) AS lines FROM conversations GROUP BY 1),
l AS (SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM b)"""


def _citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turn, first = F.col("turn").cast("string"), F.split_part(F.translate("text", "\n", " "), F.lit(" "), F.lit(1))
    line = (
        F.when(F.col("turn") % 7 == 0, F.concat(F.lit("## "), F.translate(F.substring("text", 1, 30), "\n", " "), F.lit("  ")))
        .when(F.col("turn") % 7 == 1, F.concat(F.lit("*Articles:* "), turn))
        .when(F.col("turn") % 7 == 2, F.concat(F.lit("  ["), turn, F.lit("] "), first, F.lit(" said — [Paper "), F.col("conv_id").cast("string"), F.lit("](https://example.com/"), turn, F.lit(") ")))
        .when(F.col("turn") % 7 == 3, F.concat(F.lit("- **"), first, F.lit(" rose** – as seen [3] [Wire](http://example.com/w"), turn, F.lit(")")))
        .when(F.col("turn") % 7 == 4, F.lit("* plain **bold** and [a link](https://x.y/z) here [12]"))
        .when(F.col("turn") % 7 == 5, F.concat(F.lit("["), turn, F.lit("] listed — no link")))
        .otherwise("")
    )
    return c.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))), lambda x: x["t"]), "\n").alias("content"))


@query(
    "k09_citations",
    CITING
    + r""",
p AS (SELECT id, pos, line, split_part(line, '](', 2) AS link, pos % 7 AS kind FROM l),
o AS (SELECT id, pos, CASE kind
    WHEN 3 THEN '  ' || (pos - 1) || '. ' || split_part(split_part(line, '] ', 2), ' —', 1) || ' — Paper ' || id || ' https://example.com/' || (pos - 1)
    WHEN 4 THEN split_part(line, ' –', 1) || ' — as seen [3] Wire http://example.com/w' || (pos - 1)
    WHEN 1 THEN '**' || trim(substr(line, 4)) || '**' ELSE line END AS plain,
  CASE kind WHEN 3 THEN '  ' || split_part(split_part(line, '] ', 2), ' —', 1) || ' — Paper ' || id WHEN 4 THEN split_part(line, ' –', 1) || ' — as seen [3] Wire' ELSE line END AS bare FROM p)
SELECT id, string_agg(plain, chr(10) ORDER BY pos) AS plain, string_agg(bare, chr(10) ORDER BY pos) AS bare FROM o GROUP BY id""",
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _citing(spark, sf_dir)
    return rows.select("id", briefs.headings_to_bold(briefs.cited(F.col("content"), "plain")).alias("plain"), briefs.cited(F.col("content"), "none", numbers=False).alias("bare"))


@query(
    "k10_plain_chat",
    CITING
    + r""",
o AS (SELECT id, pos, CASE pos % 7
    WHEN 1 THEN '*' || trim(substr(line, 4)) || '*' WHEN 3 THEN split_part(line, '— [', 1) || '— Paper ' || id || ' '
    WHEN 4 THEN '• ' || replace(substr(split_part(line, ' [Wire', 1), 3), '**', '*') || ' Wire'
    WHEN 5 THEN '• plain *bold* and a link here [12]' ELSE line END AS chat FROM l)
SELECT id, string_agg(chat, chr(10) ORDER BY pos) AS chat FROM o GROUP BY id""",
)
def plain_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _citing(spark, sf_dir).select("id", briefs.plain_chat(F.col("content")).alias("chat"))


@query(
    "k10_without_sources",
    CITING
    + r""",
m AS (SELECT *, pos % 7 = 2 AS head, regexp_matches(trim(line), '^\[[0-9]+\]') AS entry FROM l),
g AS (SELECT *, (SELECT max(x.pos) FROM m x WHERE x.id = m.id AND x.pos < m.pos AND NOT x.entry) AS before FROM m),
k AS (SELECT id, pos, line FROM g WHERE NOT head AND NOT (entry AND before IS NOT NULL AND before % 7 = 2)),
o AS (SELECT b.id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS t FROM b LEFT JOIN k USING (id) GROUP BY b.id)
SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s*\[[0-9]+\]', '', 'g'), '\s*\[[^\]]+\]\(https?://[^)]+\)', '', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM o""",
)
def without_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a second language: the article lists go by a running flag over the lines."""
    return briefs.without_sources(_citing(spark, sf_dir), "id", "content")


@query(
    "k13_placed",
    CITING
    + r""",
c AS (SELECT id, string_agg(CASE WHEN pos % 7 = 6 AND id % 3 > 0 THEN '---' WHEN pos % 7 = 0 AND id % 4 = 1 THEN '## Highlights' ELSE line END, chr(10) ORDER BY pos) AS t FROM l GROUP BY id),
p AS (SELECT *, string_split(t, chr(10) || '---' || chr(10)) AS x, string_split(t, '## Highlights') AS y, string_split(chr(10) || t || chr(10), chr(10) || '---' || chr(10)) AS z FROM c)
SELECT id, CASE WHEN len(x) > 1 THEN array_to_string(x[:-2], chr(10) || '---' || chr(10)) || chr(10) || chr(10) || 'NEW ' || id || chr(10) || chr(10) || '---' || chr(10) || x[-1] ELSE regexp_replace(t, '\s+$', '') || chr(10) || chr(10) || 'NEW ' || id || chr(10) END AS footer,
  CASE WHEN len(y) > 1 THEN y[1] || 'NEW ' || id || chr(10) || chr(10) || substr(t, length(y[1]) + 1)
    WHEN len(z) > 1 THEN substr(t, 1, length(z[1])) || 'NEW ' || id || chr(10) || chr(10) || substr(t, length(z[1]) + 1) ELSE regexp_replace(t, '\s+$', '') || chr(10) || chr(10) || 'NEW ' || id END AS highlights FROM p""",
)
def placed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section put into briefs with and without footer rules and highlights."""
    c = _citing(spark, sf_dir).select("id", F.split("content", "\n").alias("lines"))
    line = F.transform("lines", lambda x, i: F.when(((i + 1) % 7 == 6) & (F.col("id") % 3 > 0), F.lit("---")).when(((i + 1) % 7 == 0) & (F.col("id") % 4 == 1), F.lit("## Highlights")).otherwise(x))
    rows = c.select("id", F.array_join(line, "\n").alias("t"), F.concat(F.lit("NEW "), F.col("id").cast("string")).alias("s"))
    return rows.select("id", briefs.placed_section(F.col("t"), F.col("s")).alias("footer"), briefs.placed_section(F.col("t"), F.col("s"), above_highlights=True).alias("highlights"))


CHUNKS = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '(?m)^', '## ', 'g') AS t FROM documents WHERE text IS NOT NULL AND text <> ''),
p AS (SELECT doc_id, t, length(t) AS size, list_transform(string_split(substr(t, 4), chr(10) || '## '), lambda x, i: length(x) + 4 - CAST(i = len(string_split(substr(t, 4), chr(10) || '## ')) AS INTEGER)) AS parts FROM d),
r(doc_id, i, chunk, held, piece, pieces) AS (
  SELECT doc_id, 0, -1, CAST(2000 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM p
  UNION ALL SELECT r.doc_id, r.i + 1,
    CASE WHEN n > 1500 THEN r.chunk + CAST(ceil(n / 1500.0) AS INTEGER) WHEN r.held + n <= 1500 THEN r.chunk ELSE r.chunk + 1 END,
    CASE WHEN n > 1500 THEN 2000 WHEN r.held + n <= 1500 THEN r.held + n ELSE n END, n, CAST(CASE WHEN n > 1500 THEN ceil(n / 1500.0) ELSE 1 END AS BIGINT)
  FROM r JOIN (SELECT doc_id, unnest(parts) AS n, generate_subscripts(parts, 1) AS at FROM p WHERE size > 1500) x ON x.doc_id = r.doc_id AND x.at = r.i + 1),
o AS (SELECT doc_id, unnest(range(chunk - CAST(pieces AS INTEGER) + 1, chunk + 1)) AS chunk, unnest(list_transform(range(1, CAST(pieces AS INTEGER) + 1), lambda k: CASE WHEN pieces = 1 THEN piece WHEN k < pieces THEN 1500 ELSE piece - 1500 * (pieces - 1) END)) AS chars FROM r WHERE i > 0)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(sum(chars) AS INTEGER) AS chars FROM o GROUP BY 1, 2
UNION ALL SELECT doc_id, 0, CAST(size AS INTEGER) FROM p WHERE size <= 1500"""


@query("k11_chunks", CHUNKS)
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose every line heads a section."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.regexp_replace("text", "(?m)^", "## ").alias("t"))
    rows = d.select("doc_id", F.posexplode(briefs.chunk_sections(F.col("t"), 1500)).alias("chunk", "part"))
    return rows.select("doc_id", "chunk", F.length("part").alias("chars"))


@query("k15_key_shapes", r"SELECT doc_id FROM documents WHERE regexp_matches(text, 'AKIA[A-Z0-9]{16}|(?i:api_?key|token|password)\s*[:=]\s*\S{12,}')")
def key_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"AKIA[A-Z0-9]{16}|(?i:api_?key|token|password)\s*[:=]\s*\S{12,}")).select("doc_id")
