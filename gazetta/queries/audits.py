"""Audits over texts that orders, parts and suppliers are written as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.functions import money
from gazetta.queries.registry import query
from gazetta.session import table


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per order: its lines' amounts in three units, a sum in one of four wordings that the priority may spoil, a source."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").cast("long").alias("n"), "l_returnflag")
    said = F.concat(F.lit("$"), F.col("n").cast("string"), F.when(F.col("l_returnflag") == "A", " thousand").when(F.col("l_returnflag") == "R", "M").otherwise(" billion"))
    g = li.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("n")).when(F.col("l_returnflag") == "R", F.col("n") * 1000).otherwise(F.col("n") * 1000000)).alias("k"), F.array_sort(F.collect_list(F.struct("l_linenumber", said.alias("s")))).alias("x"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    rows = g.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    word = F.element_at(F.array(*[F.lit(x) for x in ("Totaling", "Combined, they are", "Altogether that makes", "In sum")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    stated = F.col("k") * F.when(F.substring("o_orderpriority", 1, 1) == "1", 2).otherwise(1)
    host = F.element_at(F.array(*[F.lit(x) for x in ("news.jp/", "news.com/doyen-", "news.com/yen-", "news.com/5_円/", "news.com/")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    lines = F.array_join(F.transform("x", lambda y: y["s"]), " and ")
    end = F.when(F.col("o_orderstatus") == "F", " no figure").otherwise(F.concat(F.lit(" $"), stated.cast("string"), F.lit("k")))
    return rows.select(F.col("l_orderkey").alias("id"), F.concat(word, end, F.lit(". Parts: "), lines, F.lit(" [s](https://"), host, F.col("l_orderkey").cast("string"), F.lit(")")).alias("text"))


#: The same texts for DuckDB; the oracles below read them with patterns of their own.
TEXTS = """
WITH p AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS n, l_returnflag AS f, '$' || CAST(floor(l_extendedprice) AS BIGINT) || CASE l_returnflag WHEN 'A' THEN ' thousand' WHEN 'R' THEN 'M' ELSE ' billion' END AS said FROM lineitem),
g AS (SELECT l_orderkey, CAST(sum(n * CASE f WHEN 'A' THEN 1 WHEN 'R' THEN 1000 ELSE 1000000 END) AS BIGINT) AS k, string_agg(said, ' and ' ORDER BY l_linenumber, said) AS lines FROM p GROUP BY 1),
b AS (SELECT l_orderkey AS id, ['Totaling', 'Combined, they are', 'Altogether that makes', 'In sum'][o_custkey % 4 + 1] || CASE WHEN o_orderstatus = 'F' THEN ' no figure' ELSE ' $' || (k * CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END) || 'k' END
  || '. Parts: ' || lines || ' [s](https://' || ['news.jp/', 'news.com/doyen-', 'news.com/yen-', 'news.com/5_円/', 'news.com/'][o_custkey % 5 + 1] || l_orderkey || ')' AS text FROM g JOIN orders ON o_orderkey = l_orderkey)"""
#: Every amount of a text in millions, and its stated total: the first amount within 30 characters other than digits after such a word.
MONEY = (
    TEXTS
    + r""",
m AS (SELECT id, text, list_transform(list_zip(regexp_extract_all(text, '\$([0-9]+) ?(thousand|billion|M|k)', 1), regexp_extract_all(text, '\$([0-9]+) ?(thousand|billion|M|k)', 2)), lambda x: CAST(x[1] AS DOUBLE) * CASE x[2] WHEN 'thousand' THEN 0.001 WHEN 'k' THEN 0.001 WHEN 'M' THEN 1 ELSE 1000 END) AS every,
  regexp_extract(lower(text), '(total|combined|altogether|collectively)[^0-9]{0,35}?\$([0-9]+) ?(thousand|billion|m|k)', 2) AS n, regexp_extract(lower(text), '(total|combined|altogether|collectively)[^0-9]{0,35}?\$([0-9]+) ?(thousand|billion|m|k)', 3) AS u FROM b),
t AS (SELECT *, CASE WHEN n <> '' THEN CAST(n AS DOUBLE) * CASE u WHEN 'thousand' THEN 0.001 WHEN 'k' THEN 0.001 WHEN 'm' THEN 1 ELSE 1000 END END AS total FROM m)"""
)


@query("g03_money", MONEY + " SELECT id, CAST(len(every) AS INTEGER) AS amounts, round(total, 3) AS total FROM t")
def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("id", F.size(money.amounts(F.col("text"))).alias("amounts"), F.round(money.stated_total(F.col("text")), 3).alias("total"))


@query("k03_total_mismatch", MONEY + " SELECT id FROM t WHERE total > 0 AND len(every) > 1 AND list_sum(every) - total > 0 AND abs(list_sum(every) - 2 * total) / total > 0.05")
def total_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).where(money.total_mismatch(F.col("text"))).select("id")


@query("k04_currency_mismatch", TEXTS + r" SELECT id FROM b WHERE contains(text, '$') AND regexp_matches(regexp_extract(text, '\((https?://[^)\s]+)\)', 1), '(?i)(^|[^\p{L}\p{N}])(yen|円)($|[^\p{L}\p{N}])')")
def currency_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).where(money.currency_mismatch(F.col("text"))).select("id")


@query(
    "e16_blindspots",
    """
WITH c AS (SELECT p_size AS page, p_partkey AS id, p_name, CAST(1 + p_partkey % 50 AS INTEGER) AS percent, CASE p_partkey % 3 WHEN 0 THEN 'Left' WHEN 1 THEN 'Right' ELSE 'Center' END AS side, CAST(p_partkey % 17 AS INTEGER) AS sources, p_partkey % 40 AS story FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 11 > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY page, story ORDER BY id) AS k FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS rank FROM f WHERE k = 1 AND sources >= 5)
SELECT page, CAST(rank AS INTEGER) AS rank, 'https://news.example/story/' || story AS url, side, percent, sources, p_name AS headline FROM r WHERE rank <= 3""",
)
def blindspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a size are written as a page of coverage cards; some anchors lead elsewhere, some have another shape."""
    p = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    side = F.when(F.col("id") % 3 == 0, "Left").when(F.col("id") % 3 == 1, "RIGHT").otherwise("center")
    way = F.when(F.col("id") % 7 == 0, "/topic/").otherwise("/story/")
    mark = F.when(F.col("id") % 11 == 0, "Coverage: ").otherwise("Blindspot: Only ")
    tail = F.when(F.col("id") % 2 == 0, " Left 13 % Center 12 % Right 75 %").when(F.col("id") % 3 == 0, " 4 hours ago Show more").otherwise("")
    a = F.concat(F.lit('<a class="x" href="'), way, (F.col("id") % 40).cast("string"), F.lit('"><b>'), mark, F.lit("</b>"), (1 + F.col("id") % 50).cast("string"), F.lit("% "), side, F.lit(" <i>"), (F.col("id") % 17).cast("string"), F.lit("</i>sources "), "p_name", tail, F.lit("</a>"))
    pages = p.groupBy(F.col("p_size").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", a.alias("a")))), lambda x: x["a"]), "\n").alias("html"))
    return money.coverage_cards(pages, "page", "html", least_sources=5, most=3, base="https://news.example")
