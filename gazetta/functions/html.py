"""Links in HTML and Markdown, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANCHOR = r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
LINK = r"\[([^\]]*)\]\((https?://[^)\s]+)\)"


def html_links(pages: DataFrame, id_col: str, html_col: str, least_title: int = 20, http_only: bool = True, tag: str = "") -> DataFrame:
    """(id, position, url, title) of each anchor with a long enough text, in page order. ``tag`` stands for each tag within an anchor."""
    pairs = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(ANCHOR), F.lit(1)).alias("url"), F.regexp_extract_all(html_col, F.lit(ANCHOR), F.lit(2)).alias("title"))
    rows = pages.select(id_col, F.posexplode(pairs).alias("position", "x")).select(id_col, "position", F.col("x.url").alias("url"), F.trim(F.regexp_replace("x.title", "<[^>]*>", tag)).alias("title"))
    rows = rows.where(F.length("title") > least_title)
    return rows.where(F.startswith("url", F.lit("http"))) if http_only else rows


def markdown_links(pages: DataFrame, id_col: str, text_col: str, least_title: int = 20, most: int = 60) -> DataFrame:
    """(id, rank, url, title): images count by their alt text, the first link of each address, up to ``most``."""
    text = F.regexp_replace(text_col, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("title"), F.regexp_extract_all(text, F.lit(LINK), F.lit(2)).alias("url"))
    rows = pages.select(id_col, F.posexplode(pairs).alias("position", "x"))
    title = F.trim(F.regexp_replace(F.replace(F.col("x.title"), F.lit("\\"), F.lit(" ")), r"\s+", " "))
    rows = rows.select(id_col, "position", F.col("x.url").alias("url"), title.alias("title")).where(F.length("title") > least_title)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(id_col, "url").orderBy("position"))).where("n = 1")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("position"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select(id_col, "rank", "url", "title")


def listing_rows(links: DataFrame, id_col: str, most: int, paid: Column) -> DataFrame:
    """Links as article rows: the cap comes before the filter on paid content, so a page may yield fewer."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("position"))
    return links.withColumn("rank", rank).where((F.col("rank") <= most) & ~paid)


def is_listing(has_feed: Column, feed_url: Column) -> Column:
    """True for a source without a usable feed: no feed, or a feed without an address."""
    return ~F.coalesce(has_feed & (F.trim(feed_url) != ""), F.lit(False))


def listing_links(pages: DataFrame, id_col: str, markdown_col: str, html_col: str, least_title: int = 20, http_only: bool = True) -> DataFrame:
    """(id, via, rank, url, title) of listing pages.

    A page that came as Markdown gives the links in it, if only none; one whose
    Markdown is null gives its anchors.
    """
    came = F.col(markdown_col).isNotNull()
    md = markdown_links(pages.where(came), id_col, markdown_col, least_title).select(id_col, F.lit("markdown").alias("via"), "rank", "url", "title")
    anchors = html_links(pages.where(~came), id_col, html_col, least_title, http_only)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("position"))
    return md.unionByName(anchors.select(id_col, F.lit("html").alias("via"), rank.alias("rank"), "url", "title"))
