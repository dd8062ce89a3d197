"""Landed feed entries, RSS items or Atom entries, one a row, to article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.functions.text import contains_any
from gazetta.operators.filters import PAID
from gazetta.operators.windows import newest_per_source

#: An item of RSS, and an entry of Atom, whose links are attributes. Names without their prefixes: ``date`` is dc:date, ``encoded`` content:encoded.
ITEM = "title string, link string, guid string, pubDate string, date string, description string, summary string, encoded string"
ENTRY = "title string, link array<struct<_href: string, _rel: string>>, published string, updated string, summary string, content string"
#: Zone names of mail dates.
ZONES = {"UT": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


#: Day, month, year, hours and minutes, seconds, zone of a mail date; weekday, seconds and zone may be absent.
MAIL = r"^(?:[A-Za-z]+, *)?(\d{1,2}) ([A-Za-z]{3}) (\d{2}|\d{4}) (\d{2}:\d{2})(:\d{2})? *([+-]\d{4}|[A-Za-z]{1,3})?$"


def feed_date(text: Column) -> Column:
    """The time of a mail date (``Wed, 03 May 2023 21:00:00 GMT``) or an ISO date; null where it is neither.

    A date without a zone is in UTC. A year of two digits is one of this century.
    """
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    day, month, year, minute, second, zone = (F.regexp_extract(flat, MAIL, i) for i in range(1, 7))
    offset = F.coalesce(F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.lit(v))])[F.upper(zone)], F.when(zone == "", "+0000").otherwise(zone))
    mail = F.concat(day, F.lit(" "), month, F.lit(" "), F.right(F.concat(F.lit("20"), year), F.lit(4)), F.lit(" "), minute, F.when(second == "", ":00").otherwise(second), F.lit(" "), offset)
    return F.when(F.rlike(flat, F.lit(MAIL)), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))).when(F.rlike(flat, F.lit(r"^\d{4}-")), F.try_to_timestamp(flat))


def escape(text: Column) -> Column:
    """Text as XML character data."""
    out = text
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(ref))
    return out


def entries(items: DataFrame, xml: str, source: str, now: Column, hours: int, cap: int, body_chars: int = 5000, keep: list[str] | None = None) -> DataFrame:
    """Entries with title and link, no paid content, dated from the cut-off on or undated; the newest ``cap`` of each source.

    Undated entries count as new. The filter on paid content comes before the cap.
    """
    # Tags lose their prefixes first, which a reader of single elements can't resolve.
    plain = F.regexp_replace(F.col(xml), r"(</?)[A-Za-z0-9]+:", "$1")
    atom = F.startswith(F.ltrim(plain), F.lit("<entry"))
    rss, entry = F.from_xml(F.when(~atom, plain), ITEM, {"rowTag": "item"}), F.from_xml(F.when(atom, plain), ENTRY, {"rowTag": "entry"})
    # Through an array of one, so that filters below don't read the XML again for each of their terms.
    rows = items.select(source, *(keep or []), F.inline(F.array(F.struct(rss.alias("x"), entry.alias("y")))))
    # Of several links the one to the page itself.
    links = F.filter("y.link", lambda k: k["_rel"].isNull() | (k["_rel"] == "alternate"))
    url = F.coalesce("x.link", F.try_element_at(links, F.lit(1))["_href"])
    said = F.coalesce("x.pubDate", "x.date", "y.published", "y.updated")
    body = F.coalesce("x.summary", "x.description", "x.encoded", "y.summary", "y.content", F.lit(""))
    read = F.struct(F.trim(F.coalesce("x.title", "y.title")).alias("title"), F.trim(url).alias("url"), said.alias("said"), F.substring(body, 1, body_chars).alias("body"))
    rows = rows.select(source, *(keep or []), F.inline(F.array(read)))
    rows = rows.withColumn("dated", feed_date(F.col("said"))).drop("said")
    rows = rows.where((F.length("title") > 0) & (F.length("url") > 0) & ~contains_any(F.col("title"), PAID))
    rows = rows.where(F.col("dated").isNull() | (F.col("dated") >= now - F.expr(f"interval {hours} hours")))
    rows = rows.withColumn("published_at", F.coalesce("dated", now)).drop("dated")
    return newest_per_source(rows, cap, source, "published_at", "url")
