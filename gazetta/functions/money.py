"""Amounts of money in a section of text, and coverage cards on a page. Texts are cut at their marks and read part by part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions.html import html_links
from gazetta.functions.text import SIDES, clean_headline
from gazetta.session import once

#: Units of money in millions, words that announce a total, and marks of the yen in an address.
UNITS = {"thousand": 1e-3, "k": 1e-3, "million": 1.0, "mn": 1.0, "m": 1.0, "billion": 1e3, "bn": 1e3, "b": 1e3}
TOTALS = ["totaling", "totaled", "totals", "total", "combined", "altogether", "collectively"]
YEN = ["yen", "円"]
#: A total's amount follows its word within so many characters, none of them a digit.
NEAR = 30


def _after_dollar(text: Column) -> Column:
    """(before, after) of every dollar sign: the text up to it from the one before, and from it up to the next."""
    parts = F.split(text, r"\$")
    n = F.size(parts) - 1
    return F.arrays_zip(F.slice(parts, 1, F.greatest(n, F.lit(0))).alias("before"), F.slice(parts, 2, F.greatest(n, F.lit(0))).alias("after"))


def _millions(after: Column) -> Column:
    """The amount that a text begins with, if a known unit follows it as a word."""
    number = F.regexp_extract(after, r"^\s?(\d[\d,]*(\.\d+)?)", 1)
    word = F.lower(F.regexp_extract(after, r"^\s?\d[\d,]*(?:\.\d+)?\s*([\p{L}\p{N}_]+)", 1))
    factor = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))])[word]
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double") * factor


def amounts(text: Column) -> Column:
    """All amounts in millions; amounts without a unit are left out."""
    return F.filter(F.transform(_after_dollar(text), lambda p: _millions(p["after"])), lambda x: x.isNotNull())


def stated_total(text: Column) -> Column:
    """The amount that a text first calls its total; null without one, or where it has no unit."""
    announced = "(?i)(" + "|".join(TOTALS) + rf")[^0-9]{{0,{NEAR}}}$"
    found = F.filter(_after_dollar(text), lambda p: p["before"].rlike(announced) & p["after"].rlike(r"^\s?\d"))
    first = lambda f: F.when(F.size(f) > 0, _millions(F.try_element_at(f, F.lit(1))["after"]))
    return F.transform(F.array(found), first)[0]


def total_mismatch(text: Column, share: float = 0.05) -> Column:
    """The stated total is more than ``share`` off the sum of the section's other amounts, of which there is one at least."""

    def off(x: Column) -> Column:
        total, others = x["total"], x["sum"] - x["total"]  # the total itself is one of the amounts
        return F.coalesce((total > 0) & (x["n"] > 1) & (others > 0) & (F.abs(others - total) / total > share), F.lit(False))

    # Through arrays of one, so that the text is read once for the total and once for the amounts.
    summed = lambda e: F.struct(stated_total(text).alias("total"), F.size(e).alias("n"), F.aggregate(e, F.lit(0.0), lambda s, x: s + x).alias("sum"))
    return F.transform(F.transform(F.array(amounts(text)), summed), off)[0]


def currency_mismatch(text: Column) -> Column:
    """Dollar amounts in a section that cites, in round brackets, an address with a mark of the yen as one of its words."""
    bracketed = F.filter(F.split(text, r"\("), lambda x: F.contains(x, F.lit(")")) & (F.startswith(x, F.lit("http://")) | F.startswith(x, F.lit("https://"))))
    addresses = F.filter(F.transform(bracketed, lambda x: F.split_part(x, F.lit(")"), F.lit(1))), lambda u: ~u.rlike(r"\s"))
    words = F.flatten(F.transform(addresses, lambda u: F.split(F.lower(u), r"[^\p{L}\p{N}]+")))
    dollars = F.exists(_after_dollar(text), lambda p: p["after"].rlike(r"^\s?[\d,]"))
    return F.coalesce(dollars & F.arrays_overlap(words, F.array(*[F.lit(y) for y in YEN])), F.lit(False))


#: What a coverage card begins with, a word that may follow, its sides, and parts of the addresses that it leads to.
CARD, FILLER = "Blindspot:", "Only"
STORY = ["/article/", "/story/"]


def _cards(rows: DataFrame, mark: str) -> DataFrame:
    """``rows`` (title) with percent, side, sources, headline of a card's text, read word by word; without rows of another shape."""
    rows = once(rows, title=F.trim(F.regexp_replace("title", r"\s+", " ")))
    rows = once(rows, _at=F.instr(F.lower("title"), F.lit(mark.lower()))).where("_at > 0")
    rows = once(rows, _rest=F.trim(F.substr("title", F.col("_at") + len(mark))))
    spare = F.startswith(F.lower("_rest"), F.lit(FILLER.lower()))
    rows = once(rows, _rest=F.when(spare, F.trim(F.substr("_rest", F.lit(len(FILLER) + 1)))).otherwise(F.col("_rest")))
    rows = once(rows, _percent=F.split_part("_rest", F.lit("%"), F.lit(1)), _words=F.split(F.trim(F.substr("_rest", F.instr("_rest", "%") + 1)), " ")).where(F.contains("_rest", F.lit("%")))
    side, count, unit = (F.try_element_at("_words", F.lit(i)) for i in (1, 2, 3))
    rows = rows.where(F.col("_percent").rlike(r"^\d+$") & F.initcap(side).isin(SIDES) & count.rlike(r"^\d+$") & F.lower(unit).isin("source", "sources") & (F.size("_words") > 3))
    headline = clean_headline(F.array_join(F.slice("_words", 4, 100_000), " "))
    return once(rows, percent=F.col("_percent").try_cast("int"), side=F.initcap(side), sources=count.try_cast("int"), headline=headline).drop("_at", "_rest", "_percent", "_words")


def coverage_cards(pages: DataFrame, id_col: str, html_col: str, least_sources: int = 0, most: int = 1, base: str = "", mark: str = CARD, story: list[str] | None = None) -> DataFrame:
    """(id, rank, url, side, percent, sources, headline) of story anchors that state one-sided coverage, each address once.

    Anchors of another shape are left out. Relative addresses get ``base``.
    Stories with too few sources go before the cap, which is one at least.
    """
    leads = F.lit(False)
    for part in story or STORY:
        leads = leads | F.contains("url", F.lit(part))
    links = html_links(pages, id_col, html_col, 0, http_only=False, tag=" ").where(leads)
    url = F.when(F.startswith("url", F.lit("http")), F.col("url")).otherwise(F.concat(F.lit(base), "url"))
    rows = _cards(links, mark).select(id_col, "position", url.alias("url"), "percent", "side", "sources", "headline")
    first = F.row_number().over(Window.partitionBy(id_col, "url").orderBy("position"))
    rows = rows.where("headline <> ''").withColumn("n", first).where((F.col("n") == 1) & (F.col("sources") >= least_sources))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("position"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= max(1, most)).select(id_col, "rank", "url", "side", "percent", "sources", "headline")
