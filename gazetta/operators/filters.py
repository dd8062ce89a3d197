"""Filters and gates: all are column predicates or joins with small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.functions.text import contains_any
from gazetta.session import sized, stash

#: Words that mark paid content.
PAID = ["sponsored", "partner", "press release", "advertorial", "paid post"]


def freshness_window(hours: Column, default: int = 24, first_run: bool = False, first_hours: int = 48, cap: int | None = None) -> Column:
    """A source's window in hours: its own, else the default; a first run raises it, a cap lowers it."""
    out = F.coalesce(F.when(hours > 0, hours), F.lit(default))
    out = F.greatest(out, F.lit(first_hours)) if first_run else out
    return F.least(out, F.lit(cap)) if cap else out


def in_window(published: Column, now: Column, hours: Column) -> Column:
    return published >= now - F.make_dt_interval(F.lit(0), hours)


def scheduled(days: Column, now: Column, zone: str) -> Column:
    """Blank lets every day through; entries count by their first three letters."""
    today = F.lower(F.date_format(F.from_utc_timestamp(now, zone), "E"))
    listed = F.exists(F.split(days, ","), lambda d: F.lower(F.substring(F.trim(d), 1, 3)) == today)
    return (F.trim(F.coalesce(days, F.lit(""))) == "") | listed


def paid_content(title: Column, notes: Column) -> Column:
    """Only for sources whose notes ask for it."""
    return F.coalesce(F.contains(notes, F.lit("Avoid PR articles")), F.lit(False)) & contains_any(title, PAID)


def drop_junk(articles: DataFrame, patterns: DataFrame, url: str = "url", title: str = "title", least_url: int = 30, least_title: int = 15) -> DataFrame:
    """Without short, non-http or empty rows, and without rows that an active pattern matches.

    ``patterns`` (pattern, pattern_type, active) is a rule table of a few
    rows; it is broadcast, as nothing but a nested loop can test substrings.
    """
    sound = articles.where(F.col(url).isNotNull() & F.col(title).isNotNull() & F.startswith(url, F.lit("http")) & (F.length(url) >= least_url) & (F.length(title) >= least_title))
    rules = patterns.where("active").select(F.lower("pattern").alias("_p"), F.col("pattern_type").alias("_t"))
    u, t = F.lower(F.col(url)), F.lower(F.col(title))
    hit = ((F.col("_t") == "url_contains") & F.contains(u, F.col("_p"))) | ((F.col("_t") == "url_endswith") & F.endswith(u, F.col("_p"))) | ((F.col("_t") == "title_contains") & F.contains(t, F.col("_p")))
    return sound.join(sized(rules, 10_000), hit, "left_anti")


def junk_signature(articles: DataFrame, patterns: DataFrame, url: str = "url", title: str = "title") -> DataFrame:
    """Each row that a pattern (pattern, pattern_type, active, position) matches, with the first such pattern."""
    u, t = F.lower(F.col(url)), F.lower(F.col(title))
    rules = patterns.where("active").select("pattern", "pattern_type", "position")
    p = F.lower(F.col("pattern"))
    hit = ((F.col("pattern_type") == "url_contains") & F.contains(u, p)) | ((F.col("pattern_type") == "url_endswith") & F.endswith(u, p)) | ((F.col("pattern_type") == "title_contains") & F.contains(t, p))
    # Rows are numbered and written; only numbers and addresses are grouped, so equal rows stay apart.
    keyed = stash(articles.withColumn("_row", F.monotonically_increasing_id()))
    found = keyed.select("_row", url, title).join(sized(rules, 10_000), hit).groupBy("_row").agg(F.min_by("pattern", "position").alias("signature"))
    return keyed.join(found, "_row").drop("_row")


def topic_match(topics: Column, words: list[str]) -> Column:
    """Any word is a substring of the joined topics."""
    return contains_any(F.array_join(topics, " "), words)


def admitted(articles: DataFrame, rules: DataFrame, id_col: str = "id") -> DataFrame:
    """(chat, id): some category of the chat includes the article and does not exclude it.

    ``rules`` (chat, category, include, exclude) is a small configuration; an
    exclude of the category ``*`` holds for all categories of its chat.
    """
    text = F.lower(F.array_join("topics", " "))
    everywhere = rules.where("category = '*'").select("chat", F.col("exclude").alias("never"))
    own = rules.where("category <> '*'").join(everywhere, "chat", "left")
    none = F.array().cast("array<string>")
    hit = F.exists("include", lambda w: F.contains(text, w))
    out = F.exists(F.concat(F.coalesce("exclude", none), F.coalesce("never", none)), lambda w: F.contains(text, w))
    return articles.crossJoin(sized(own, 10_000)).where(hit & ~out).select("chat", id_col).distinct()


def cadence_window(articles: DataFrame, classes: DataFrame, now: Column, default: int = 24, published: str = "published_at") -> DataFrame:
    """Rows within the window of their category's class (category, window_hours); undated rows stay."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(published))) / 3.6e9
    found = articles.join(sized(classes.select("category", "window_hours")), "category", "left")
    return found.where(F.col(published).isNull() | (age <= F.coalesce("window_hours", F.lit(default)))).drop("window_hours")


def entry_gate(relevance: Column, actionability: Column, bar: int | Column) -> Column:
    """Relevance reaches the bar, or actionability is 2 or more; null counts as 0."""
    return (F.coalesce(relevance, F.lit(0)) >= bar) | (F.coalesce(actionability, F.lit(0)) >= 2)


def composite(relevance: Column, actionability: Column) -> Column:
    return F.coalesce(relevance, F.lit(0)) * 10 + F.coalesce(actionability, F.lit(0)) * 15
