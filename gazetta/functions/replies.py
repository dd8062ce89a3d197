"""Model replies: salvage of JSON text, and clean-up to a fixed shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that a score may have.
LABELS = ["IMMEDIATE", "KEEP_WARM", "NEW_SIGNAL", "NOISE"]
SCORE = "struct<article_id: string, relevance_score: double, label: string, topics: array<string>, hypotheses: array<struct<id: string, alignment: double>>, actionability: double, reasoning: string>"


def salvage(raw: Column) -> Column:
    """The JSON inside a reply: a fenced block's content, else from the first bracket to the last; null without one."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.when(fenced != "", fenced).otherwise(raw)
    found = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.when(found != "", found)


def items(raw: Column, kind: str = SCORE) -> Column:
    """An array of items, from an array or a single object; null where it can't be read."""
    text = salvage(raw)
    many = F.from_json(text, f"array<{kind}>", {"mode": "PERMISSIVE"})
    one = F.from_json(text, kind, {"mode": "PERMISSIVE"})
    return F.when(F.startswith(F.trim(text), F.lit("[")), many).when(text.isNotNull(), F.array(one))


def whole(x: Column, low: int, high: int) -> Column:
    """An integer within bounds; anything else is 0."""
    return F.when((x == F.floor(x)) & x.between(low, high), x.cast("int")).otherwise(0)


def clean_score(x: Column, known: list[str], topic_chars: int = 40, max_topics: int = 8) -> Column:
    """Bounds, whitelists and default rules for one item."""
    relevance = whole(x["relevance_score"], 0, 10)
    kept = F.filter(F.coalesce(x["hypotheses"], F.array().cast("array<struct<id:string,alignment:double>>")), lambda h: h["id"].isin(known))
    kept = F.transform(kept, lambda h: F.struct(h["id"].alias("id"), F.greatest(F.lit(-2), F.least(F.lit(2), F.coalesce(h["alignment"], F.lit(0)).cast("int"))).alias("alignment")))
    label = F.when(x["label"].isin(LABELS), x["label"]).otherwise("NOISE")
    topics = F.slice(F.filter(F.transform(F.coalesce(x["topics"], F.array().cast("array<string>")), lambda t: F.substring(F.lower(F.trim(t)), 1, topic_chars)), lambda t: t != ""), 1, max_topics)
    action = whole(x["actionability"], 0, 3)
    bumped = F.when((relevance >= 8) & (label == "IMMEDIATE"), F.greatest(action, F.lit(2))).otherwise(action)
    return F.struct(x["article_id"].alias("article_id"), relevance.alias("relevance"), label.alias("label"), topics.alias("topics"), kept.alias("hypotheses"), bumped.alias("actionability"), (relevance >= 7).alias("perspective"), F.substring(x["reasoning"], 1, 500).alias("reasoning"))
