"""How many others an article overlaps with, counted without its pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.session import stash


def _subsets(topics: str) -> Column:
    """Every non-empty subset of a short sorted array, sorted."""
    return F.expr(f"transform(sequence(1, shiftleft(1, size({topics})) - 1), m -> filter({topics}, (t, i) -> (shiftright(m, i) & 1) = 1))")


def topic_links(articles: DataFrame, id_col: str = "id", scope: str | None = None, subsets_to: int = 8) -> DataFrame:
    """One row per article: id, (scope,) class_id, links.

    Articles overlap as in ``joins.topic_overlap``: two shared topics, or one
    where either set has two at most. ``class_id`` is the smallest id with the
    same topics in the scope, ``links`` the number of other articles that
    overlap. A topic that k articles share makes no k² rows: how many share at
    least two topics with a set follows from how many hold each of its subsets
    (inclusion and exclusion), and those are counted by an aggregate. Sets of
    more than ``subsets_to`` topics, whose subsets are too many, are joined by
    topic with all classes instead; no set is left out.

    Null topics do not count. Without topics an article is its own class and
    has no links. Repeated rows count as often as they occur; a null scope is a scope.
    """
    key = F.col(scope) if scope else F.lit(0)
    topics = F.array_sort(F.array_distinct(F.filter(F.coalesce("topics", F.array().cast("array<string>")), lambda t: t.isNotNull())))
    rows = stash(articles.select(F.col(id_col).alias("id"), F.struct(key.alias("value")).alias("scope"), topics.alias("topics")))
    classes = stash(rows.where("size(topics) > 0").groupBy("scope", "topics").agg(F.min("id").alias("class"), F.count("*").alias("members")).withColumn("n", F.size("topics")))
    short, long_ = classes.where(F.col("n") <= subsets_to), classes.where(F.col("n") > subsets_to)

    parts = short.select("scope", "class", "n", "members", F.explode(_subsets("topics")).alias("part")).withColumn("i", F.size("part"))
    held = parts.groupBy("scope", "part").agg(F.sum("members").alias("all"), F.sum(F.when(F.col("n") <= 2, F.col("members")).otherwise(0)).alias("small"))
    sign = F.when(F.col("i") % 2 == 1, 1).otherwise(-1)
    one = F.sum(sign * F.col("all"))  # share one topic at least
    two = F.sum(-sign * (F.col("i") - 1) * F.col("all"))  # share two at least
    single = F.sum(sign * F.col("i") * F.col("small"))  # share exactly one, and have two at most
    # A planner that goes by the size of the stashed files would broadcast what explodes from them: these joins sort and merge.
    own = parts.join(held.hint("merge"), ["scope", "part"]).groupBy("scope", "class", "n", "members").agg(one.alias("one"), (two + single).alias("two"))
    counted = own.select("scope", "class", (F.when(F.col("n") <= 2, F.col("one")).otherwise(F.col("two")) - 1).alias("links"))

    def topics_of(df: DataFrame, side: str) -> DataFrame:
        return df.select("scope", F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("members").alias(f"m_{side}"), F.explode("topics").alias("topic"))

    met = topics_of(long_, "a").join(topics_of(classes, "b").hint("merge"), ["scope", "topic"]).where("a <> b")
    met = met.groupBy("scope", "a", "b", "n_a", "n_b", "m_a", "m_b").agg(F.count("*").alias("shared")).where("shared >= 2 or n_a <= 2 or n_b <= 2")
    # Pairs of two long sets turn up from either side, those with a short one from the long side only.
    there = met.select("scope", F.col("a").alias("class"), F.col("m_b").alias("links"))
    back = met.where(F.col("n_b") <= subsets_to).select("scope", F.col("b").alias("class"), F.col("m_a").alias("links"))
    same = long_.select("scope", "class", (F.col("members") - 1).alias("links"))
    links = counted.unionByName(there).unionByName(back).unionByName(same).groupBy("scope", "class").agg(F.sum("links").cast("long").alias("links"))
    known = classes.select("scope", "topics", "class").join(links.hint("merge"), ["scope", "class"])
    out = rows.join(known.hint("merge"), ["scope", "topics"], "left").select("id", F.col("scope.value").alias("value"), F.coalesce("class", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return out.select(F.col("id").alias(id_col), *([F.col("value").alias(scope)] if scope else []), "class_id", "links")
