"""Free numbers for slugs that are taken already."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetta.operators.windows import placed
from gazetta.session import stash

#: A slug that is another one with a number of 2 or more.
NUMBERED = r"^(.+)-([2-9]|[1-9][0-9]{1,8})$"


def free_slugs(rows: DataFrame, scope: str, order: str, base: str = "slug", taken: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``base`` made unlike any before in its scope: the first gets it as it is, later ones the least free of -2, -3, …

    The rule, row after row in ``order`` (unique in a scope, null in neither), starting
    from the slugs ``taken`` (scope, slug), has a closed form: the j-th row of a base gets
    number j, moved on by one for each number that another row had before.
    Only a row whose own base ends in that number can: the first row of base
    ``x-3`` has ``x-3`` unless the third row of ``x`` came before it. So for every such pair of
    bases the rows of ``x`` before that moment are counted, and the pairs of
    one family are settled in the order of their numbers, from one row a base. No task
    holds the rows of a base.
    """
    items = rows.select(F.col(scope).cast("string").alias("_s"), F.struct(F.lit(1).alias("late"), F.col(order).alias("at")).alias("_when"), F.col(base).alias("_b"))
    if taken is not None:
        before = taken.select(F.col(scope).cast("string").alias("_s"), F.struct(F.lit(0).alias("late"), F.lit(None).cast(rows.schema[order].dataType).alias("at")).alias("_when"), F.col("slug").alias("_b")).distinct()
        items = items.unionByName(before)
    items = items.withColumn("_s", F.coalesce("_s", F.lit(""))).withColumn("_key", F.concat_ws("\u0001", "_s", "_b"))
    items = stash(placed(items, "_key", "_when").withColumnRenamed("place", "_j"))
    bases = stash(items.groupBy("_s", "_b", "_key").agg(F.max("_j").alias("m"), F.min("_when").alias("first")))
    parent, number = F.regexp_extract("_b", NUMBERED, 1), F.regexp_extract("_b", NUMBERED, 2)
    children = bases.where(parent != "").withColumn("_of", F.concat_ws("\u0001", "_s", parent)).withColumn("n", number.cast("long"))
    pairs = stash(children.join(bases.select(F.col("_key").alias("_of")), "_of").select("_of", "_key", "n", "first"))
    count = F.lit(0).cast("long")
    if not pairs.limit(1).count():
        moves = None
    else:
        # How many rows of the parent come before the child's first: places among rows and moments, less those among moments.
        moments = pairs.select(F.col("_of").alias("k"), F.col("first").alias("at"), F.col("_key").alias("child"))
        involved = items.join(pairs.select(F.col("_of").alias("_key")).distinct(), "_key", "left_semi").select(F.col("_key").alias("k"), F.col("_when").alias("at"), F.lit(None).cast("string").alias("child"))
        both = placed(involved.unionByName(moments), "k", "at", "child").where("child is not null").select("k", "child", F.col("place").alias("p"))
        alone = placed(moments, "k", "at", "child").select("k", "child", F.col("place").alias("q"))
        counted = pairs.join(both.join(alone, ["k", "child"]).select(F.col("k").alias("_of"), F.col("child").alias("_key"), (F.col("p") - F.col("q")).alias("before")), ["_of", "_key"])
        moves = stash(counted.groupBy(_root(F.col("_of")).alias("root")).applyInPandas(_settled, "key string, moves array<long>"))
    numbered = items.where("_when.late = 1").select("_key", "_s", "_b", F.col("_when.at").alias(order), "_j")
    if moves is not None:
        numbered = numbered.join(moves.withColumnRenamed("key", "_key"), "_key", "left")
        count = F.coalesce(F.size(F.filter("moves", lambda x: x <= F.col("_j"))).cast("long"), count)
    place = F.col("_j") + F.greatest(count, F.lit(0))
    named = numbered.select(F.col("_s").alias("_scope"), F.col(order).alias("_order"), F.when(place == 1, F.col("_b")).otherwise(F.concat_ws("-", "_b", place.cast("string"))).alias("_made"))
    found = rows.join(named, (F.col(order) == F.col("_order")) & (F.coalesce(F.col(scope).cast("string"), F.lit("")) == F.col("_scope")))
    return found.select(*[F.col("_made").alias(base) if c == base else F.col(c) for c in rows.columns])


def _root(key):
    """The base of a family: without any numbers at its end."""
    return F.regexp_replace(key, r"(-([2-9]|[1-9][0-9]{1,8}))+$", "")


def _settled(pairs: pd.DataFrame) -> pd.DataFrame:
    """For every base of a family the places from which its rows move on by one; parents before children."""
    moves: dict[str, list[int]] = {}
    for of in sorted(set(pairs["_of"]), key=len):
        skipped = len(moves.get(of, []))
        for key, n, before in sorted(pairs[pairs["_of"] == of][["_key", "n", "before"]].itertuples(index=False), key=lambda r: r[1]):
            if before < n - skipped:  # the child is first: its parent passes the number over
                moves.setdefault(of, []).append(int(n - skipped))
                skipped += 1
            else:  # the child finds its own base taken
                moves.setdefault(key, []).append(1)
    return pd.DataFrame({"key": list(moves), "moves": list(moves.values())})
