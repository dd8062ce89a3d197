"""Order-dependent selections, in parallel and equal to the sequential rule."""

from __future__ import annotations

import heapq
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.operators import windows
from gazetta.session import stash


SEED = "scope string, id long, rank long, topics array<string>, left int, total long"


class OpenSeeds:
    """Seeds that still take articles, found by what they share with one.

    Two open seeds never overlap, as the earlier would have taken the later.
    So a pair of topics, and a topic of a seed that has two at most, lead to
    one seed; only an article of two topics at most meets several seeds by a topic, the best first.
    """

    def __init__(self):
        self.by_pair: dict[tuple[str, str], list] = {}
        self.by_topic: dict[str, list[tuple[int, int, list]]] = {}
        self.small: dict[str, list] = {}
        self.all: list[list] = []

    def add(self, seed: int, rank: int, topics: list[str], left: int, total: int = 0) -> list:
        row = [rank, seed, sorted(set(topics)), left, total]
        self.all.append(row)
        if left > 0:
            for t in row[2]:
                heapq.heappush(self.by_topic.setdefault(t, []), (rank, seed, row))
                if len(row[2]) <= 2:
                    self.small[t] = row
            self.by_pair.update(dict.fromkeys(combinations(row[2], 2), row))
        return row

    def take(self, topics: list[str], score: int = 0) -> int | None:
        """The best open seed that overlaps ``topics``; it has a place less then, and the score more."""
        mine, found = sorted(set(topics)), []
        if len(mine) <= 2:
            for t in mine:
                heap = self.by_topic.get(t, [])
                while heap and heap[0][2][3] == 0:
                    heapq.heappop(heap)
                found += [heap[0][2]] if heap else []
        else:
            found = [r for r in map(self.by_pair.get, combinations(mine, 2)) if r and r[3]] + [r for r in map(self.small.get, mine) if r and r[3]]
        if not found:
            return None
        best = min(found, key=lambda r: r[:2])
        best[3] -= 1
        best[4] += score
        return best[1]


def _walk():
    """A block of a scope's articles in rank order, each to the best open seed that overlaps it, else a seed of its own."""

    def run(rows: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        held, out = OpenSeeds(), []
        if rows.empty:
            return pd.DataFrame(columns=["scope", "id", "rank", "topics", "left", "total", "seed"])
        for seed, rank, topics, left, total in zip(*(seeds[c] for c in ("id", "rank", "topics", "left", "total")), strict=True) if len(seeds) else ():
            held.add(int(seed), int(rank), list(topics), int(left), int(total))
        scope = rows["scope"].iloc[0]
        rows = rows.sort_values("rank")
        for i, rank, topics, most, score in zip(*(rows[c] for c in ("id", "rank", "topics", "most", "score")), strict=True):
            seed = held.take(list(topics), int(score))
            if seed is None:
                held.add(int(i), int(rank), list(topics), int(most) - 1 if len(topics) else 0, int(score))
                seed = i
            out.append((scope, int(i), None, None, None, None, int(seed)))
        # What is known of the seeds now: a row without a seed of its own.
        out += [(scope, r[1], r[0], r[2], r[3], r[4], None) for r in held.all]
        return pd.DataFrame(out, columns=["scope", "id", "rank", "topics", "left", "total", "seed"]).astype({"rank": "Int64", "left": "Int32", "total": "Int64", "seed": "Int64"})

    return run


def _keys(small_article: Column | None = None) -> Column:
    """What an article (where told if it is small) or a seed is found by: pairs of topics, topics of small seeds, topics of other seeds."""
    t, n = F.col("topics"), F.size("topics")
    pairs = F.flatten(F.transform(t, lambda x: F.transform(F.filter(t, lambda y: y > x), lambda y: F.struct(F.lit("pair").alias("kind"), F.concat_ws("\u0001", x, y).alias("key")))))
    single = lambda kind: F.transform(t, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    if small_article is None:
        return F.when(n <= 2, single("small")).otherwise(F.concat(pairs, single("large")))
    return F.when(small_article, F.concat(single("small"), single("large"))).otherwise(F.concat(pairs, single("small")))


def _met(today: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """Open seeds that a block's articles can overlap. Of many that share a topic only with small articles, as many as a block has articles."""
    asked = today.select("scope", F.explode(_keys(F.size("topics") <= 2)).alias("k")).select("scope", "k.kind", "k.key").distinct()
    known = seeds.where("left > 0").select("scope", "id", "rank", F.explode(_keys()).alias("k")).select("scope", "id", "rank", "k.kind", "k.key")
    found = known.join(asked, ["scope", "kind", "key"])
    best = F.row_number().over(Window.partitionBy("scope", "kind", "key").orderBy("rank"))
    return seeds.join(found.withColumn("n", best).where(F.col("n") <= most).select("scope", "id").distinct(), ["scope", "id"], "left_semi")


def _ahead(rows: DataFrame) -> DataFrame:
    """(scope, block, high, low, most, best): the bounds of the scores and limits of a block and of all after it in its scope."""
    per = rows.groupBy("scope", "block").agg(F.max("score").alias("high"), F.min("score").alias("low"), F.max("most").alias("most"), F.max("best").alias("best"))
    w = Window.partitionBy("scope").orderBy(F.desc("block"))
    return per.select("scope", "block", F.max("high").over(w).alias("high"), F.min("low").over(w).alias("low"), F.max("most").over(w).alias("most"), F.max("best").over(w).alias("best"))


def _unsettled(ahead: DataFrame, full: DataFrame, seeds: DataFrame) -> DataFrame:
    """Of ``ahead`` (one row a scope), the scopes in which what is ahead can change the first ``best`` clusters, as (full) seeds stand now.

    They are settled once as many full clusters stand before any that the
    highest score ahead could still make: of an open seed that fills up, or of a new one. The earlier of equal ones is before.
    """
    # A limit under one still leaves a seed its own score.
    last = full.join(ahead, "scope").where("place = best").select(*ahead.columns, F.col("total").alias("bar"), F.col("rank").alias("bar_rank"))
    safe = last.where("low >= 0 and greatest(1, most) * high <= bar")
    could = F.col("total") + F.col("left") * F.col("high")
    rivals = seeds.join(safe, "scope").where((could > F.col("bar")) | ((could == F.col("bar")) & (F.col("rank") < F.col("bar_rank")))).select("scope").distinct()
    return ahead.join(safe.select("scope").join(rivals, "scope", "left_anti"), "scope", "left_anti")


def topic_themes(articles: DataFrame, max_per_theme: int | Column = 6, scope: str | None = None, block: int = 20_000, best: int | Column | None = None) -> DataFrame:
    """(id, seed), and ``scope`` where it is given: greedy clusters over topic overlap. articles: id, rank (total within a scope), topics.

    The rule: in rank order each free article seeds a cluster and takes the
    free later articles that overlap it, up to the limit. Read from the
    article's side, it belongs to the best seed before it that overlaps it and
    has a place left, and is a seed where there is none. So articles are worked
    off in blocks of a scope's ranks, all scopes at once; a task has one block
    and the open seeds that its articles can overlap, and no pairs are made. Null topics are none. The limit may be a column.

    With ``best``, a number or a column, only a scope's first ``best`` clusters by the sum of
    ``score`` (whole numbers), the earlier seed first, are wanted. They are returned whole; a scope
    ends with the block after which no article left can change them, however its topics are, and what other clusters would have got is left out.
    """
    key = F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
    topics = F.array_sort(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))))
    number = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    score = F.lit(0) if best is None else F.col("score")
    rows = articles.select(key.alias("scope"), F.col("id").cast("long").alias("id"), F.col("rank").cast("long").alias("rank"), F.array_compact(topics).alias("topics"), number(max_per_theme, "int").alias("most"), score.cast("long").alias("score"), number(best, "int").alias("best"))
    rows = stash(windows.placed(rows, "scope", "rank").withColumn("block", F.floor((F.col("place") - 1) / block).cast("int")))
    last = rows.agg(F.max("block")).first()[0]
    out, seeds, full, live = None, stash(rows.sparkSession.createDataFrame([], SEED)), None, None
    ahead = stash(_ahead(rows)) if best is not None else None
    for at in range((last or 0) + 1):
        today = rows.where(F.col("block") == at).select("scope", "id", "rank", "topics", "most", "score")
        if live is not None:
            today = today.join(live.select("scope"), "scope", "left_semi")
        met = _met(today, seeds, block) if at else seeds
        known = "scope string, id long, rank long, topics array<string>, left int, total long, seed long"
        done = stash(today.groupBy("scope").cogroup(met.groupBy("scope")).applyInPandas(_walk(), known))
        part = done.where("seed is not null").select("scope", "id", "seed")
        out = part if out is None else out.unionByName(part)
        if at < (last or 0):
            now = done.where("seed is null").select("scope", "id", "rank", "topics", "left", "total")
            seeds = stash(seeds.join(now.select("scope", "id"), ["scope", "id"], "left_anti").unionByName(now).where("left > 0"))
            if ahead is not None:
                closed = now.where("left <= 0").select("scope", "id", "rank", "total")
                closed = closed if full is None else closed.unionByName(full.drop("place"))
                left = ahead.where(F.col("block") == at + 1)
                left = left if live is None else left.join(live.select("scope"), "scope", "left_semi")
                place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("total"), "rank"))
                kept = closed.withColumn("place", place).join(left.select("scope", "best"), "scope").where("place <= best")
                full = stash(kept.drop("best"))
                live = stash(_unsettled(left, full, seeds))
                if not live.limit(1).count():
                    break
    return out.select(F.col("scope").alias(scope), "id", "seed") if scope else out.select("id", "seed")


def thin_highlights(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, kept): an item is kept unless a better-ranked kept item conflicts with it.

    items: id, rank (total); conflicts: a, b. This is the lexicographically
    first maximal independent set, found in rounds: keep an item whose better
    neighbours are all dropped, drop one that has a kept better neighbour.
    """
    r = items.select("id", "rank")
    e = conflicts.join(r.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(r.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    e = stash(e.select(F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("better"), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct())
    state = stash(items.select("id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        above = e.join(state.select(F.col("id").alias("better"), F.col("kept").alias("k")), "better").groupBy("id").agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("any_kept"), F.bool_and(F.coalesce(~F.col("k"), F.lit(False))).alias("all_dropped"))
        step = state.join(above, "id", "left")
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("any_kept"), F.lit(False)).when(F.coalesce("all_dropped", F.lit(True)), F.lit(True))
        state = stash(step.select("id", new.alias("kept")))
        if not state.where("kept is null").limit(1).count():
            return state
