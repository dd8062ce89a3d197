"""Rankings, quotas and capped selections. Every order ends in an id, so results are total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.session import sized, stash


def newest_per_source(articles: DataFrame, cap: Column | int, source: str = "source_id", published: str = "published_at", id_col: str = "id") -> DataFrame:
    """The newest rows of each source up to its cap, a number or a column."""
    w = Window.partitionBy(source).orderBy(F.desc(published), F.col(id_col))
    return articles.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def source_cap(weight: Column, priority: Column, base: int) -> Column:
    """Priority sources get the whole cap, others ``max(1, int(cap * weight))``."""
    return F.when(priority, base).otherwise(F.greatest(F.lit(1), F.floor(weight * base).cast("int")))


def first_by_url(rows: DataFrame, url: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(url).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def safety_sample(rows: DataFrame, ceiling: int, key: str = "id") -> DataFrame:
    """Up to ``ceiling`` rows in the order of a digest of the key: random, and the same in every run."""
    return rows.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(ceiling)


def representatives(members: DataFrame, max_keep: int = 5, bias_categories: list[str] | None = None) -> DataFrame:
    """Per cluster the earliest and latest copy, the longest ones up to the target, and in bias categories the best of each side.

    members: cluster, id, published_at, n_chars, category, lean. A cluster is
    in a bias category if any member is.
    """
    by = Window.partitionBy("cluster")
    ranked = members.select(
        "*",
        F.count("*").over(by).alias("_size"),
        F.row_number().over(by.orderBy("published_at", "id")).alias("_early"),
        F.row_number().over(by.orderBy(F.desc("published_at"), F.desc("n_chars"), F.desc("id"))).alias("_late"),
        F.max(F.coalesce(F.col("category").isin(bias_categories or []), F.lit(False))).over(by).alias("_biased"),
    )
    ranked = ranked.withColumn("_ends", F.when((F.col("_early") == 1) | (F.col("_late") == 1), 1).otherwise(0))
    target = F.least(F.greatest(F.lit(2), F.lit(max_keep)), F.col("_size"))
    fill = F.row_number().over(Window.partitionBy("cluster", "_ends").orderBy(F.desc("n_chars"), "published_at", "id"))
    ranked = ranked.withColumn("_slots", target - F.sum("_ends").over(by)).withColumn("_fill", fill)
    side = F.row_number().over(Window.partitionBy("cluster", "lean").orderBy(F.desc("published_at"), F.desc("n_chars"), F.desc("id")))
    ranked = ranked.withColumn("_side", F.when(F.col("_biased") & F.col("lean").isNotNull(), side))
    keep = (F.col("_ends") == 1) | (F.col("_fill") <= F.col("_slots")) | (F.col("_side") == 1)
    return ranked.select(*members.columns, F.coalesce(keep, F.lit(False)).alias("keep"))


def diverse_top(rows: DataFrame, k: int, per_source: int = 1, by: list[str] | None = None, source: str = "source_id", rank: str = "rank") -> DataFrame:
    """The first ``k`` with at most ``per_source`` of a source, filled up with the rest; position gives the output order."""
    keys = by or []
    rows = rows.withColumn("_over", F.row_number().over(Window.partitionBy(*keys, source).orderBy(rank)) > per_source)
    w = Window.partitionBy(*keys).orderBy("_over", rank)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).drop("_over")


def relevance_backoff(rows: DataFrame, by: str, bar: int | Column, floor: int | Column, least: int | Column) -> DataFrame:
    """Rows that qualify once the bar is lowered by the smallest step at which ``least`` rows qualify, or the largest.

    Each row needs a step; a histogram of needs and its running sum give the step without a loop.
    Bar, floor and least number may be columns that are constant within a group.
    """
    bar, floor, least = (x if isinstance(x, Column) else F.lit(x) for x in (bar, floor, least))
    need = F.when(F.coalesce("actionability", F.lit(0)) >= 2, 0).when(F.coalesce("relevance", F.lit(0)) >= 1, F.greatest(F.lit(0), bar - F.col("relevance")))
    rows = rows.withColumn("_need", need)
    steps = rows.where(F.col("_need") <= bar - floor).groupBy(by, "_need").agg(F.count("*").alias("_n"), F.max(bar - floor).alias("_most"), F.max(least).alias("_least"))
    running = F.sum("_n").over(Window.partitionBy(by).orderBy("_need"))
    found = steps.withColumn("_c", running).groupBy(by).agg(F.min(F.when(F.col("_c") >= F.col("_least"), F.col("_need"))).alias("_step"), F.max("_most").alias("_most"))
    found = found.select(by, F.coalesce("_step", "_most").alias("relax"))
    return rows.join(found, by).where(F.col("_need") <= F.col("relax")).drop("_need")


def quota(clusters: DataFrame, by: str, floor: int, cap: int, multiplier: float, most: int) -> DataFrame:
    """Themes per brief: a floor for each bundle first, then by rank up to the cap, until the target is met.

    clusters: ``by``, cluster_rank, bundle. The target follows the number of
    active bundles; clusters without a bundle only count for nothing.
    """
    rows = clusters.where("bundle is not null")
    w = Window.partitionBy(by, "bundle").orderBy("cluster_rank")
    rows = rows.withColumn("_rn", F.row_number().over(w))
    active = rows.groupBy(by).agg(F.countDistinct("bundle").alias("_active"))
    target = F.greatest(F.least(F.ceil(F.col("_active") * F.lit(multiplier)), F.lit(most)), F.col("_active"))
    rows = rows.join(active, by).withColumn("_target", target).where(F.col("_rn") <= cap)
    rows = rows.withColumn("_floor", F.col("_rn") <= min(floor, cap))
    order = Window.partitionBy(by).orderBy(F.desc("_floor"), "cluster_rank")
    picked = rows.withColumn("_at", F.row_number().over(order)).where(F.col("_floor") | (F.col("_at") <= F.col("_target")))
    return picked.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("cluster_rank")).cast("int")).select(*clusters.columns, "position")


def demote(clusters: DataFrame, by: str, cap: int) -> DataFrame:
    """Clusters beyond the cap of their category become highlights; a null category has no cap."""
    rn = F.row_number().over(Window.partitionBy(by, "bundle").orderBy("cluster_rank"))
    return clusters.withColumn("role", F.when(F.col("bundle").isNull() | (rn <= cap), "theme").otherwise("highlight"))


def eligible(clusters: DataFrame, by: str, least: Column | int, floors: bool = True) -> DataFrame:
    """Clusters of the least size, or the first of a category where floors hold."""
    first = F.col("bundle").isNotNull() & (F.row_number().over(Window.partitionBy(by, "bundle").orderBy("cluster_rank")) == 1)
    return clusters.withColumn("_first", first).where((F.col("size") >= least) | (F.lit(floors) & F.col("_first"))).drop("_first")


def best_brief(briefs: DataFrame, by: list[str], now: Column, hours: int = 20) -> DataFrame:
    """Of the non-empty briefs of the last hours, today's first, then the longest, then the newest."""
    age = (F.unix_micros(now) - F.unix_micros("created_at")) / 3.6e9
    rows = briefs.where((F.length("content") > 0) & (F.col("created_at").isNull() | (age <= hours)))
    today = F.coalesce(F.to_date("created_at") == F.to_date(now), F.lit(False))
    w = Window.partitionBy(*by).orderBy(F.desc(today), F.desc(F.length("content")), F.desc("created_at"), "id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def capped_run(stories: DataFrame, by: str, order: str, checked: str, noted: str, most_checked: int = 40, most_noted: int = 5) -> DataFrame:
    """Stories until the caps on checked or noted ones before them are met."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(F.col(c).cast("int")).over(w), F.lit(0)) for c in (checked, noted)]
    return stories.withColumn("_c", before[0]).withColumn("_n", before[1]).where((F.col("_c") < most_checked) & (F.col("_n") < most_noted)).drop("_c", "_n")


def placed(rows: DataFrame, scope: str, *order: str | Column) -> DataFrame:
    """``rows`` with their place (from 1) within their scope, however many a scope has.

    Rows are sorted across tasks by scope and order, counted per task and
    scope, and numbered from there; no task holds a scope.
    """
    sorted_rows = stash(rows.orderBy(scope, *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = sorted_rows.groupBy(scope, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stash(counts.select(F.col(scope).alias("_scope"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    own = F.row_number().over(Window.partitionBy(scope, "_part").orderBy("_at"))
    numbered = sorted_rows.withColumn("_own", own)
    found = numbered.join(sized(counts, 200_000), F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("_part") == F.col("_p")))
    return found.select(*rows.columns, (F.col("_before") + F.col("_own")).alias("place"))
