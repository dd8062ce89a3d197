"""Selection jobs: what goes into every brief of an account and day, and into every chat's brief, all in one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions.quantity import jaccard
from gazetta.operators import aggregates, filters, greedy, windows
from gazetta.session import sized, stash


def within_windows(articles: DataFrame, briefs: DataFrame, classes: DataFrame, default: int, widest: int) -> DataFrame:
    """Articles of each brief (brief, account, as_of) that are as young as their category's class asks.

    Briefs meet articles by day, so an article is only joined with the briefs
    whose widest window reaches it. Undated articles belong to no brief here.
    """
    back = F.sequence(F.lit(0), F.lit(-(-widest // 24)))
    dealt = briefs.select("brief", "account", "as_of", F.explode(F.transform(back, lambda d: F.date_sub(F.to_date("as_of"), d))).alias("_day"))
    age = (F.unix_micros("as_of") - F.unix_micros("published_at")) / 3.6e9
    found = articles.withColumn("_day", F.to_date("published_at")).join(dealt, "_day").withColumn("_age", age).where((F.col("_age") >= 0) & (F.col("_age") <= widest))
    found = found.join(sized(classes.select("category", "window_hours")), "category", "left")
    return found.where(F.col("_age") <= F.coalesce("window_hours", F.lit(default))).drop("_day", "_age", "window_hours")


def without_delivered(rows: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Rows (account, id) that their account has not had."""
    had = deliveries.select("account", F.col("article_id").alias("id")).distinct()
    return rows.join(had, ["account", "id"], "left_anti")


def themed(rows: DataFrame, key: str, most: int | Column, best: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their cluster's seed, one row a cluster: its size, score, category and rank); rows: key, id, rank, topics, category, score.

    With ``best``, only the first ``best`` clusters and their rows are whole, and others may be missing.
    """
    rows = stash(rows.join(greedy.topic_themes(rows, most, scope=key, best=best), [key, "id"]))
    marked = rows.withColumn("_cluster", F.struct(key, "seed"))
    bundle = aggregates.cluster_category(marked, "_cluster", "category", "rank").select(F.col(f"_cluster.{key}").alias(key), F.col("_cluster.seed").alias("seed"), F.col("category").alias("bundle"))
    found = rows.groupBy(key, "seed").agg(F.count("*").alias("size"), F.sum("score").alias("score"), F.min("rank").alias("_at"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "_at")
    return rows, stash(found.join(bundle, [key, "seed"]).withColumn("cluster_rank", F.row_number().over(order)).drop("_at"))


def highlights(left: DataFrame, themes: DataFrame, key: str, count: int, least: int, alike: float = 1.0, shared: int = 3) -> DataFrame:
    """(key, id, position): the best of what no theme took, without those of a theme's story, of a better one's story or with its topics.

    At most ``count`` of a key are compared, in order, each with those kept before it.
    """
    n = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    best = left.where(F.coalesce("relevance", F.lit(0)) >= least).withColumn("_n", n).where(F.col("_n") <= count)
    anchored = themes.where("story is not null").select(key, "story").distinct()
    best = best.join(anchored, [key, "story"], "left_anti")
    topics = F.coalesce(F.array_distinct("topics"), F.array().cast("array<string>"))
    items = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "id", "story", topics.alias("topics")))).alias("items"))

    def repeats(h: Column, k: Column) -> Column:
        same = (F.size(F.array_intersect(h["topics"], k["topics"])) >= shared) & (jaccard(h["topics"], k["topics"]) >= alike)
        return F.coalesce(h["story"] == k["story"], F.lit(False)) | same

    none = F.filter("items", lambda _: F.lit(False))
    kept = F.aggregate("items", none, lambda kept, h: F.when(F.exists(kept, lambda k: repeats(h, k)), kept).otherwise(F.concat(kept, F.array(h))))
    return items.select(key, F.posexplode(kept).alias("position", "item")).select(key, F.col("item.id").alias("id"), (F.col("position") + 1).alias("position"))


def in_order(parts: DataFrame, key: str) -> DataFrame:
    """``parts`` (key, role, group, at, id) without an id's later places, numbered as the brief cites them: clusters, then highlights, then drops."""
    stage = F.when(F.col("role").isin("theme", "woven"), 0).when(F.col("role") == "highlight", 1).otherwise(2)
    place = F.struct(stage.alias("stage"), F.col("group"), (F.col("role") == "woven").alias("late"), F.col("at"))
    first = parts.groupBy(key, "id").agg(F.min_by(F.struct("role", "group"), place).alias("x"), F.min(place).alias("place"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    return first.select(key, "x.role", F.col("x.group").alias("cluster_rank"), "id", n.alias("place"))


def brief_selection(articles: DataFrame, briefs: DataFrame, deliveries: DataFrame, scores: DataFrame, classes: DataFrame, drop_categories: list[str], *, bar: int = 6, floor: int = 4, least: int = 3, most: int = 6, window: int = 24, drop_window: int = 168, highlight_count: int = 8, highlight_bar: int = 8, drops: int = 3, theme_size: int = 2) -> tuple[DataFrame, DataFrame]:
    """(selection, status) of every brief (brief, account, as_of).

    articles: id, category, source_id, story, topics, relevance, actionability,
    published_at; scores: article_id. Only scored articles that the account has
    not had take part. selection: brief, role, cluster_rank, id, place, where
    role is theme, woven (a drop that shares a topic with the first theme),
    highlight or drop. status: brief, qualifying, themes, status, which says
    why a brief without themes is skipped.
    """
    scored = articles.join(scores.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi")
    is_drop = F.coalesce(F.col("category").isin(drop_categories), F.lit(False))
    score = filters.composite(F.col("relevance"), F.col("actionability"))
    news = within_windows(scored.where(~is_drop), briefs, classes, window, max(window, *[r.h or 0 for r in classes.agg(F.max("window_hours").alias("h")).collect()]))
    news = without_delivered(news, deliveries).withColumn("score", score)
    news = stash(windows.placed(news, "brief", F.desc("score"), F.desc("published_at"), F.col("id")).withColumnRenamed("place", "rank"))
    gated = stash(windows.relevance_backoff(news, "brief", bar, floor, least))
    rows, clusters = themed(gated, "brief", most)
    chosen = stash(windows.quota(windows.eligible(clusters, "brief", theme_size), "brief", 1, 2, 1.5, 10).select("brief", "seed", F.col("position").alias("group")))
    in_theme = stash(rows.join(chosen, ["brief", "seed"]))
    counts = gated.groupBy("brief").agg(F.count("*").alias("qualifying")).join(chosen.groupBy("brief").agg(F.count("*").alias("themes")), "brief", "left")
    status = briefs.select("brief").join(counts, "brief", "left").select("brief", F.coalesce("qualifying", F.lit(0)).alias("qualifying"), F.coalesce("themes", F.lit(0)).alias("themes"))
    needed = F.when(F.col("qualifying") >= least, least).otherwise(1)
    said = F.when(F.col("qualifying") == 0, "skip: quiet_day_no_articles").when(F.col("themes") < needed, "skip: no_clusters").when(F.col("qualifying") < least, "quiet").otherwise("normal")
    status = stash(status.withColumn("status", said))
    written = status.where(~F.startswith("status", F.lit("skip"))).select("brief")
    left = rows.join(in_theme.select("brief", "id"), ["brief", "id"], "left_anti")
    lights = highlights(left, in_theme, "brief", highlight_count, highlight_bar)
    pool = within_windows(scored.where(is_drop), briefs, classes.limit(0), drop_window, drop_window)
    pool = without_delivered(pool, deliveries).withColumn("score", score)
    pool = windows.placed(pool, "brief", F.desc("score"), F.desc("published_at"), F.col("id")).withColumnRenamed("place", "rank")
    dropped = stash(windows.diverse_top(pool, drops, by=["brief"]))
    main = in_theme.where("group = 1").select("brief", F.explode("topics").alias("topic")).distinct()
    woven = dropped.select("brief", "id", F.explode("topics").alias("topic")).join(main, ["brief", "topic"]).select("brief", "id", F.lit(True).alias("woven")).distinct()
    dropped = dropped.join(woven, ["brief", "id"], "left")
    # A woven drop stands in the first theme.
    role = F.when(F.col("woven"), "woven").otherwise("drop")
    parts = in_theme.select("brief", F.lit("theme").alias("role"), "group", F.col("rank").alias("at"), "id")
    parts = parts.unionByName(lights.select("brief", F.lit("highlight").alias("role"), F.lit(0).alias("group"), F.col("position").cast("long").alias("at"), "id"))
    parts = parts.unionByName(dropped.select("brief", role.alias("role"), F.when(F.col("woven"), 1).otherwise(0).alias("group"), F.col("position").cast("long").alias("at"), "id"))
    return in_order(parts.join(written, "brief", "left_semi"), "brief"), status


def chat_selection(articles: DataFrame, chats: DataFrame, rules: DataFrame, lengths: DataFrame, now: Column, *, window: int = 24, fresh_hours: int = 6, per_category: int = 2, highlight_count: int = 8, highlight_bar: int = 8) -> DataFrame:
    """(chat, role, cluster_rank, id, place) of every chat (chat, categories, length).

    Chats with the same categories and length share one selection, which is
    made once and joined back. rules: category, include, exclude. lengths:
    length, bar, floor, least, max_themes, per_theme. Articles as in
    ``brief_selection``; fresh ones are admitted at the floor. Clusters beyond
    the themes' number, or beyond their category's cap, go to the highlights.
    """
    plan = F.concat_ws("|", "length", F.array_join(F.array_sort(F.array_distinct("categories")), ","))
    chats = chats.withColumn("plan", plan)
    plans = stash(chats.select("plan", "length", F.array_distinct("categories").alias("categories")).dropDuplicates(["plan"]))
    asked = plans.select(F.col("plan").alias("chat"), F.explode("categories").alias("category")).join(rules.where("category <> '*'"), "category")
    star = plans.select(F.col("plan").alias("chat"), F.lit("*").alias("category")).join(rules, "category")
    recent = stash(articles.where(filters.in_window(F.col("published_at"), now, F.lit(window))))
    rows = filters.admitted(recent.select("id", "topics"), asked.unionByName(star.select(*asked.columns))).withColumnRenamed("chat", "plan")
    rows = rows.join(recent, "id").join(sized(plans.join(lengths, "length").drop("categories"), 100_000), "plan")
    rows = stash(rows.withColumn("score", filters.composite(F.col("relevance"), F.col("actionability"))))
    enough = windows.relevance_backoff(rows, "plan", F.col("bar"), F.col("floor"), F.col("least"))
    fresh = rows.where(filters.in_window(F.col("published_at"), now, F.lit(fresh_hours)) & filters.entry_gate(F.col("relevance"), F.col("actionability"), F.col("floor")))
    both = rows.join(enough.select("plan", "id").union(fresh.select("plan", "id")).distinct(), ["plan", "id"], "left_semi")
    ranked = windows.placed(both, "plan", F.desc("score"), F.desc("published_at"), F.col("id")).withColumnRenamed("place", "rank")
    ranked = stash(ranked)
    themes, clusters = themed(ranked, "plan", F.col("per_theme"), F.col("max_themes"))
    most = plans.join(lengths, "length").select("plan", "max_themes")
    first = clusters.join(sized(most, 100_000), "plan").where(F.col("cluster_rank") <= F.col("max_themes"))
    chosen = stash(windows.demote(first, "plan", per_category).where("role = 'theme'").select("plan", "seed", F.row_number().over(Window.partitionBy("plan").orderBy("cluster_rank")).alias("group")))
    in_theme = stash(themes.join(chosen, ["plan", "seed"]))
    lights = highlights(ranked.join(in_theme.select("plan", "id"), ["plan", "id"], "left_anti"), in_theme, "plan", highlight_count, highlight_bar)
    parts = in_theme.select("plan", F.lit("theme").alias("role"), "group", F.col("rank").alias("at"), "id")
    parts = parts.unionByName(lights.select("plan", F.lit("highlight").alias("role"), F.lit(0).alias("group"), F.col("position").cast("long").alias("at"), "id"))
    return in_order(parts, "plan").join(chats.select("chat", "plan"), "plan").drop("plan")
