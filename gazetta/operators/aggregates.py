"""Summaries of clusters, costs, sources and briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions import balance
from gazetta.functions.text import contains_any
from gazetta.session import sized

#: Words that mark a price event, as plain substrings.
PRICE_WORDS = [
    "price", "hits", "drops", "surges", "soars", "plunge", "plunges", "rally", "rallies", "recovers", "breaches", "tests", "slumps",
    "crashes", "breakout", "bottoms", "tops", "all-time high", "ath", "%", "$", "btc", "bitcoin", "eth", "ethereum", "sol",
    "election", "ceasefire", "ruling", "verdict", "shutdown",
]


def cluster_summary(members: DataFrame, edges: DataFrame, price_hours: float = 12, review: float = 0.90, words: list[str] | None = None) -> DataFrame:
    """One row per cluster of two or more: members, span_hours, min_similarity, kind, primary_id, review.

    The least similarity is over edges (cluster, similarity), 1.0 without
    any. A price event's primary is its latest member, an analysis's its
    earliest; undated members come last in either case.
    """
    words = PRICE_WORDS if words is None else words
    text = F.concat_ws(" ", "title", F.substring("body", 1, 300))
    one = members.withColumn("_price", contains_any(text, words))
    span = (F.unix_micros(F.max("published_at")) - F.unix_micros(F.min("published_at"))) / 3.6e9
    dated = F.count("published_at")
    s = one.groupBy("cluster").agg(
        F.count("*").alias("members"),
        F.when(dated >= 2, F.round(span, 6)).otherwise(F.lit(0.0)).alias("span_hours"),
        F.bool_or("_price").alias("_price"),
        F.max_by("id", F.struct(F.coalesce("published_at", F.lit("0001-01-01").cast("timestamp")), "id")).alias("_latest"),
        F.min_by("id", F.struct(F.coalesce("published_at", F.lit("9999-01-01").cast("timestamp")), "id")).alias("_earliest"),
    )
    low = edges.groupBy("cluster").agg(F.min("similarity").alias("_low"))
    kind = F.when((F.col("span_hours") <= price_hours) & F.col("_price"), "price_event").otherwise("analysis")
    s = s.where("members >= 2").join(low, "cluster", "left").withColumn("kind", kind).withColumn("min_similarity", F.coalesce("_low", F.lit(1.0)))
    primary = F.when(F.col("kind") == "price_event", F.col("_latest")).otherwise(F.col("_earliest"))
    return s.select("cluster", "members", "span_hours", "min_similarity", "kind", primary.alias("primary_id"), ((F.col("kind") == "analysis") & (F.col("min_similarity") < review)).alias("review"))


def cost_rollup(runs: DataFrame) -> DataFrame:
    """Cost in total, by task, and by task and agent, in one aggregation."""
    rows = runs.select(F.coalesce("task", F.lit("other")).alias("task"), F.coalesce("agent", F.lit("unknown")).alias("agent"), F.coalesce("cost", F.lit(0).cast("decimal(18,6)")).alias("cost"))
    out = rows.rollup("task", "agent").agg(F.sum("cost").alias("cost"), F.count("*").alias("runs"), F.grouping_id().alias("level"))
    return out.select("task", "agent", F.col("level").cast("int").alias("level"), F.round(F.col("cost").cast("double"), 6).alias("cost"), "runs")


def day_cost(runs: DataFrame, cap: float) -> DataFrame:
    """Cost per day against a cap."""
    total = F.sum(F.coalesce("cost", F.lit(0).cast("decimal(18,6)"))).cast("double")
    out = runs.groupBy(F.to_date("created_at").alias("day")).agg(F.round(total, 6).alias("cost"))
    return out.select("day", "cost", F.round(F.col("cost") / cap * 100, 2).alias("percent"), (F.col("cost") > cap).alias("over"))


def distribution(rows: DataFrame, by: str, missing: str = "unlabelled") -> DataFrame:
    """Counts per value, nulls by name, with the share of all rows."""
    got = rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit(missing)).alias(by)).agg(F.count("*").alias("n"))
    return got.select(by, "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2).alias("percent"))


def bias_spread(articles: DataFrame) -> DataFrame:
    """Articles per lean; every lean has a row."""
    spine = articles.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("left", "center", "right", "unknown")])).alias("lean"))
    got = articles.groupBy(F.coalesce(balance.normalise_bias(F.col("bias")), F.lit("unknown")).alias("lean")).agg(F.count("*").alias("n"))
    return spine.join(got, "lean", "left").select("lean", F.coalesce("n", F.lit(0)).alias("n"))


def source_balance(articles: DataFrame, by: list[str]) -> DataFrame:
    """Skew and one-sidedness per group; every distinct source votes once, with the first lean seen."""
    votes = articles.groupBy(*by, "source_id").agg(F.min_by(balance.normalise_bias(F.col("bias")), F.col("id")).alias("lean"))
    counts = votes.groupBy(*by).agg(F.count("*").alias("sources"), *[F.count_if(F.col("lean") == x).alias(f"n_{x}") for x in ("left", "center", "right")])
    placed = F.col("n_left") + F.col("n_center") + F.col("n_right")
    return counts.select(*by, "sources", "n_left", "n_center", "n_right", balance.skew(F.col("n_left"), F.col("n_right"), placed).alias("skew"), balance.coverage(F.col("n_left"), F.col("n_right"), F.col("n_center")).alias("coverage"))


def majority(rows: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """The commonest non-null value of each group, the first met on ties."""
    n = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(position).alias("at"))
    return n.groupBy(group).agg(F.max_by(value, F.struct("n", (-F.col("at")).alias("o"))).alias(value))


def cluster_category(rows: DataFrame, group: str, value: str, rank: str) -> DataFrame:
    """The commonest category; a tie goes to the category of the top-ranked row, and if that is null to the first leader."""
    n = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(rank).alias("at"))
    top = n.groupBy(group).agg(F.max("n").alias("n"))
    leaders = n.join(top, [group, "n"]).groupBy(group).agg(F.count("*").alias("leaders"), F.min_by(value, "at").alias("leader"))
    first = rows.groupBy(group).agg(F.min_by(value, rank).alias("first"))
    return first.join(leaders, group, "left").select(group, F.when(F.col("leaders") == 1, F.col("leader")).otherwise(F.coalesce("first", "leader")).alias(value))


def window_audit(articles: DataFrame, now: Column, fresh_hours: float = 6, by: list[str] | None = None) -> DataFrame:
    age = (F.unix_micros(now) - F.unix_micros("published_at")) / 3.6e9
    rows = articles.where("published_at is not null").withColumn("_age", age)
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(F.max("_age"), 3).alias("oldest"), F.round(F.min("_age"), 3).alias("newest"), F.count_if(F.col("_age") <= fresh_hours).alias("fresh"))


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per model from tokens and prices per million; unknown models cost nothing."""
    rows = usage.join(sized(prices), "model", "left")
    cost = F.coalesce(F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out"), F.lit(0.0))
    return rows.groupBy("model").agg(F.round(F.sum(cost), 6).alias("cost"), F.count("*").alias("calls"))


def centroid(vectors: DataFrame, group: str, vector: str = "embedding", digits: int = 9) -> DataFrame:
    """The mean vector of each group, dimension by dimension, rounded once."""
    parts = vectors.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("d", "x"))
    means = parts.groupBy(group, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: F.round(p["m"], digits)).alias("centroid"))


def step_status(steps: DataFrame, by: list[str]) -> DataFrame:
    """partial where any run of the group failed."""
    failed = F.count_if(F.col("status") != "success")
    return steps.groupBy(*by).agg(F.count("*").alias("runs"), failed.alias("errors"), F.when(failed > 0, "partial").otherwise("success").alias("status"))


def fetch_status(failures: DataFrame, by: list[str], shown: int = 10) -> DataFrame:
    """Status and error text of fetching steps, from rows (source, kind, at) of which kind is null, ``fetch`` or ``insert``.

    The first ``shown`` names of sources that failed to be fetched are listed, in order of time, then name.
    """
    feeds, inserts = F.count_if(F.col("kind") == "fetch"), F.count_if(F.col("kind") == "insert")
    counts = failures.groupBy(*by).agg(F.count("*").alias("runs"), feeds.alias("feed_errors"), inserts.alias("insert_errors"))
    # The names are cut by rank before they are gathered, so no group is held whole.
    failed = failures.where("kind = 'fetch'").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(by)], "at", "source")
    keys = [f"_k{i}" for i in range(len(by))]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "source"))
    names = failed.withColumn("_n", rank).where(F.col("_n") <= shown).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "source"))), lambda x: x["source"]), ", ").alias("names"))
    on = [F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(k) for c, k in zip(by, keys, strict=True)]
    bad = (F.col("feed_errors") > 0) | (F.col("insert_errors") > 0)
    error = F.concat(F.col("feed_errors").cast("string"), F.lit(" source(s) failed to fetch, "), F.col("insert_errors").cast("string"), F.lit(" insert error(s)"))
    return counts.join(names, on, "left").select(*by, "runs", F.when(bad, "partial").otherwise("success").alias("status"), F.when(bad, error).alias("error"), "names")


def ordered_ids(rows: DataFrame, group: str, id_col: str, position: str) -> DataFrame:
    """Each group's distinct ids in the order of their first occurrence."""
    first = rows.groupBy(group, id_col).agg(F.min(position).alias("at"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", id_col))), lambda x: x[id_col]).alias("ids"))


def thin_day(briefs: DataFrame, qualifying: str = "qualifying", least: int = 3) -> DataFrame:
    q = F.col(qualifying)
    status = F.when(q >= least, "normal").when(q >= 1, "quiet").otherwise("skip: quiet_day_no_articles")
    return briefs.withColumn("status", status).withColumn("min_themes", F.when(q >= least, least).when(q >= 1, 1).otherwise(0))


#: Steps whose runs count for health, statuses of a failed run, and statuses of a writer that rightly wrote nothing.
ENGINES = ["fetcher", "classifier", "deduplicator", "analyst", "writer"]
BAD = ["partial", "error", "failed"]
SKIPPED = ["quiet_day_no_articles", "no_clusters"]


def run_health(slots: DataFrame, runs: DataFrame, briefs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(slot, severity, stage, detail): what was wrong in each slot (slot, start, end); a healthy one has no row.

    runs: agent, status, error, created_at, run_id; briefs: brief, created_at; deliveries: brief.
    A slot without a run of any engine has that alone. Otherwise every failed run is an
    alert; no brief is one too, unless the writer said that it skipped (information);
    and so is a newest brief that nobody was sent. Slots meet rows by their days.
    """
    days = slots.select("slot", "start", "end", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("_day"))

    def within(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_day", F.to_date("created_at")).join(days, "_day").where((F.col("created_at") >= F.col("start")) & (F.col("created_at") < F.col("end")))

    own = within(runs.where(F.col("agent").isin(ENGINES)))
    status = F.lower(F.coalesce("status", F.lit("")))
    failed = own.where(status.isin(BAD)).select("slot", F.lit("alert").alias("severity"), F.col("agent").alias("stage"), F.concat(status, F.lit(": "), F.coalesce("error", F.lit("no detail"))).alias("detail"))
    skip = F.when((F.col("agent") == "writer") & F.col("status").isin(SKIPPED), F.struct("created_at", "run_id", "status"))
    fired = own.groupBy("slot").agg(F.max(skip).alias("skip"))
    newest = within(briefs).groupBy("slot").agg(F.max_by("brief", F.struct("created_at", "brief")).alias("brief"))
    sent = deliveries.select("brief", F.lit(True).alias("sent")).distinct()
    state = slots.select("slot").join(fired.withColumn("fired", F.lit(True)), "slot", "left").join(newest, "slot", "left").join(sent, "brief", "left")
    idle, none = F.col("fired").isNull(), F.col("brief").isNull()
    found = F.when(idle, F.struct(F.lit("alert").alias("severity"), F.lit("pipeline").alias("stage"), F.lit("no engine runs recorded since the slot start").alias("detail")))
    found = found.when(none & F.col("skip").isNotNull(), F.struct(F.lit("info").alias("severity"), F.lit("writer").alias("stage"), F.concat(F.lit("no brief (writer status="), F.col("skip.status"), F.lit(")")).alias("detail")))
    found = found.when(none, F.struct(F.lit("alert").alias("severity"), F.lit("writer").alias("stage"), F.lit("no fresh brief produced").alias("detail")))
    found = found.when(F.col("sent").isNull(), F.struct(F.lit("alert").alias("severity"), F.lit("delivery").alias("stage"), F.lit("brief built but not recorded as delivered").alias("detail")))
    return failed.unionByName(state.select("slot", found.alias("x")).where("x is not null").select("slot", "x.*"))


def funnel(stages: list[tuple[str, DataFrame]], by: str) -> DataFrame:
    """(by, stage, n) in long form for rows at each stage (each has ``by`` and one row an item); a stage without rows of a group counts 0."""
    counts = None
    for at, (name, rows) in enumerate(stages):
        part = rows.groupBy(by).agg(F.count("*").alias("n")).select(by, F.lit(at).alias("at"), F.lit(name).alias("stage"), "n")
        counts = part if counts is None else counts.unionByName(part)
    names = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(name).alias("stage")) for i, (name, _) in enumerate(stages)])
    every = counts.select(by).distinct().select(by, F.explode(names).alias("s")).select(by, "s.at", "s.stage")
    return every.join(counts, [by, "at", "stage"], "left").select(by, "stage", F.coalesce("n", F.lit(0)).alias("n"))
