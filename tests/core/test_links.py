"""Links counted without pairs, against all pairs; links of listing pages; error texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gazetta.functions import html, quantity, registry
from gazetta.operators import aggregates, graphs, joins, overlaps


def _linked(a, b):
    return len(a & b) >= 2 or (len(a & b) == 1 and min(len(a), len(b)) <= 2)


@pytest.mark.parametrize("subsets_to", [8, 3, 1])
def test_topic_links_are_those_of_all_pairs(spark, subsets_to):
    rng = random.Random(3)
    rows = [(i, "s" if i % 4 else None, [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))]) for i in range(150)]
    rows += [(200, "s", None), (201, "s", [None, "a", "a"]), (3, "s", rows[3][2]), (202, "t", ["a"])]
    df = spark.createDataFrame(rows, "id long, scope string, topics array<string>").withColumn("links", F.lit("clash"))
    got = overlaps.topic_links(df, scope="scope", subsets_to=subsets_to).collect()
    sets = [(i, s, {t for t in ts or [] if t}) for i, s, ts in rows]
    want = []
    for k, (i, s, ts) in enumerate(sets):
        alike = [j for j, s2, u in sets if s2 == s and u == ts]
        want.append((i, s, min(alike) if ts else i, sum(_linked(ts, u) for m, (_, s2, u) in enumerate(sets) if m != k and s2 == s)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("pairs_to", [16, 4, 2])
def test_overlaps_are_those_of_all_pairs(spark, pairs_to):
    rng = random.Random(6)
    rows = [(i, f"s{i % 2}", [rng.choice("abcdefghij") for _ in range(rng.randint(0, 7))]) for i in range(120)] + [(300, "s0", None)]
    sets = [(i, s, set(ts or [])) for i, s, ts in rows]
    want = {(i, j, len(x & y), s) for i, s, x in sets for j, t, y in sets if i < j and s == t and _linked(x, y)}
    got = joins.topic_overlap(spark.createDataFrame(rows, "id long, scope string, topics array<string>"), scope="scope", pairs_to=pairs_to).collect()
    assert len(got) == len(want) and {(r.a, r.b, r.shared, r.scope) for r in got} == want


@pytest.mark.parametrize("block", [3, 256])
def test_overlaps_of_copies_and_of_repeated_ids_are_those_of_the_join_by_topic(spark, block):
    rng = random.Random(8)
    base = [[], ["a"], ["a", "b"], ["a", "b", "c"], ["b", "c", "d", "e"], list("abcdefg")]
    rows = [(i, rng.choice(base)) for i in range(90)]
    rows += [(3, ["a", "b", "c"]), (3, ["a", "b", "c"]), (4, ["b", "c", "e"]), (4, ["c", "e", "f"]), (5, ["a"]), (5, ["a"]), (6, ["a"]), (6, ["b"]), (95, None)]
    want = Counter((i, j, len(x), len(y)) for i, x in rows for j, y in rows if i < j and x and y for t in x if t in y)
    want = sorted((i, j, s) for (i, j, n, m), s in want.items() if s >= 2 or n <= 2 or m <= 2)
    df = spark.createDataFrame(rows, "id long, topics array<string>")
    assert sorted(map(tuple, joins.topic_overlap(df, block=block, task_pairs=100).collect())) == want


def test_overlaps_of_a_hot_set_are_not_shuffled(spark):
    """Pairs are made after the last shuffle, in parts of like size, and none is grouped."""
    alike = spark.range(5_000).select("id", F.array(F.lit("hot"), F.lit("day"), F.lit("new")).alias("topics"))
    pairs = joins.topic_overlap(alike, task_pairs=1_000_000)
    assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
    parts = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 5_000 * 4_999 // 2
    assert max(r["count"] for r in parts) < 3_000_000
    assert pairs.where("a >= b or shared <> 3").count() == 0


def test_topic_links_of_a_hot_topic_and_of_nothing(spark):
    hot = spark.range(20_000).select("id", F.array(F.lit("hot"), F.concat(F.lit("x"), "id"), F.concat(F.lit("y"), "id")).alias("topics"))
    assert overlaps.topic_links(hot).agg(F.sum("links").alias("n")).first()["n"] == 0
    alike = spark.range(20_000).select("id", F.array(F.lit("hot"), F.lit("day")).alias("topics"))
    got = overlaps.topic_links(alike).select("class_id", "links").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 19_999)]
    assert overlaps.topic_links(alike.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [85, 50, 100])
def test_copy_links_are_those_of_all_pairs(spark, percent):
    rng = random.Random(9)
    base = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 60))] for _ in range(25)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice("abcdefghijklmnop")
        rows.append((i, " ".join(words + ["z"] * rng.randint(0, 3))))
    rows += [(500, None), (501, ""), (502, "! ?"), (503, rows[0][1].upper())]
    got = {r.doc_id: (r.class_id, r.copies, r.links) for r in graphs.copy_links(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    sets = {}
    for i, t in rows:
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else None
    want = {}
    for i, s in sets.items():
        alike = [j for j, t in sets.items() if s is not None and t == s]
        links = sum(1 for t in sets.values() if s is not None and t is not None and t != s and 100 * len(s & t) >= percent * len(s | t))
        want[i] = (min(alike), len(alike), links) if alike else (i, 1, 0)
    assert got == want


def test_listing_links_fall_back_on_null_only(spark):
    page = '<a href="https://x.y/1">One <b>long</b> title of a story</a><a href="/2">two</a>'
    rows = [(1, None, page), (2, "", page), (3, "[A title that is long enough](https://x.y/3)", page)]
    got = html.listing_links(spark.createDataFrame(rows, "id long, md string, html string"), "id", "md", "html").collect()
    assert sorted((r.id, r.via, r.rank, r.url) for r in got) == [(1, "html", 1, "https://x.y/1"), (3, "markdown", 1, "https://x.y/3")]


def test_a_feed_needs_an_address(spark):
    rows = [(True, "https://f", False), (True, "", True), (True, None, True), (False, "https://f", True), (None, "https://f", True)]
    got = spark.createDataFrame(rows, "feed boolean, url string, want boolean")
    assert got.where(html.is_listing(F.col("feed"), F.col("url")) != F.col("want")).count() == 0


def test_fetch_status(spark):
    rows = [("a", k, f"s{k}", "fetch") for k in range(12)] + [("a", 99, "s99", "insert"), ("b", 1, "x", None), (None, 1, "y", "insert")]
    got = {r.step: tuple(r)[1:] for r in aggregates.fetch_status(spark.createDataFrame(rows, "step string, at long, source string, kind string"), ["step"]).collect()}
    assert got == {
        "a": (13, "partial", "12 source(s) failed to fetch, 1 insert error(s)", ", ".join(f"s{k}" for k in range(10))),
        "b": (1, "success", None, None),
        None: (1, "partial", "0 source(s) failed to fetch, 1 insert error(s)", None),
    }


def test_quantities_for_sql_users(spark):
    registry.register(spark)
    texts = ["up 1,200.5 million", "-3k", "5 t of grain", "none", "", None, "2bn!"]
    spark.createDataFrame([(t,) for t in texts], "text string").createOrReplaceTempView("quantity_texts")
    got = spark.sql("SELECT text, parse_quantity(text) AS q FROM quantity_texts")
    assert got.where(~F.col("q").eqNullSafe(quantity.amount(F.col("text")))).count() == 0
    assert [r.q for r in got.collect()] == [1.2005e9, -3000.0, 5.0, None, None, None, 2e9]


def test_text_copies_write_a_part_of_their_sets(spark):
    """Sets of texts without copies are neither shuffled nor written: what is kept of them is under half of their shingles."""
    from pathlib import Path

    from gazetta.session import stash_dir

    def used():
        return sum(p.stat().st_size for p in Path(stash_dir(spark)).rglob("*.parquet"))

    rng = random.Random(2)
    rows = [(i, "a common line of all " + " ".join(str(rng.random())[2:] for _ in range(400))) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[1][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{stash_dir(spark)}/start-{rng.random()}")
    before = used()
    assert [(r.a, r.b) for r in graphs.text_copies(df).collect()] == [(1, 301)]
    assert used() - before < 4 * 403 * 302


def test_common_shingles_change_no_pair(spark, monkeypatch):
    """Which shingles are known as common is drawn from a few texts: any draw gives the same pairs."""
    rng = random.Random(5)
    base = [[rng.choice("abcdefg") for _ in range(rng.randint(5, 40))] for _ in range(12)]
    rows = [(i, " ".join([*rng.choice(base), *rng.choice(["", "x", "y z"]).split()])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real, got = graphs._common_shingles, []
    for more in ({}, {"sample": 5}, {"most": 3}, {"most": 0}):
        monkeypatch.setattr(graphs, "_common_shingles", lambda *x, more=more: real(*x, **more))
        got.append(sorted(map(tuple, graphs.text_copies(df, 60).collect())))
    assert got[0] and all(x == got[0] for x in got)


def test_equal_copies_are_in_the_clusters_of_representatives(spark, tmp_path):
    """Equal shingles link documents without a near text beside them, and every copy of a class that a near text links is in the cluster."""
    from gazetta.queries import QUERIES

    far = [" ".join(f"{c}{k}" for k in range(100)) for c in "pqrs"]
    swapped = lambda k, n: " ".join(f"x{j}" if k <= j < k + n else w for j, w in enumerate(far[3].split())) + " tail"
    # 20 and 22 share 94 of 102 shingles, 24 and 25 share 91 of 106.
    texts = {10: far[0], 11: far[0].upper(), 12: far[0] + "!", 13: far[1], 20: far[2], 21: far[2] + " ?", 22: far[2].replace("r50 r51", "x y"), 23: None, 26: "", 27: None, 24: far[3], 25: swapped(50, 5), 28: swapped(50, 5)}
    spark.createDataFrame([(i, t, "en", "src0", len(t or "") + i) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i) for i in texts], "event_id long, t long").selectExpr("event_id", "timestamp_seconds(t) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    for name, rows, schema in [
        ("supplier", [(1, 0, "S")], "s_suppkey long, s_nationkey long, s_name string"),
        ("nation", [(0, 0)], "n_nationkey long, n_regionkey long"),
        ("region", [(0, "ASIA")], "r_regionkey long, r_name string"),
        ("labels", [(13, 1, 0)], "doc_id long, quality int, toxic int"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted((r.cluster, r.id, r.keep) for r in QUERIES["h05_representative_job"](spark, str(tmp_path)).collect())
    # Each cluster keeps its earliest and latest; the one with a pair under 0.86 keeps all.
    assert got == [(10, 10, True), (10, 11, False), (10, 12, True), (20, 20, True), (20, 21, False), (20, 22, True), (24, 24, True), (24, 25, True), (24, 28, True)]
