"""Parallel selections against plain sequential statements of their rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gazetta.operators import graphs, greedy, windows


def themes(rows, most):
    """rows: (id, rank, topics); the rule, one article after the other."""
    def overlap(a, b):
        n = len(set(a) & set(b))
        return n >= 2 or (n == 1 and min(len(set(a)), len(set(b))) <= 2)

    rows, seed = sorted(rows, key=lambda r: r[1]), {}
    for k, (i, _, t) in enumerate(rows):
        if i in seed:
            continue
        seed[i], n = i, 1
        for j, _, u in rows[k + 1 :]:
            if n == most:
                break
            if j not in seed and t and overlap(t, u):
                seed[j], n = i, n + 1
    return seed


@pytest.mark.parametrize("seed", range(4))
def test_topic_themes(spark, seed):
    rng = random.Random(seed)
    rows = [(i, r, rng.sample("abcdefghijklmnopqrst", rng.randint(0, 4))) for i, r in enumerate(rng.sample(range(1000), 120))]
    got = greedy.topic_themes(spark.createDataFrame(rows, "id long, rank int, topics array<string>"), 4).collect()
    assert {r.id: r.seed for r in got} == themes(rows, 4)


@pytest.mark.parametrize(("seed", "block", "letters"), [(1, 12, 20), (3, 25, 40), (4, 20, 5)])
def test_topic_themes_in_blocks_and_scopes(spark, seed, block, letters):
    """Seeds stay open over blocks; scopes do not meet; nulls and repeated topics count as the rule says."""
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(letters)]
    rows = []
    for scope in ("x", "y", None):
        for i, r in enumerate(rng.sample(range(1000), 60)):
            topics = None if i == 5 else rng.choices(names, k=rng.randint(0, 5))
            rows.append((scope, {"x": 0, "y": 100, None: 200}[scope] + i, r, topics))
    df = spark.createDataFrame(rows, "brief string, id long, rank int, topics array<string>")
    got = greedy.topic_themes(df, 3, scope="brief", block=block).collect()
    want = {}
    for scope in ("x", "y", None):
        want |= themes([(i, r, t or []) for s, i, r, t in rows if s == scope], 3)
    assert {r.id: r.seed for r in got} == want and len(got) == len(rows)
    assert {(r.brief, r.id) for r in got} == {(s or "", i) for s, i, _, _ in rows}


def test_topic_themes_of_a_hot_topic(spark):
    """4,000 articles of one topic: as many rows, no pairs; and an empty table."""
    rows = [(i, i, ["hot"] if i % 2 else ["hot", f"own{i}", f"more{i}"]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, rank int, topics array<string>")
    got = {r.id: r.seed for r in greedy.topic_themes(df, 6, block=1500).collect()}
    assert got == themes(rows, 6)
    assert greedy.topic_themes(df.limit(0)).count() == 0


def test_places(spark):
    rows = [("ab"[i % 2] if i % 7 else None, i * 37 % 101) for i in range(101)]
    got = windows.placed(spark.createDataFrame(rows, "s string, x int").repartition(5), "s", F.desc("x")).collect()
    for scope in ("a", "b", None):
        mine = sorted((x for s, x in rows if s == scope), reverse=True)
        assert {r.x: r.place for r in got if r.s == scope} == {x: k + 1 for k, x in enumerate(mine)}


@pytest.mark.parametrize("seed", range(3))
def test_thin_highlights(spark, seed):
    rng = random.Random(seed)
    items = [(i, r) for i, r in enumerate(rng.sample(range(500), 60))]
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    got = greedy.thin_highlights(spark.createDataFrame(items, "id long, rank int"), spark.createDataFrame(sorted(pairs), "a long, b long")).collect()
    kept = set()
    for i, _ in sorted(items, key=lambda x: x[1]):
        if not any((min(i, j), max(i, j)) in pairs for j in kept):
            kept.add(i)
    assert {r.id for r in got if r.kept} == kept and len(got) == 60


@pytest.mark.parametrize("seed", range(5))
def test_quota(spark, seed):
    rng = random.Random(seed)
    rows = [(b, r, rng.choice(["c", "g", "t", "y", "p", None])) for b in ("x", "z") for r in range(rng.randint(1, 14))]
    got = windows.quota(spark.createDataFrame(rows, "brief string, cluster_rank int, bundle string"), "brief", 1, 2, 1.5, 14).collect()
    for brief in ("x", "z"):
        mine = [(r, b) for n, r, b in rows if n == brief]
        active = {b for _, b in mine if b}
        target = max(min(math.ceil(1.5 * len(active)), 14), len(active))
        taken, count = [], {}
        for r, b in mine:
            if b and count.get(b, 0) < 1:
                taken.append(r)
                count[b] = 1
        for r, b in mine:
            if len(taken) >= target:
                break
            if b and r not in taken and count[b] < 2:
                taken.append(r)
                count[b] += 1
        assert [x.cluster_rank for x in sorted((x for x in got if x.brief == brief), key=lambda x: x.position)] == sorted(taken)


@pytest.mark.parametrize("seed", range(3))
def test_backoff(spark, seed):
    rng = random.Random(seed)
    rows = [(g, i, rng.choice([None, *range(11)]), rng.choice([None, 0, 1, 1, 2])) for g in "abc" for i in range(rng.randint(1, 12))]
    got = windows.relevance_backoff(spark.createDataFrame(rows, "g string, id int, relevance int, actionability int"), "g", 6, 4, 3).collect()
    want = set()
    for g in "abc":
        for relax in range(3):
            ok = {(g, i) for n, i, rel, act in rows if n == g and ((act or 0) >= 2 or ((rel or 0) >= 1 and rel >= 6 - relax))}
            if len(ok) >= 3:
                break
        want |= ok
    assert {(r.g, r.id) for r in got} == want


@pytest.mark.parametrize("seed", range(3))
def test_diverse_top(spark, seed):
    rng = random.Random(seed)
    rows = [(r, rng.choice("abc")) for r in range(9)]
    got = windows.diverse_top(spark.createDataFrame(rows, "rank int, source_id string"), 5).orderBy("position").collect()
    first, rest = [], []
    for r, s in rows:
        (rest if s in [x[1] for x in first] else first).append((r, s))
    assert [(x.rank, x.source_id) for x in got] == (first + rest)[:5]


def test_representatives_golden(spark):
    rows = [("k", i, h, n, "tech", None) for i, h, n in (("a", 1, 100), ("b", 2, 900), ("c", 3, 200), ("d", 4, 800), ("e", 5, 300), ("ff", 6, 700), ("g", 7, 500))]
    df = spark.createDataFrame(rows, "cluster string, id string, published_at int, n_chars int, category string, lean string")
    assert {r.id for r in windows.representatives(df, 5).where("keep").collect()} == {"a", "g", "b", "d", "ff"}
    right = df.withColumn("lean", F.when(F.col("id") == "c", "right")).withColumn("category", F.lit("geo"))
    assert {r.id for r in windows.representatives(right, 5, ["geo"]).where("keep").collect()} == {"a", "g", "b", "d", "ff", "c"}


def test_components(spark):
    rng = random.Random(9)
    edges = [tuple(rng.sample(range(300), 2)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = graphs.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.cluster for r in got} == {n: find(n) for n in parent}
    assert graphs.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lsh_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 32))
    v = np.vstack([base, base + 0.2 * rng.normal(size=base.shape)])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    want = {(r.a, r.b) for r in graphs.similar_pairs(df, 0.9).collect()}
    got = {(r.a, r.b) for r in graphs.lsh_pairs(df, 0.9).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 40


def test_similar_pairs_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.a, r.b, r.similarity) for r in graphs.similar_pairs(df, 0.85).collect()] == [(1, 2, 1.0)]


def test_text_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        t = rng.choices(words, k=rng.randint(0, 40)) if i % 4 == 0 or not rows else list(rows[-1][1])
        if t and i % 4:
            t[rng.randrange(len(t))] = "zz"
        rows.append((i, t))

    def sets(t):
        return frozenset(tuple(t[k : k + 3]) for k in range(len(t) - 2)) if len(t) >= 3 else frozenset([tuple(t)] if t else [])

    first = {}
    for i, t in rows:
        first.setdefault(sets(t), i)
    first.pop(frozenset(), None)
    want = {(min(i, j), max(i, j)) for s, i in first.items() for u, j in first.items() if i != j and 100 * len(s & u) >= 85 * len(s | u)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows] + [(99, None)], "doc_id long, text string")
    assert {(r.a, r.b) for r in graphs.text_copies(df).collect()} == want


@pytest.mark.parametrize(("seed", "block", "top"), [(1, 10, 145), (2, 25, 145), (3, 10, 20), (5, 10, 0)])
def test_best_themes_are_those_of_all_articles(spark, seed, block, top):
    """The first clusters by score are whole, though a scope ends before its last block; scopes whose later articles count end later or not at all."""
    rng = random.Random(seed)
    rows, most, best = [], {"x": 3, "y": 4, "z": 2}, {"x": 2, "y": 3, "z": 50}
    for k, scope in enumerate(most):
        scores = sorted((rng.choice([5, 10, top]) if n < 90 else rng.randint(-1 if scope == "y" and seed == 2 else 0, 9) for n in range(150)), reverse=True)
        if seed == 3:
            rng.shuffle(scores)  # the rank need not follow the score
        rows += [(scope, 1000 * k + n, n, rng.choices("abcdefgh", k=rng.randint(0, 4)), s, most[scope], best[scope]) for n, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "s string, id long, rank int, topics array<string>, score int, most int, best int")
    got = greedy.topic_themes(df, F.col("most"), scope="s", block=block, best=F.col("best")).collect()
    for scope in most:
        mine = [r for r in rows if r[0] == scope]
        found = {}
        for whole, pairs in ((True, themes([r[1:4] for r in mine], most[scope]).items()), (False, [(r.id, r.seed) for r in got if r.s == scope])):
            groups = {}
            for i, s in pairs:
                groups.setdefault(s, []).append(mine[i % 1000])
            order = sorted(groups.items(), key=lambda g: (-sum(r[4] for r in g[1]), g[0]))
            found[whole] = [(s, sorted(r[1] for r in g)) for s, g in order][: best[scope]]
        assert found[True] == found[False], scope
    if top == 145:
        assert len(got) < len(rows)


def test_best_themes_end_where_nothing_can_change_them(spark):
    """20 blocks, of which the first two hold the best clusters and what they take; the others are not walked."""
    rows = [(i, i, [f"t{i % 7}", f"u{i % 7}"], 100 if i < 100 else 1) for i in range(1000)]
    got = greedy.topic_themes(spark.createDataFrame(rows, "id long, rank int, topics array<string>, score int"), 4, block=50, best=5).collect()
    assert len(got) <= 100 and {i: s for i, s in themes([r[:3] for r in rows], 4).items() if s < 5}.items() <= {r.id: r.seed for r in got}.items()
