"""SuperMinHash near-duplicates against exact comparison of all pairs."""

import random

import numpy as np
import pytest

from gazetta.llm.near_dup import band_plan, drop_near_duplicates, near_duplicates, shingle_set, superminhash
from gazetta.llm.common import WordIds

SCHEMA = "doc_id long, text string, component_id string"


def exact(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if (both and 100 * both >= percent * either) or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        named = [x for x in groups[find(i)] if x is not None]
        out.append((r[0], len(sets[i]), min(named) if named else None))
    return sorted(out, key=str)


def corpus(seed, groups=12, copies=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(2, 120))]
        for c in range(copies):
            t = list(base)
            for _ in range(c // 2):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t).title() if c % 5 == 1 else "\t".join(t), "x"))
            n += 1
    return rows + [(n, None, None), (n + 1, "", "x"), (n + 2, " \n ", "x"), (n + 3, "one", "x"), (n + 4, "ONE", "x"), (3, rows[3][1], "x")]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_match_all_pairs(spark, k, percent):
    rows = corpus(k)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), k, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == exact(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chain_of_edits_is_one_component(spark):
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(30):
        words[i * 5] = f"new{i}"
        rows.append((i, " ".join(words), "x"))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert {r.component_id for r in got} == {0}


def test_null_ids_and_empty_table(spark):
    t = "a b c d e f g h"
    got = near_duplicates(spark.createDataFrame([(None, t, "x"), (None, t, "x"), (7, t, "x"), (None, "z y", "x")], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(None, 7, False), (None, 7, False), (7, 7, True), (None, None, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_a_group_stays(spark):
    t = "a b c d e f g h i j"
    rows = [(1, t, "p"), (1, t, "p"), (2, t.upper(), "q"), (3, "other words entirely here now", "r"), (None, "null id stays", "s")]
    got = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text, r.component_id) for r in got) == sorted([("1", t, "p"), ("3", rows[3][1], "r"), ("None", rows[4][1], "s")])


def test_signatures_estimate_similarity():
    ids, rng = WordIds(), random.Random(3)
    a = [b"x%d" % rng.randrange(10**6) for _ in range(300)]
    b = a[:240] + [b"y%d" % i for i in range(60)]
    x, y = (shingle_set(w, 3, ids) for w in (a, b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    s = superminhash([x, y])
    assert abs((s[0] == s[1]).mean() - true) < 0.15
    assert (superminhash([y])[0] == s[1]).all()


def test_bands_miss_at_most_one_in_ten_thousand():
    for percent in (80, 85, 95):
        bands, rows = band_plan(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-4


def test_rows_that_share_an_id_are_told_apart(spark):
    t = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(3, t), (5, "a unique text of its own that nobody else has"), (5, t + " x"), (9, "alpha beta gamma delta epsilon zeta"), (9, "quite other words are in this one row"), (None, t.upper()), (None, t), (None, "  "), (None, "  "), (9, "alpha beta gamma delta epsilon zeta")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _id int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in drop_near_duplicates(docs).collect())
    assert got == sorted([(3, t), (5, rows[1][1]), (9, rows[3][1]), (9, rows[4][1]), (-1, "  "), (-1, "  ")])
    assert drop_near_duplicates(docs).columns == ["doc_id", "text", "_id"]
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_a_group_without_an_id_keeps_one_row(spark):
    t = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, t), (None, t), (None, t + " eleven"), (None, t.upper())], "doc_id long, text string")
    assert len(drop_near_duplicates(docs).collect()) == 1


def test_a_bucket_of_copies_and_few_others_costs_rows_times_others(spark):
    from pyspark.sql import functions as F

    from gazetta.llm.near_dup import _hubs, _top_labels

    live = spark.range(2005).select(F.lit(7).alias("bucket"), F.col("id").alias("node"), F.lit(50).alias("n"), F.lit(1).alias("rank"), F.lit(2005).alias("k"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("label"))
    tops = _top_labels(live)
    assert tops.first()["outside"] == 5 and tops.first()["pairs"] == 2000 * 5 + 10
    for share, last in ((16, False), (4, True)):
        hubs, closed = _hubs(live, tops, share, last)
        assert hubs.count() == 5 and closed.count() == 1
        assert live.join(hubs, "bucket").count() < 20_000
    hubs, closed = _hubs(live, tops, 4, False)
    assert hubs.count() < 20 and closed.count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text of five words here")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
