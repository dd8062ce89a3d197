"""Decontamination against the alignment of all pairs, crowded phrases, and samples that must not come out empty."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazetta.llm import decontaminate
from gazetta.llm.common import bounded_sample
from gazetta.llm.decontaminate import Tokens, contaminated, drop_contaminated, needed, overlap
from gazetta.llm.langid import fit_languages, predict_languages
from gazetta.session import stash


def all_pairs(docs, items):
    """Every diagonal of every pair: {(doc_id, item_id): (matches, start, length, item tokens)}."""
    read, best = Tokens(), {}
    for d, text in docs:
        doc = read.text(text.encode()).view(np.int64) if text else np.empty(0, np.int64)
        for i, passage in items:
            item = read.text(passage.encode()).view(np.int64) if passage else np.empty(0, np.int64)
            for diagonal in range(-len(item) + 1, len(doc)):
                start, length, matches = overlap(doc, item, diagonal)
                if len(item) and matches >= needed(len(item), 13, 0.75):
                    old = best.get((d, i), (0, 0, 0, 0))
                    best[d, i] = max(old, (matches, -start, length, len(item)))
    return {(*k, -s, n, m, t) for k, (m, s, n, t) in best.items()}


@pytest.mark.parametrize("crowd", [1, 64])
def test_whole_alignment_of_all_pairs(spark, crowd):
    rng = random.Random(crowd)
    words = [f"w{i}" for i in range(900)]
    phrase = rng.choices(words, k=9)
    items = []
    for i in range(30):
        t = rng.choices(words, k=rng.choice([4, 12, 20, 45, 150]))
        if i % 3 == 0 and len(t) > 12:
            t[5:5] = phrase
        items.append((i // 2 if i > 27 else i, " ".join(t)))
    items += [(40, items[2][1]), (41, None), (42, "")]
    docs = []
    for d in range(200):
        t = rng.choices(words, k=rng.randint(0, 120))
        if d % 3 == 0:
            t += phrase
        if d % 4 == 0:
            p = rng.choice(items[:28])[1].split()
            for at in range(rng.randint(3, 9), len(p), rng.choice([4, 6, 30])):
                p[at] = "SUB"
            # Long passages with poor middles reach far beyond the seeds.
            if len(p) > 100 and d % 8 == 0:
                p[50:70] = rng.choices(words, k=20)
            at = rng.randint(0, len(t))
            t[at:at] = p
        docs.append((d if d % 50 else 7, " ".join(t)))
    df = spark.createDataFrame([(*r, -1, "x") for r in docs], "doc_id long, text string, start int, item_key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in contaminated(df, bench, crowd=crowd).collect()}
    want = all_pairs(docs, items)
    assert got == want and len(want) > 40
    left = drop_contaminated(df, bench, crowd=crowd)
    hit = {d for d, text in docs if all_pairs([(0, text)], items)} if crowd == 1 else None
    assert left.columns == df.columns
    if hit is not None:
        assert sorted(r.text for r in left.collect()) == sorted(t for d, t in docs if not all_pairs([(0, t)], items))


def test_a_phrase_that_all_hold_makes_no_pairs(spark, monkeypatch):
    """2,000 items and 2,000 documents that share seven tokens in a row: 4 million pairs by that seed alone."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40_000)]
    phrase = rng.choices(words, k=7)

    def around(n):
        t = rng.choices(words, k=n)
        t[n // 2 : n // 2] = phrase
        return t

    items = [(i, " ".join(around(24))) for i in range(2000)]
    docs = [(d, " ".join(around(40))) for d in range(2000)] + [(5000, "lead in " + items[77][1] + " end")]
    seen = []
    real = decontaminate._lines

    def counted(*args):
        seen.append(stash(real(*args)))
        return seen[-1]

    monkeypatch.setattr(decontaminate, "_lines", counted)
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.matches) for r in got] == [(5000, 77, 31)]
    assert seen[0].count() < 50_000


@pytest.mark.parametrize("most", [1, 3, 150])
def test_sample_of_a_large_table_is_never_empty(spark, most):
    got = bounded_sample(spark.range(400_000), F.col("id"), most).count()
    assert most / 8 < got <= most


def test_sample_of_equal_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, F.lit(None)).otherwise(F.col("id") % 3).alias("k"))
    assert bounded_sample(rows, F.col("k"), 100).count() == 100
    assert bounded_sample(rows, F.col("k"), 5000).count() == 5000


def test_no_language_is_lost(spark):
    """40 equal rows of each of four languages, three without ids, and one row of a fifth."""
    texts = {"aa": "alpha beta", "bb": "gamma delta", "cc": "épsilon zeta", "dd": "eta theta", "ee": "iota"}
    rows = [(i if x == "aa" else None, t, x) for x, t in texts.items() for i in range(1 if x == "ee" else 40)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=5, per_doc=2, steps=2)
    assert model.languages == sorted(texts)
    # Equal probabilities: the language that sorts first.
    tied = model.network
    for k in tied.p:
        tied.p[k] = np.zeros_like(tied.p[k])
    found = predict_languages(spark.createDataFrame([(1, "some text"), (1, "some text")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, round(r.score, 6)) for r in found] == [("aa", 0.2)] * 2
