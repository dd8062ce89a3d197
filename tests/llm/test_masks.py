"""Every overlap that the verifier accepts leaves a seed."""

import random

import numpy as np
import pytest

from gazetta.llm.decontaminate import contaminated, masks, overlap


def seeded(same, n):
    return any((same[i : i + len(m)] | (np.array(list(m)) == "0")).all() for m in masks(n) for i in range(len(same) - len(m) + 1))


def accepted(same, n):
    """``same`` tells where a passage of an item of ``n`` tokens equals it."""
    item = np.arange(1, len(same) + 1)
    return overlap(np.where(same, item, 0), item, 0)[2] >= min(13, int(np.ceil(0.75 * n)))


@pytest.mark.parametrize("n", range(1, 12))
def test_all_patterns_of_short_items(n):
    for x in range(1 << n):
        same = (x >> np.arange(n)) & 1 == 1
        assert seeded(same, n) or not accepted(same, n), (n, same.astype(int))


def test_all_spacings_and_random_patterns():
    rng = np.random.default_rng(3)
    for n in range(12, 61):
        for every in range(2, 14):
            for first in range(every):
                same = np.arange(n) % every != first
                assert seeded(same, n) or not accepted(same, n), (n, every, first)
        for share in (0.68, 0.75, 0.85):
            for _ in range(60):
                same = rng.random(n) < share
                assert seeded(same, n) or not accepted(same, n), (n, same.astype(int))


def test_every_fifth_token_substituted_and_short_items(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    item = rng.choices(words, k=40)
    copy = [w if i % 5 else "SUB" for i, w in enumerate(item)]
    rows = [(1, " ".join(["x"] * 9 + copy + ["y"] * 9)), (2, "so one two three it is"), (3, "one three two"), (4, "a b c d e f"), (5, "a b c x d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "One two, three"), (2, "a b c d e f"), (3, "...")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == {(1, 0), (2, 1), (4, 2)}
