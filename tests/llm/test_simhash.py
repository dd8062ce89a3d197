"""Fingerprints against plain Python, the tree against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from gazetta.llm import contracts
from gazetta.llm.simhash import LEVELS, Level, connecting_links, fingerprints, groups_within, shingle_hashes, simhash_duplicates


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    n = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]), seed=42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(values, most):
    """Least index of each value's component, by all pairs."""
    top = list(range(len(values)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [root(i) for i in range(len(values))]


def test_fingerprint_is_the_majority_of_all_shingles():
    rng = random.Random(1)
    texts = ["", "one", "one two", "É ß Three\tfour\x0bfive", "a " * 700, *[" ".join(rng.choices("ab cd Ef gh ij".split(), k=rng.randint(1, 900))) for _ in range(30)]]
    got = fingerprints([shingle_hashes(t.encode(), 3) for t in texts])
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("fields", LEVELS)
def test_every_close_pair_meets_once(fields):
    """For any two fingerprints within the bound, exactly one of them asks the other's cell, or they share one."""
    rng, level = np.random.default_rng(fields), Level(fields)
    x = rng.integers(0, 1 << 63, 200, np.uint64)
    y = x.copy()
    for i in range(200):
        for b in rng.choice(64, i % 3, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    ahead = np.flatnonzero(level.ahead & ~level.none)
    cx, cy = (level.cells(level.distances(v, 12345)) for v in (x, y))
    assert len(np.unique(level.cells(level.distances(x, 12345)))) > 20
    for a, b, own, other in ((i, i, cx, cy) for i in range(200)):
        asks = [int((level.asked(level.distances(v[a : a + 1], 12345), ahead)[2] == to[b]).sum()) for v, to in ((x, other), (y, own))]
        assert sum(asks) == (0 if own[a] == other[b] else 1)


def test_groups_within_a_leaf():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, np.uint64)
    values = np.unique(np.concatenate([base, *[base[:8] ^ (np.uint64(1) << rng.integers(0, 64, 8).astype(np.uint64)) for _ in range(40)]]))
    want = components_of([int(v) for v in values], 2)
    assert list(groups_within(values, 2, step=7)) == want


@pytest.mark.parametrize("leaf", [1, 4, 1024])
def test_tree_connects_what_all_pairs_connect(spark, leaf):
    """Chains, a dense ball of near copies, far values; leaves so small that cells are split down to single bits."""
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1}
    ball, at = rng.getrandbits(64), rng.getrandbits(64)
    for _ in range(80):
        values.add(ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(12)))
        at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        values.add(at)
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in connecting_links(fps, 2, leaf).collect()]
    assert all((a ^ b).bit_count() <= 2 or leaf > 1 for a, b in links)
    place = {v: i for i, v in enumerate(values)}
    top = list(range(len(values)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        x, y = sorted((root(place[a]), root(place[b])))
        top[y] = x
    assert [root(i) for i in range(len(values))] == components_of(values, 2)


def test_documents(spark, tmp_path):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 400))) for _ in range(60)]
    texts += [texts[3], texts[3].upper() + " \n", None, "", "  \t", *[t.rsplit(" ", 1)[0] + " end" for t in texts[:40]], "word " * 80_000]
    rows = [(i * 3 % 127, t, "en", "a", 1, -5) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[7], None, None, None, 1), (rows[9][0], "quite another text", "en", "b", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = contracts.fingerprint_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [plain_fingerprint(r[1]) for r in rows]
    label = components_of(fps, 2)
    least = {c: min((r[0] for r, x in zip(rows, label, strict=True) if x == c and r[0] is not None), default=None) for c in label}
    want = sorted(((r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, label, strict=True)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert simhash_duplicates(docs.limit(0)).count() == 0
