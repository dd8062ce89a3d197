"""The curve by its neighbours, boxes by their bound, clusters against plain Python."""

import hashlib
import math

import numpy as np
import pytest

from gazetta.llm import contracts
from gazetta.llm.zone_clusters import candidates, hilbert_keys, nearest, zone_clusters


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2), (4, 1)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_no_nearest_centroid_is_pruned():
    rng = np.random.default_rng(1)
    for _ in range(50):
        w = rng.integers(-50, 50, 4) + rng.integers(-5, 5, (30, 4))
        c = rng.integers(-60, 60, (12, 4))
        near = candidates(w.min(axis=0), w.max(axis=0), c)
        d = ((w[:, None] - c) ** 2).sum(axis=2)
        assert set(d.argmin(axis=1)) <= set(near)
        at, got = nearest(w.astype(np.int32), c[near])
        assert (near[at] == d.argmin(axis=1)).all() and (got == d.min(axis=1)).all()
    assert len(candidates(np.zeros(3), np.ones(3), np.array([[0, 0, 0], [90, 0, 0]]))) == 1


def test_large_components_stay_exact():
    w = np.array([[(1 << 27) - 1] * 64, [-(1 << 27) + 1] * 64], np.int32)
    at, d = nearest(w, -w.astype(np.int64))
    assert at.tolist() == [1, 0] and d.tolist() == [0, 0]
    assert nearest(w[:1], w[1:].astype(np.int64))[1].tolist() == [64 * (2 * ((1 << 27) - 1)) ** 2]


def plain(rows, k, rounds, width):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), np.array(x[1], np.int32).tobytes()))
    cents = [x[1] for x in named[:k]]

    def place(w):
        return min((sum((a - b) ** 2 for a, b in zip(w, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [place(w)[1] for _, w in kept]
        cents = [[sum(col) // len(col) for col in zip(*m, strict=True)] if (m := [w for (_, w), a in zip(kept, at, strict=True) if a == j]) else c for j, c in enumerate(cents)]
    placed = [(i, *reversed(place(w))) for i, w in kept]
    inertia = {j: sum(d for _, c, d in placed if c == j) for j in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in placed), key=str)


def vectors(n, copies):
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64) * 0.1]) for i in range(n)]
    rows += [(1000 + i, list(rows[2][1])) for i in range(copies)]  # a group of equal vectors
    rows += [(1500 + i, [-x for x in rows[2][1]]) for i in range(3)]
    return rows


@pytest.mark.parametrize(("n", "copies"), [(150, 120), (12, 0)])
def test_clusters_are_the_plain_ones(spark, tmp_path, n, copies):
    rows = vectors(n, copies)
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [math.nan] * 64), (2004, [math.inf] * 64), (2005, []), (2006, [9.0e30] * 64), rows[0], (3, rows[4][1]), (None, rows[5][1])]
    v = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, cluster string, w int")
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = contracts.centroid_clusters(spark, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    want = plain([r for r in rows if r[0] != 2006], 40, 5, 64)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_nothing_to_cluster(spark, tmp_path):
    v = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert contracts.centroid_clusters(spark, str(tmp_path)).count() == 0
    assert zone_clusters(v.limit(0))[0].count() == 0
