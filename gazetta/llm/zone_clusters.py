"""Centroid clustering over space-filling-curve zone maps.

Vectors become whole numbers, floor(scale * x), and are put in the order of
a Hilbert curve over the components that vary most. Consecutive vectors form
blocks, each with the least and the greatest value of every component: its
box. Every round tests the centroids against the boxes first: the least
distance from a centroid to a box and the greatest tell which centroids can
be nearest to any vector of the block. Only those candidates are compared
with the block's vectors, exactly. Blocks are written once and read in every
round; a task returns sums per cluster, so what reaches the driver are the
centroids, whose number is a parameter.

Results don't depend on blocks, boxes or the curve. Left out are vectors
that are null, have another length than ``width`` or hold components that
are null, not finite, or of 2**27 or more after scaling, whose squared
distances no long would hold. Rows that share an id each count on their own;
a row without an id is clustered, but starts no centroid. With fewer vectors
than ``k`` there are as many centroids as vectors; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetta.llm.common import slices
from gazetta.session import stash

LIMIT = 1 << 27
ROWS = "vec_id long, w binary"
BLOCK = "ids binary, known binary, w binary, low binary, high binary"


def whole_vectors(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept, w): which rows hold a sound vector, and floor(scale * x) of those."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_list(lists.type):
        lists = lists.cast(pa.large_list(lists.type.value_type))
    starts, sizes = np.asarray(lists.offsets)[:-1], np.diff(np.asarray(lists.offsets))
    fits = np.flatnonzero((sizes == width) & np.asarray(lists.is_valid()))
    if not len(fits):
        return fits, np.empty((0, width), np.int32)
    values = lists.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        w = np.floor(values[starts[fits][:, None] + np.arange(width)] * scale)
        sound = (np.abs(w) < LIMIT).all(axis=1)
    return fits[sound], w[sound].astype(np.int32)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows, dimensions) with coordinates of ``bits`` bits.

    Coordinates are turned to Gray-coded digits of the curve from the highest bit
    down: where a bit is set the first coordinate's lower bits are mirrored, else
    they change places with this coordinate's.
    """
    x = cells.T.astype(np.int64)
    for b in range(bits - 1, 0, -1):
        lower = (1 << b) - 1
        for i in range(len(x)):
            mirrored = (x[i] >> b) & 1 == 1
            swap = np.where(mirrored, 0, (x[0] ^ x[i]) & lower)
            x[0] ^= np.where(mirrored, lower, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> b) & 1)
    return key


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids, ascending, that can be nearest to a vector within the box."""
    lo, hi, c = low.astype(np.int64), high.astype(np.int64), centroids
    below, above = lo - c, c - hi
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest(w: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the first nearest centroid of every row, in whole numbers."""
    span = max(int(np.abs(w).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 8 * w.shape[1] * span**2 < 1 << 53:  # all terms are exact in doubles, which multiply faster
        x, c = w.astype(np.float64), centroids.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(d)), at].astype(np.int64)
    x = w.astype(np.int64)
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(d)), at]


def _matrix(value: bytes, width: int) -> np.ndarray:
    return np.frombuffer(value, np.int32).reshape(-1, width)


def _whole(width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            kept, w = whole_vectors(batch.column("vector"), width, scale)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").take(pa.array(kept)), "w": pa.array([x.tobytes() for x in w], pa.binary())})

    return run


def _spread(width: int):
    """One row a task: rows, sums and squares, least and greatest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(width), np.zeros(width)
        low, high = np.full(width, LIMIT, np.int64), np.full(width, -LIMIT, np.int64)
        for batch in slices(batches, 4096):
            w = _matrix(b"".join(batch.column("w").to_pylist()), width)
            if len(w):
                n, total, squares = n + len(w), total + w.sum(axis=0), squares + (w.astype(np.float64) ** 2).sum(axis=0)
                low, high = np.minimum(low, w.min(axis=0)), np.maximum(high, w.max(axis=0))
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tolist()], "squares": [squares.tolist()], "low": [low.tolist()], "high": [high.tolist()]})

    return run


def _keyed(width: int, axes: list[int], low: np.ndarray, high: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.maximum(high - low, 1)[axes].astype(np.float64)
        for batch in slices(batches, 4096):
            w = _matrix(b"".join(batch.column("w").to_pylist()), width)[:, axes]
            cells = np.minimum((w - low[axes]) / span * (1 << bits), (1 << bits) - 1).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"key": pa.array(hilbert_keys(cells, bits)), "vec_id": batch.column("vec_id"), "w": batch.column("w")})

    return run


def _blocks(width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            w, ids = _matrix(b"".join(table.column("w").to_pylist()), width), table.column("vec_id")
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy().astype(np.int64)
            row = (ids.tobytes(), known.tobytes(), w.tobytes(), w.min(axis=0).tobytes(), w.max(axis=0).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["ids", "known", "w", "low", "high"])

        have = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - have)
                held.append(part)
                at, have = at + part.num_rows, have + part.num_rows
                if have == rows:
                    yield made(held)
                    held, have = [], 0
        if have:
            yield made(held)

    return run


def _placed(row: dict, width: int, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, cluster, distance) of a block."""
    w = _matrix(row["w"], width)
    near = candidates(np.frombuffer(row["low"], np.int32), np.frombuffer(row["high"], np.int32), centroids)
    at, d = nearest(w, centroids[near])
    return w, near[at], d


def _sums(width: int, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                w, cluster, _ = _placed(row, width, centroids)
                count += np.bincount(cluster, minlength=k)
                np.add.at(total, cluster, w)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(count[used]), "total": pa.array(total[used].tolist(), pa.list_(pa.int64()))})

    return run


def _assigned(width: int, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                _, cluster, d = _placed(row, width, centroids)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["known"], bool))
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(d, pa.int64())})

    return run


def zone_blocks(rows: DataFrame, width: int, axes: int = 8, bits: int = 6, block_rows: int = 512) -> DataFrame:
    """Whole vectors (vec_id, w) as blocks along a Hilbert curve over the ``axes`` components of greatest variance, each with its box."""
    parts = rows.mapInArrow(_spread(width), "n long, total array<double>, squares array<double>, low array<long>, high array<long>").where("n > 0")
    columns = [F.sum("n").alias("n")]
    columns += [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("total", F.sum), ("squares", F.sum), ("low", F.min), ("high", F.max)) for i in range(width)]
    got = parts.agg(*columns).first()
    n = got["n"] or 0
    if not n:
        return rows.sparkSession.createDataFrame([], BLOCK)
    mean = np.array([got[f"total{i}"] for i in range(width)]) / n
    variance = np.array([got[f"squares{i}"] for i in range(width)]) / n - mean**2
    low, high = (np.array([got[f"{c}{i}"] for i in range(width)]) for c in ("low", "high"))
    chosen = sorted(np.argsort(-variance, kind="stable")[:axes].tolist())
    keyed = rows.mapInArrow(_keyed(width, chosen, low, high, bits), "key long, vec_id long, w binary")
    ordered = keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id")
    return stash(ordered.select("vec_id", "w").mapInArrow(_blocks(width, block_rows), BLOCK))


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def zone_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, prefix: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) per kept vector, the final centroids).

    The ``k`` vectors with the smallest SHA-256 of ``prefix`` and their id start as centroids 0, 1, ...;
    vectors that share an id follow their bytes. Each round moves every
    non-empty centroid to the floor of its vectors' mean.
    """
    found = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = stash(found.mapInArrow(_whole(width, scale), ROWS))
    digest = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.where("vec_id is not null").orderBy(digest, "w").limit(k).collect()
    centroids = _matrix(b"".join(bytes(r.w) for r in first), width).astype(np.int64)
    blocks = zone_blocks(rows, width)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
    for _ in range(rounds):
        moved = blocks.mapInArrow(_sums(width, centroids), "cluster int, n long, total array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect()
        centroids = centroids.copy()
        for r in moved:
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(width)]
    return blocks.mapInArrow(_assigned(width, centroids), "vec_id long, cluster int, distance long"), centroids
