"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics are counted over whole texts in one pass. The fit uses a bounded
sample of labelled rows: each partition sums its normal equations, the sums
are solved once, and scores of a part that the regression has not seen are
counted in bins, over which isotonic regression is fitted. A null or empty
text has the statistics of an empty document; repeated rows get equal scores.
Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetta.llm.common import as_bytes, bounded_sample, slices
from gazetta.session import stash

#: Byte classes whose shares are statistics.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"", b"!", b"?", b"%", b"$", b"#", b"*", b"&", b"|", b"()[]{}<>", b"/\\_-+=~^`@")
N_STATS = len(CLASSES) + 1 + 11
FOURIER = 256
BINS = 1000


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(CLASSES) + 1))
    for i, chars in enumerate(CLASSES):
        out[list(chars), i] = 1
    out[128:, -1] = 1
    return out


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of statistics for each text."""
    counts = np.stack([np.bincount(np.frombuffer(t or b"", np.uint8), minlength=256) for t in texts]) if texts else np.zeros((0, 256))
    out = np.zeros((len(texts), N_STATS))
    out[:, : len(CLASSES) + 1] = np.sqrt(counts @ _class_matrix() / np.maximum(1, counts.sum(1, keepdims=True)))
    for i, t in enumerate(texts):
        words = (t or b"").split()
        n = len(words)
        if not n:
            continue
        tally = Counter(words)
        lines = [x for x in t.split(b"\n") if x]
        line_words = [x.count(b" ") + 1 for x in lines] or [0]
        lengths = np.fromiter(map(len, words), np.int64, n)
        repeats = sum(map(eq, words, words[1:]))
        upper = sum(map(bytes.isupper, words))
        out[i, len(CLASSES) + 1 :] = (
            np.log1p(n) / 8,
            np.log1p(len(t)) / 10,
            lengths.mean() / 10,
            lengths.std() / 10,
            (lengths > 20).mean(),
            len(tally) / n,
            max(tally.values()) / n,
            repeats / n,
            upper / n,
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(float(np.mean(line_words))) / 6,
        )
    return out


@dataclass(frozen=True)
class QualityModel:
    """Everything that a task needs to score: a few hundred KB, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        phi = np.sqrt(2 / self.weights.shape[1]) * np.cos(z @ self.weights + self.phases)
        return np.hstack([phi, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.beta):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<float>) over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = statistics(as_bytes(batch.column(1))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(stats), pa.list_(pa.float32()))], names=[id_col, "stats"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("stats", T.ArrayType(T.FloatType()))])
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").to_pylist(), np.float64).reshape(-1, N_STATS)


def _isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators."""
    blocks: list[list[float]] = []
    for yi, wi in zip(y, w, strict=True):
        blocks.append([yi, wi, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.empty(0)


def fit_quality(labelled: DataFrame, id_col: str = "doc_id", max_rows: int = 20_000, partitions: int = 8, ridge: float = 1e-4, seed: int = 7) -> QualityModel:
    """Fit on rows of (id, stats, label 0 or 1), a sample of ``max_rows`` at most. ``ridge`` is a share of the rows.

    A fifth of the sample, dealt by a hash of the id, calibrates the scores of the rest.
    """
    rows = labelled.where("label is not null and stats is not null")
    sample = bounded_sample(rows, F.col(id_col), max_rows).withColumn("cal", F.pmod(F.xxhash64(F.col(id_col), F.lit("calibrate")), F.lit(5)) == 0)
    sample = stash(sample.select("stats", F.col("label").cast("double").alias("label"), "cal").repartition(partitions))
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 1 / np.sqrt(2.0 * N_STATS), (N_STATS, FOURIER))
    phases = rng.uniform(0, 2 * np.pi, FOURIER)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(N_STATS), np.zeros(N_STATS)
        for batch in batches:
            x = _stacked(batch)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"n": [n], "s": pa.array([s]), "q": pa.array([q])})

    got = sample.mapInArrow(moments, "n long, s array<double>, q array<double>").collect()
    n = sum(r.n for r in got)
    if not n:
        return QualityModel(*[np.empty(0)] * 7)
    mean = sum(np.array(r.s) for r in got) / n
    scale = np.sqrt(np.maximum(sum(np.array(r.q) for r in got) / n - mean**2, 0)) + 0.02
    blank = QualityModel(mean, scale, weights, phases, np.empty(0), np.empty(0), np.empty(0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FOURIER + 1, FOURIER + 1)), np.zeros(FOURIER + 1)
        for batch in batches:
            phi, y = blank.fourier(_stacked(batch)), np.array(batch.column("label"))
            a, b = a + phi.T @ phi, b + phi.T @ y
        yield pa.RecordBatch.from_pydict({"a": pa.array([a.ravel()]), "b": pa.array([b])})

    # As many rows as partitions of the sample, of a fixed size each.
    def solved(part: DataFrame) -> np.ndarray:
        rows = part.select("stats", "label").mapInArrow(sums, "a array<double>, b array<double>").collect()
        a = sum(np.array(r.a) for r in rows).reshape(FOURIER + 1, FOURIER + 1)
        b = sum(np.array(r.b) for r in rows)
        reg = ridge * max(a[-1, -1], 1) * np.eye(FOURIER + 1)
        reg[-1, -1] = 1e-10  # the intercept is free
        return np.linalg.solve(a + reg, b)

    held = sample.where("cal")
    fitted = sample.where("not cal")
    if not held.limit(1).count() or not fitted.limit(1).count():
        held = fitted = sample
    first = QualityModel(mean, scale, weights, phases, solved(fitted), np.empty(0), np.empty(0))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.round(first.raw(_stacked(batch)) * BINS), -BINS // 2, BINS * 3 // 2).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"at": at, "y": batch.column("label")})

    bins = held.select("stats", "label").mapInArrow(binned, "at long, y double").groupBy("at").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("at").collect()
    knots = np.array([r["at"] for r in bins]) / BINS
    values = _isotonic(np.array([r.y for r in bins]), np.array([float(r.n) for r in bins]))
    return QualityModel(mean, scale, weights, phases, first.beta, knots, values)


def score_statistics(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """(id, score) from (id, stats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_stacked(batch)))], names=[id_col, "score"])

    schema = T.StructType([stats.schema[id_col], T.StructField("score", T.DoubleType())])
    return stats.select(id_col, "stats").mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with a score column; all columns pass through where they are."""
    if score_col in docs.columns:
        raise ValueError(f"{score_col} is a column already; name another")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = model.scores(statistics(as_bytes(batch.column(text_col))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def label_statistics(stats: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """Statistics of labelled documents; a document labelled more than once counts with its lowest label."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias("label"))
    return stats.join(known, id_col)
