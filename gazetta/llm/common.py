"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores at its end until no column of ``df`` has it, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def draw(*key: Column) -> Column:
    """62 random bits that ``key`` decides, as a number: the smallest are drawn first."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit("sample")), 2)


def draw_bits(*key: Column) -> Column:
    """How many bits the drawn number has. Half as many rows have one bit less, so a table has few such counts."""
    return F.length(F.bin(draw(*key)))


def bounded_sample(df: DataFrame, key: Column, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows of ``df``, and more than an eighth of that if ``df`` has them, chosen by a hash of ``key``.

    The same keys are chosen in every run. One pass counts rows by the length
    of their drawn number, 62 counts at most; the greatest length with no more
    rows than wanted is taken. Where keys are so alike that no length gives
    enough, the rows of smallest numbers are.
    """
    counts = {r["bits"]: r["n"] for r in df.groupBy(draw_bits(key).alias("bits")).agg(F.count("*").alias("n")).collect()}
    if sum(counts.values()) <= max_rows:
        return df
    taken, bits, enough = 0, 0, 0
    for length in sorted(counts):
        enough = length
        if taken + counts[length] > max_rows:
            break
        taken, bits = taken + counts[length], length
    if taken * 8 > max_rows:
        return df.where(draw_bits(key) <= bits)
    return df.where(draw_bits(key) <= enough).orderBy(draw(key)).limit(max_rows)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches between the JVM and Python of ``rows`` rows at most for what is written inside; the session gets its setting back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``rows`` rows, to bound what a task holds at once.

    Workers are kept for later tasks, so free memory is handed back at the end.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordIds(dict):
    """Word to a 64-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def keyed(big: DataFrame, keys: DataFrame, on: str | list[str], how: str, most: int = 1_000_000) -> DataFrame:
    """Semi or anti join of wide rows with a narrow key table.

    Up to ``most`` keys (counted first) are broadcast, so the wide rows stay
    where they are; beyond that it is an ordinary shuffle join.
    """
    return big.join(F.broadcast(keys) if keys.count() <= most else keys, on, how)
