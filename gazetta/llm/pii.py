"""Personal data in whole texts: base patterns, and contextual patterns that they induce.

Base matches seed the extraction. A token is a run without white space and
separators (``:=,;|`` brackets, quotes and the like), so ``cardno 4539``,
``cardno: 4539`` and ``cardno=4539`` have one context. Lexical patterns of a
seed are the token to its left, and the pair of tokens around it. Tokens that
look like identifiers and that no base pattern takes are candidates. Pattern
and instance scores then feed each other over a few rounds of joins: a
pattern's score for a kind is the share of all occurrences of its token (or of
its pair around a single token) in the corpus that hold instances of that
kind, an instance's score is the best of its patterns. Candidates that reach
``accept`` by a pattern with enough distinct seeds become spans.

Patterns and instances are compared by 64-bit hashes, as a token may be of any
length. A null text is an empty one. Rows are kept as they come, repeated ones
too. Texts are read in linear time. Of kinds with equal scores for an
instance, the first of ``KINDS`` counts.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.llm.common import as_bytes, keyed, slices
from gazetta.session import stash

#: Fixed by the contract, in its order.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't start within a run of digits: the one before it would have taken the whole run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
#: ASCII white space and separators of tokens.
APART = " \t\n\r\x0b\x0c:=,;|()[]{}<>\"'&?#/\\"
LOWER = bytes(32 if chr(i) in APART else i + 32 * (65 <= i <= 90) for i in range(256))
#: A token with a digit or an @, read from its start only.
MARKED = re.compile(rf"(?<![^{re.escape(APART)}])[^{re.escape(APART)}0-9@]*+[0-9@][^{re.escape(APART)}]*+")
BITS = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match needs an ``@``, so each is tried in turn: the local part reaches back as far as the last match allows."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1, start):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def around(text: str, start: int, end: int, low: int, high: int) -> tuple[str, str]:
    """The tokens to the left and right, or what is glued to the span, between ``low`` and ``high``; empty if there is none."""
    a = start
    while a > low and text[a - 1] in APART:
        a -= 1
    first = a
    while first > low and text[first - 1] not in APART:
        first -= 1
    b = end
    while b < high and text[b] in APART:
        b += 1
    last = b
    while last < high and text[last] not in APART:
        last += 1
    return text[first:a], text[b:last]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens of five characters or more with an ``@`` or four digits that overlap no base span. ``taken`` is sorted."""
    out, i, reach = [], 0, 0
    for m in MARKED.finditer(text):
        word = m[0]
        a, b = m.start() + len(word) - len(word.lstrip(".!*_~`")), m.end() - len(word) + len(word.rstrip(".!*_~`"))
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][2])
            i += 1
        if b - a >= 5 and reach <= a and ("@" in word or len(DIGITS.findall(word)) >= 4):
            out.append((a, b))
    return out


SPAN = pa.struct([("start", pa.int64()), ("order", pa.int32()), ("end", pa.int64())])
SEEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("order", pa.int32()), ("left", pa.int64()), ("pair", pa.int64()), ("instance", pa.int64())])
SCHEMA = "doc_id {}, base array<struct<start: long, order: int, end: long>>, seen array<struct<start: long, end: long, order: int, left: long, pair: long, instance: long>>"


def _hash(*parts: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b"\0".join(parts)) - (1 << 63)


def _lower(x: str) -> bytes:
    return x.encode("utf-8", "replace").translate(LOWER)


def marks(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """(base spans, base spans and candidates with their patterns).

    A mark's context ends where the next mark is met: one identifier is no
    context for another. A pattern is null where there is no token on a side.
    """
    found = base_spans(text)
    every = [(a, b, k) for a, k, b in found] + [(a, b, -1) for a, b in candidates(text, found)]
    starts, ends = sorted(a for a, _, _ in every), sorted(b for _, b, _ in every)
    seen = []
    for a, b, k in every:
        before, after = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        low, high = ends[before - 1] if before else 0, starts[after] if after < len(starts) else len(text)
        left, right = map(_lower, around(text, a, b, low, high))
        if left:
            seen.append({"start": a, "end": b, "order": k, "left": _hash(left), "pair": _hash(left, right) if right else None, "instance": _hash(_lower(text[a:b]))})
    return found, seen


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        got = [marks(t or "") for t in batch.column(1).to_pylist()]
        base = [[{"start": a, "order": k, "end": b} for a, k, b in found] for found, _ in got]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "base": pa.array(base, pa.list_(SPAN)), "seen": pa.array([x for _, x in got], pa.list_(SEEN))})


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << BITS, bool)
    for batch in batches:
        bits[batch.column("pattern").to_numpy(zero_copy_only=False) & ((1 << BITS) - 1)] = True
    yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})


class Wanted(dict):
    """Token to its hash where the bitmap has its bit, else 0; remembered up to a limit."""

    def __init__(self, bits: np.ndarray, limit: int = 150_000):
        super().__init__()
        self.bits, self.limit = bits, limit

    def has(self, h: int) -> bool:
        return bool(self.bits[h & ((1 << BITS) - 1)])

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = _hash(token)
        got = self[token] = h if self.has(h) else 0
        return got


def _counted(packed: bytes):
    """(pattern, n): occurrences of tokens, and of pairs around a single token, that the bitmap lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool))
        for batch in slices(batches):
            counts: Counter[int] = Counter()
            for t in as_bytes(batch.column("text")):
                words = t.translate(LOWER).split() if t else []
                for i, h in enumerate(map(wanted.__getitem__, words)):
                    if h:
                        counts[h] += 1
                        if i + 2 < len(words):
                            pair = _hash(words[i], words[i + 2])
                            if wanted.has(pair):
                                counts[pair] += 1
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(counts.keys(), pa.int64()), "n": pa.array(counts.values(), pa.int64())})

    return run


def _frequency(text: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, times) over the corpus, in one pass: a bitmap of fixed size sorts out most tokens, and what passes is counted exactly."""
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for row in patterns.coalesce(4).mapInArrow(_bitmap, "bits binary").collect():
        bits |= np.frombuffer(row.bits, np.uint8)
    passed = text.select("text").mapInArrow(_counted(bits.tobytes()), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("times"))
    return stash(passed.join(patterns, "pattern"))


def extract_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_seeds: int = 3, accept: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added, arrays of (start, order, end); order is a place in ``KINDS``.

    Candidates have five characters at least, and no greatest length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stash(text.mapInArrow(_scanned, SCHEMA.format(kind)).withColumn("row", F.monotonically_increasing_id()))
    marks = rows.select("row", F.explode("seen").alias("m")).select("row", "m.*")
    # Occurrences of an instance in a pattern. A pair is the pattern of the left token with another on the right.
    each = marks.select("instance", F.col("order").alias("own"), F.explode(F.array_compact(F.array("left", "pair"))).alias("pattern"))
    held = stash(each.groupBy("pattern", "instance", "own").agg(F.count("*").alias("n")))
    support = held.where("own >= 0").groupBy("pattern", F.col("own").alias("order")).agg(F.countDistinct("instance").alias("seeds")).where(F.col("seeds") >= least_seeds)
    # Only patterns that also hold a candidate can discover anything.
    open_patterns = held.where("own < 0").groupBy("pattern").agg(F.count("*").alias("c")).select("pattern")
    support = stash(support.select("pattern", "order").join(open_patterns, "pattern", "left_semi"))
    patterns = stash(support.select("pattern").distinct())
    # Left tokens of pairs have to pass as well, so that their pairs are looked at.
    lefts = marks.where("pair is not null").select(F.col("pair").alias("pattern"), "left").join(patterns, "pattern", "left_semi").select(F.col("left").alias("pattern"))
    frequency = _frequency(text, stash(patterns.unionByName(lefts).distinct()))
    own = stash(keyed(held, patterns, "pattern", "left_semi"))
    # A span of several tokens is no pair around a single token; a pattern occurs no less often than it holds marks.
    known = own.groupBy("pattern").agg(F.sum("n").alias("marked")).join(frequency, "pattern", "left").select("pattern", F.greatest("marked", F.coalesce("times", F.lit(0))).alias("times"))
    edges = stash(keyed(own, stash(known.join(support, "pattern")), "pattern", "inner"))
    seeds = stash(own.where("own >= 0").select("instance", F.col("own").alias("order")).distinct().withColumn("score", F.lit(1.0)))
    scores = seeds
    for _ in range(rounds):
        weighed = edges.join(scores, ["instance", "order"])
        confidence = stash(weighed.groupBy("pattern", "order").agg((F.sum(F.col("n") * F.col("score")) / F.first("times")).alias("confidence")))
        reached = keyed(edges.where("own < 0"), confidence, ["pattern", "order"], "inner").groupBy("instance", "order").agg(F.max(F.least("confidence", F.lit(1.0))).alias("score"))
        scores = stash(reached.unionByName(seeds).groupBy("instance", "order").agg(F.max("score").alias("score")))
    best = stash(scores.where(F.col("score") >= accept).groupBy("instance").agg(F.max_by("order", F.struct("score", -F.col("order"))).alias("order")))
    found = keyed(marks.where("order < 0").drop("order"), best, "instance", "inner").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "order", "end"))).alias("added"))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint>>")
    return rows.select("row", "doc_id", "base").join(found, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["order"] + 1), x["start"], x["end"])), ",")
