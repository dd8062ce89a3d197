"""Source divergence audit over a vocabulary kept as minimal acyclic transducers.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.
Each language keeps the terms that at least ``least`` of its documents hold:
one pass over the texts counts documents per term. The kept terms, sorted by
their UTF-8 bytes, are cut into shards of a bounded number of terms, and each
shard becomes a minimal acyclic transducer that gives a term's ordinal, its
place in the sorted list of its language. A second pass streams the texts
through the transducers and counts ordinals per language and source. Ordinals
stand for terms in all that follows, ties included.

While the transducers are small in total (``broadcast_bytes``, their size is
summed first) every task has all of them. Beyond that, counted terms are
shuffled to their shard and pass through it there; the results are the same.

Frequencies are whole numbers, p = 1 + floor(10^9 (count + 2) / (N + 2 V)),
and so are the divergences floor((p - q)^2 / (p + q)); all arithmetic is exact.
Pairs of sources are compared in blocks: a task has up to 64 sources twice and a range of ordinals,
and returns sums.

Null text, lang and source are read as ''. Repeated rows count each. Groups
without terms have count 0 everywhere; a language without kept terms has pairs
of value 0 and no terms. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.llm.common import as_bytes, slices
from gazetta.session import sized, stash

WORD = re.compile(rb"[A-Za-z\x80-\xff]+")
ONE = 1_000_000_000
#: Terms of one shard, at least; and shards at most, so that their first terms stay a short list.
SHARD, SHARDS = 8192, 4096


def terms(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Transducer:
    """A minimal acyclic automaton over sorted terms; a term's ordinal is the sum of what its transitions pass over.

    States are numbered; transitions are three parallel arrays in the order of
    (state, byte): that key, the state led to, and how many terms of the left
    state come before those behind the transition.
    """

    def __init__(self, keys: np.ndarray, target: np.ndarray, skip: np.ndarray, final: np.ndarray, root: int):
        self.keys, self.target, self.skip, self.final, self.root = keys, target, skip, final, root

    @staticmethod
    def build(words: list[bytes]) -> Transducer:
        """From distinct terms in ascending order. States with equal endings become one as soon as no later term can reach them."""
        register: dict[tuple, int] = {}
        made: list[tuple[bool, tuple]] = []
        size: list[int] = []

        def settle(final: bool, edges: list[tuple[int, int]]) -> int:
            shape = (final, tuple(edges))
            state = register.get(shape)
            if state is None:
                state = register[shape] = len(made)
                made.append(shape)
                size.append(final + sum(size[t] for _, t in edges))
            return state

        # The path of the last term: of every place on it whether a term ends there, and its settled transitions.
        path: list[list] = [[False, []]]
        last = b""
        for word in words:
            common = next((i for i, (x, y) in enumerate(zip(last, word, strict=False)) if x != y), min(len(last), len(word)))
            for i in range(len(last), common, -1):
                final, edges = path.pop()
                path[-1][1].append((last[i - 1], settle(final, edges)))
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            last = word
        for i in range(len(last), 0, -1):
            final, edges = path.pop()
            path[-1][1].append((last[i - 1], settle(final, edges)))
        root = settle(*path[0])
        keys, target, skip = [], [], []
        for state, (final, edges) in enumerate(made):
            before = int(final)
            for byte, to in edges:
                keys.append(state << 8 | byte)
                target.append(to)
                skip.append(before)
                before += size[to]
        return Transducer(np.array(keys, np.int64), np.array(target, np.int64), np.array(skip, np.int64), np.array([f for f, _ in made], bool), root)

    @staticmethod
    def joined(parts: list[Transducer]) -> tuple[Transducer, list[int]]:
        """One set of arrays for several, and their roots in it."""
        at = np.concatenate([[0], np.cumsum([len(p.final) for p in parts])]).astype(np.int64)
        whole = Transducer(
            np.concatenate([p.keys + (a << 8) for p, a in zip(parts, at, strict=False)] or [np.empty(0, np.int64)]),
            np.concatenate([p.target + a for p, a in zip(parts, at, strict=False)] or [np.empty(0, np.int64)]),
            np.concatenate([p.skip for p in parts] or [np.empty(0, np.int64)]),
            np.concatenate([p.final for p in parts] or [np.empty(0, bool)]),
            0,
        )
        return whole, [int(p.root + a) for p, a in zip(parts, at, strict=False)]

    def ordinals(self, words: list[bytes], roots: np.ndarray | None = None) -> np.ndarray:
        """The ordinal of every word, -1 where it isn't a term. All words take their next byte at once."""
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.final):
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        state = np.full(len(words), self.root, np.int64) if roots is None else roots.copy()
        total, alive = np.zeros(len(words), np.int64), np.arange(len(words))
        step = 0
        while len(alive):
            ends = sizes[alive] == step
            done = alive[ends]
            found = done[self.final[state[done]]]
            out[found] = total[found]
            alive = alive[~ends]
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] << 8 | flat[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive, at = alive[hit], at[hit]
            total[alive] += self.skip[at]
            state[alive] = self.target[at]
            step += 1
        return out

    def pack(self) -> bytes:
        return pickle.dumps((self.keys, self.target.astype(np.int32), self.skip.astype(np.int32), self.final, self.root), 5)

    @staticmethod
    def unpack(data: bytes) -> Transducer:
        keys, target, skip, final, root = pickle.loads(data)
        return Transducer(keys, target.astype(np.int64), skip.astype(np.int64), final, root)


class Vocabulary:
    """The transducers of all shards: ordinals by language and term."""

    def __init__(self, rows: list[tuple[str, bytes, int, int, bytes]]):
        rows = sorted(rows, key=lambda r: (r[0], r[1]))
        self.whole, roots = Transducer.joined([Transducer.unpack(r[4]) for r in rows])
        self.by_lang: dict[str, tuple[list[bytes], np.ndarray, np.ndarray, int]] = {}
        by: dict[str, list] = defaultdict(list)
        for (lang, first, base, n, _), root in zip(rows, roots, strict=True):
            by[lang].append((first, base, root, n))
        for lang, shards in by.items():
            self.by_lang[lang] = ([s[0] for s in shards], np.array([s[1] for s in shards], np.int64), np.array([s[2] for s in shards], np.int64), sum(s[3] for s in shards))

    def size(self, lang: str) -> int:
        """How many terms the language keeps."""
        return self.by_lang[lang][3] if lang in self.by_lang else 0

    def ordinals(self, lang: str, words: list[bytes]) -> np.ndarray:
        if lang not in self.by_lang:
            return np.full(len(words), -1, np.int64)
        first, base, root, _ = self.by_lang[lang]
        shard = np.fromiter((bisect_right(first, w) - 1 for w in words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        could = np.flatnonzero(shard >= 0)
        got = self.whole.ordinals([words[i] for i in could], root[shard[could]])
        out[could] = np.where(got >= 0, got + base[shard[could]], -1)
        return out


def _document_counts(room: int = 300_000):
    """(lang, term, n): in how many of a task's documents a term is; written out whenever ``room`` entries are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            langs, words, n = [], [], []
            for lang, c in held.items():
                langs += [lang] * len(c)
                words += c.keys()
                n += c.values()
            held.clear()
            return pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "term": pa.array(words, pa.binary()), "n": pa.array(n, pa.int64())})

        for batch in slices(batches, 256):
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
                held[lang].update(set(terms(text)))
            if sum(map(len, held.values())) > room:
                yield out()
        yield out()

    return run


def _built(per_shard: int):
    """Sorted (lang, term) rows of a partition to shards: (lang, first, n, transducer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, words = None, []

        def out() -> pa.RecordBatch:
            row = {"lang": [lang], "first": [words[0]], "n": [len(words)], "transducer": [Transducer.build(words).pack()]}
            return pa.RecordBatch.from_arrays([pa.array(row["lang"], pa.string()), pa.array(row["first"], pa.binary()), pa.array(row["n"], pa.int64()), pa.array(row["transducer"], pa.binary())], names=list(row))

        for batch in slices(batches, 8192):
            for of, word in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist(), strict=True):
                if words and (of != lang or len(words) == per_shard):
                    yield out()
                    words = []
                lang = of
                words.append(word)
        if words:
            yield out()

    return run


def vocabulary(docs: DataFrame, least: int = 10, per_shard: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, term) of the kept terms, (lang, first, base, n, transducer) of their shards) for docs (lang, text)."""
    counted = docs.select("lang", "text").mapInArrow(_document_counts(), "lang string, term binary, n long")
    kept = stash(counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"))
    n = kept.count()
    per_shard = per_shard or max(SHARD, -(-n // SHARDS))
    ordered = kept.repartitionByRange(max(4, -(-n // per_shard)), "lang", "term").sortWithinPartitions("lang", "term")
    shards = stash(ordered.mapInArrow(_built(per_shard), "lang string, first binary, n long, transducer binary"))
    # Ordinals go on from shard to shard: a running count over one row a shard.
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("lang", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return kept, stash(shards.join(bases, ["lang", "first"]).select("lang", "first", "base", "n", "transducer"))


def _flushed(room: int, begin):
    """Words of each group counted within a task, and handed on whenever ``room`` entries are held.

    ``begin`` is called once a task and returns (found, rest): what is done with counts {group: Counter} and the languages of the groups, and what is left at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rest = begin()
        held: dict[int, Counter] = defaultdict(Counter)
        lang_of: dict[int, str] = {}
        for batch in slices(batches, 256):
            for group, lang, text in zip(batch.column("gid").to_pylist(), batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
                held[group].update(terms(text))
                lang_of[group] = lang
            if sum(map(len, held.values())) > room:
                yield from found(held, lang_of)
                held.clear()
        yield from found(held, lang_of)
        yield from rest()

    return run


COUNTED = "gid long, ordinal long, n long"


def _counted_rows(group: int, ordinal: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"gid": pa.array(np.full(len(ordinal), group, np.int64)), "ordinal": pa.array(ordinal, pa.int64()), "n": pa.array(n, pa.int64())})


def _streamed(shared, room: int = 400_000, dense: int = 6_000_000):
    """Texts through transducers that every task has. Up to ``dense`` counts in all, groups keep an array of them over the whole task; others are written out at once."""

    def begin():
        words, sums = Vocabulary(shared.value), {}
        left = [dense]

        def found(held: dict, lang_of: dict) -> Iterator[pa.RecordBatch]:
            for lang in set(lang_of.values()):
                mine = [g for g in held if lang_of[g] == lang]
                distinct = list(set().union(*(held[g] for g in mine)))
                place = dict(zip(distinct, words.ordinals(lang, distinct).tolist(), strict=True))
                for g in mine:
                    c = held[g]
                    got, n = np.fromiter(map(place.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))
                    got, n = got[got >= 0], n[got >= 0]
                    if g not in sums and left[0] >= (size := words.size(lang)):
                        sums[g] = np.zeros(size, np.int64)
                        left[0] -= size
                    if g in sums:
                        sums[g][got] += n
                    else:
                        yield _counted_rows(g, got, n)

        def rest() -> Iterator[pa.RecordBatch]:
            for g, total in sums.items():
                at = np.flatnonzero(total)
                yield _counted_rows(g, at, total[at])

        return found, rest

    return _flushed(room, begin)


def _routed_terms(firsts: dict[str, list[bytes]], room: int = 400_000):
    """Counted words of the texts, with the shard that may hold them."""

    def found(held: dict, lang_of: dict) -> Iterator[pa.RecordBatch]:
        for g, c in held.items():
            words = list(c)
            shard = np.array([bisect_right(firsts.get(lang_of[g], []), w) - 1 for w in words], np.int64)
            ok = np.flatnonzero(shard >= 0)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang_of[g]] * len(ok), pa.string()),
                    "shard": pa.array(shard[ok], pa.int64()),
                    "gid": pa.array(np.full(len(ok), g, np.int64)),
                    "term": pa.array([words[i] for i in ok], pa.binary()),
                    "n": pa.array([c[words[i]] for i in ok], pa.int64()),
                }
            )

    return _flushed(room, lambda: (found, lambda: iter(())))


def _through_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (lang, shard), each shard's transducer before its words."""
    machine, base = None, 0
    for batch in slices(batches, 4096):
        loaded = np.asarray(batch.column("transducer").is_valid())
        cuts = [*np.flatnonzero(loaded), batch.num_rows]
        for begin, end in zip([0, *cuts[:-1]], cuts, strict=True):
            if begin < end and loaded[begin]:
                machine, base = Transducer.unpack(batch.column("transducer")[int(begin)].as_py()), batch.column("n")[int(begin)].as_py()
                begin += 1
            part = batch.slice(begin, end - begin)
            if part.num_rows:
                got = machine.ordinals(part.column("term").to_pylist())
                hit = pa.array(np.flatnonzero(got >= 0))
                yield pa.RecordBatch.from_pydict({"lang": part.column("lang").take(hit), "gid": part.column("gid").take(hit), "ordinal": pa.array(got[got >= 0] + base), "n": part.column("n").take(hit), "term": part.column("term").take(hit)})


def _routed(words: DataFrame, shards: DataFrame, salts: int = 8) -> DataFrame:
    """(lang, gid, ordinal, n, term) of words (lang, shard, gid, term, n), shuffled to their shard. A shard's words are dealt to ``salts`` copies of it."""
    numbered = shards.withColumn("shard", F.row_number().over(Window.partitionBy("lang").orderBy("first")).cast("long") - 1)
    machines = numbered.select("lang", "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("gid"), F.lit(None).cast("binary").alias("term"), F.col("base").alias("n"), "transducer")
    rows = words.select("lang", "shard", F.pmod(F.xxhash64("term", "gid"), F.lit(salts)).cast("int").alias("salt"), "gid", "term", "n", F.lit(None).cast("binary").alias("transducer"))
    both = machines.unionByName(rows).withColumn("later", F.col("transducer").isNull()).repartition("lang", "shard", "salt").sortWithinPartitions("lang", "shard", "salt", "later")
    return both.mapInArrow(_through_shards, f"lang string, {COUNTED}, term binary")


def recounted(docs: DataFrame, kept: DataFrame, shards: DataFrame, broadcast_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """((gid, ordinal, n) of docs (gid, lang, text), (lang, ordinal, term)): the texts streamed through the transducers."""
    total = shards.agg(F.sum(F.octet_length("transducer"))).first()[0] or 0
    names = kept.select("lang", F.lit(0).cast("long").alias("gid"), "term", F.lit(1).cast("long").alias("n"))
    if total <= broadcast_bytes:
        shared = docs.sparkSession.sparkContext.broadcast([(r.lang, bytes(r.first_), r.base, r.n, bytes(r.transducer)) for r in shards.withColumnRenamed("first", "first_").collect()])

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Vocabulary(shared.value)
            for batch in slices(batches, 8192):
                langs, of = np.array(batch.column("lang").to_pylist(), object), batch.column("term").to_pylist()
                out = np.zeros(len(of), np.int64)
                for lang in set(langs):
                    at = np.flatnonzero(langs == lang)
                    out[at] = words.ordinals(lang, [of[i] for i in at])
                yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "ordinal": pa.array(out), "term": batch.column("term")})

        counts = docs.select("gid", "lang", "text").mapInArrow(_streamed(shared), COUNTED)
        ordinals = kept.mapInArrow(named, "lang string, ordinal long, term binary")
    else:
        firsts: dict[str, list[bytes]] = defaultdict(list)
        for r in shards.select("lang", F.col("first").alias("word")).orderBy("lang", "first").collect():  # SHARDS rows at most, and one more a language
            firsts[r.lang].append(bytes(r.word))
        words = docs.select("gid", "lang", "text").mapInArrow(_routed_terms(firsts), "lang string, shard long, gid long, term binary, n long")
        counts = _routed(words.groupBy("lang", "shard", "gid", "term").agg(F.sum("n").alias("n")), shards).select("gid", "ordinal", "n")

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [bisect_right(firsts[lang], w) - 1 for lang, w in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("lang", "gid", "term", "n")}, "shard": pa.array(at, pa.int64())})

        ordinals = _routed(names.mapInArrow(placed, "lang string, gid long, term binary, n long, shard long"), shards).select("lang", "ordinal", "term")
    return stash(counts.groupBy("gid", "ordinal").agg(F.sum("n").alias("n"))), ordinals


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 2) / total), exactly."""
    wide = (n + 2).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, total.cast("decimal(20,0)"))


F_VALUE = "(p - q) * (p - q) div (p + q)"


def _pair_sums(width: int):
    """Sums of f over a range of ordinals, for every two sources of two blocks. Rows without an ordinal give a source's p where it has no count."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        base = rows[rows["ordinal"] < 0].sort_values("no")
        no, lang = base["no"].to_numpy(np.int64), rows["lang"].iloc[0]
        size, i, j = int(base["size"].iloc[0]), int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        p = np.repeat(base["p"].to_numpy(np.int64)[:, None], size, axis=1)
        cells = rows[rows["ordinal"] >= 0]
        p[np.searchsorted(no, cells["no"].to_numpy(np.int64)), cells["ordinal"].to_numpy(np.int64) % width] = cells["p"].to_numpy(np.int64)
        out = []
        for a in np.flatnonzero(no // 64 == i):
            with_ = np.flatnonzero((no // 64 == j) & (no > no[a]))
            d = p[with_] - p[a]
            f = (d * d // (p[with_] + p[a])).sum(axis=1)
            out.append(pd.DataFrame({"lang": lang, "a": no[a], "b": no[with_], "value": f}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})

    return run


def _pairs(groups: DataFrame, cells: DataFrame, width: int = 2048) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language; groups: lang, source, p0, v; cells: lang, source, ordinal, p."""
    numbered = stash(groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1))
    blocks = numbered.groupBy("lang").agg(F.max(F.floor(F.col("no") / 64)).alias("last"))
    numbered = numbered.join(sized(blocks, 200_000), "lang")
    # Blocks of sources that the source's own block meets, in order.
    mine = F.floor(F.col("no") / 64)
    met = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j")))).alias("ij")
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / width)))).alias("range")
    base = numbered.withColumn("mine", mine).select("lang", "no", "mine", "last", "v", F.col("p0").alias("p"), ranges).withColumn("ordinal", F.lit(-1).cast("long"))
    base = base.withColumn("size", F.least(F.lit(width).cast("long"), F.col("v") - F.col("range") * width)).drop("v")
    dealt = cells.drop("n").join(sized(numbered.select("lang", "source", "no", "last"), 200_000), ["lang", "source"]).withColumn("mine", mine)
    dealt = dealt.select("lang", "no", "mine", "last", "p", F.floor(F.col("ordinal") / width).alias("range"), "ordinal", F.lit(None).cast("long").alias("size"))
    rows = base.unionByName(dealt).select("lang", "range", met, "no", "ordinal", "p", "size").select("lang", "range", "ij.i", "ij.j", "no", "ordinal", "p", "size")
    sums = rows.groupBy("lang", "range", "i", "j").applyInPandas(_pair_sums(width), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "a", "b", "value").unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = numbered.select("lang", "no", "source")
    named = both.join(sized(names.withColumnsRenamed({"no": "a"}), 200_000), ["lang", "a"]).join(sized(names.withColumnsRenamed({"no": "b", "source": "item"}), 200_000), ["lang", "b"])
    return named.select("lang", "source", "item", "value")


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, per_shard: int | None = None, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's terms differ from every other source of its language ('pair', all ranks), and which terms it has more of than its language ('term', the ``top`` first)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    named = stash(rows.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()))
    kept, shards = vocabulary(rows, least, per_shard)
    counts, ordinals = recounted(rows.join(sized(named, 200_000), ["lang", "source"]), kept, shards, broadcast_bytes)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("gid").agg(F.sum("n").alias("total"))
    groups = named.join(totals, "gid", "left").join(sizes, "lang", "left")
    groups = groups.select("gid", "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    room = F.col("total") + 2 * F.col("v")
    groups = stash(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), room)).otherwise(F.lit(0))))
    cells = counts.join(sized(groups.select("gid", "lang", "source", "total", "v"), 200_000), "gid")
    cells = stash(cells.select("lang", "source", "ordinal", "n", share(F.col("n"), room).alias("p")))
    pairs = _pairs(groups, cells)
    within = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(within.orderBy(F.desc("value"), "item")).alias("rank"))
    whole = groups.groupBy("lang").agg((F.sum("total") + 2 * F.first("v")).alias("room"))
    of_lang = cells.groupBy("lang", "ordinal").agg(F.sum("n").alias("n")).join(sized(whole, 200_000), "lang").select("lang", "ordinal", share(F.col("n"), F.col("room")).alias("q"))
    more = cells.join(of_lang, ["lang", "ordinal"]).where("p > q").select("lang", "source", "ordinal", F.expr(F_VALUE).alias("value"))
    best = more.withColumn("rank", F.row_number().over(within.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    named = ordinals.join(sized(stash(best), 200_000), ["lang", "ordinal"])
    return pairs.unionByName(named.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank"))
