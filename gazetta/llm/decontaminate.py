"""Benchmark passages in documents by spaced-seed hashing.

Fixed masks choose token positions to hash and ignore the others, so a seed
survives substitutions at ignored places. Training seeds pass a bitmap of
fixed size, filled from the benchmark's seeds; what passes is joined exactly
to the benchmark's seeds. The two texts are laid along the diagonal of each
hit, over the whole length that they share, and the best-scoring stretch,
substitutions included, decides.

A phrase that many items hold doesn't pair them with every text that holds
it: of an item around such a seed only the rarest places count, as many as
leave fewer others than an overlap needs equal ones. A text that overlaps the
item is equal at one of them, so the pair is found by seed, place and token.
Items with equal tokens are one until the end.

Tokens are white-space chunks without characters other than letters and
digits, lower-cased; chunks without any are no tokens. Null or empty texts
have no overlap. Items of up to five tokens have masks without gaps, so that
they are found verbatim or by as many equal tokens in a row as ``least`` and
``share`` ask for at their defaults. Rows that share a doc_id, or items that
share an item_id, count together; ids are numbers, and null ones are an id of
their own. Other columns are not read, so their names don't matter. Of equal
stretches the first counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.llm.common import WordIds, as_bytes, keyed, mix64, slices
from gazetta.session import stash

#: 1: the token at this place is hashed. At the default least and share, every pattern of equal tokens that
#: ``overlap`` accepts holds one of MASKS, or of SHORT for items under 15 tokens, or of TINY (by length) under 6.
MASKS = ("1110101001", "110100110001", "110110000101", "11010001011", "1111011", "11110011")
SHORT = ("110111", "11111")
TINY = ((), ("1",), ("11",), ("111",), ("111",), ("1111",))
BITS = 24
#: Tokens kept on either side of a hit, and the widest gap within a region of hits.
PAD = 32
#: What a row is known by: its id, and two hashes of its text.
ROW = ("doc_id", "_text_a", "_text_b")


def row_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text among the rows of one id."""
    return [F.xxhash64(text).alias("_text_a"), F.xxhash64(text, F.lit("again")).alias("_text_b")]


class Tokens(WordIds):
    """A chunk's token hash; 0 if it has no letter or digit."""

    def __missing__(self, chunk: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        token = chunk.strip(b".,;:!?\"'()%$#*&").lower()
        if not token.isalnum():  # not ASCII, or marks inside
            token = "".join(c for c in token.decode("utf-8", "replace").lower() if c.isalnum()).encode()
        got = self[chunk] = xxhash.xxh3_64_intdigest(token) | 1 if token else 0
        return got

    def text(self, text: bytes | None) -> np.ndarray:
        got = self.of((text or b"").split())
        return got[got != 0]


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place at which the mask fits."""
    n = len(tokens) - len(mask) + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.full(n, len(mask) * 31 + int(mask, 2), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h += tokens[i : i + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3) | 1) & 0xFFFFFFFFFFFFFFFF)
    return mix64(h)


def masks(n: int) -> tuple[str, ...]:
    """For an item of ``n`` tokens."""
    return TINY[n] if n < len(TINY) else MASKS + SHORT if n < 15 else MASKS


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = Tokens()
    for batch in slices(batches):
        tokens = [read.text(t) for t in as_bytes(batch.column("text"))]
        h = [np.concatenate([np.empty(0, np.uint64), *[seeds(t, m) for m in masks(len(t))]]).view(np.int64) for t in tokens]
        at = [np.concatenate([np.empty(0, np.int64), *[np.arange(max(0, len(t) - len(m) + 1)) for m in masks(len(t))]]) for t in tokens]
        yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id"), "tokens": pa.array([t.view(np.int64) for t in tokens], pa.list_(pa.int64())), "seed": pa.array(h, pa.list_(pa.int64())), "at": pa.array(at, pa.list_(pa.int64()))})


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << BITS, bool)
    for batch in batches:
        for at in _places(batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)):
            bits[at] = True
    yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})


def _regions(packed: bytes, used: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        read = Tokens()
        for batch in slices(batches, 256):
            out: dict[str, list] = {c: [] for c in (*ROW, "start", "ends", "tokens", "seed", "at")}
            texts = [read.text(t) for t in as_bytes(batch.column("text"))]
            flat = np.concatenate([*texts, np.zeros(PAD, np.uint64)])
            ends = np.cumsum([len(t) for t in texts])
            found_h, found_at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for m in used:
                h = seeds(flat, m)
                a, b = _places(h)
                at = np.flatnonzero(bits[a])
                at = at[bits[b[at]]]
                doc = np.searchsorted(ends, at, side="right")
                at = at[(doc < len(ends)) & (at + len(m) <= ends[np.minimum(doc, len(ends) - 1)])]
                found_h.append(h[at])
                found_at.append(at)
            h, at = np.concatenate(found_h), np.concatenate(found_at)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
            doc = np.searchsorted(ends, at, side="right")
            new = np.flatnonzero(np.diff(at, prepend=-10 * PAD) > PAD)
            cuts = np.union1d(new, np.flatnonzero(np.diff(doc, prepend=-1)))
            rows = {c: batch.column(c).to_pylist() for c in ROW}
            for i, j in zip(cuts, [*cuts[1:], len(at)], strict=True):
                d = int(doc[i])
                first = int(ends[d]) - len(texts[d])
                low = max(first, int(at[i]) - PAD)
                high = min(int(ends[d]), int(at[j - 1]) + 2 * PAD)
                for c in ROW:
                    out[c].append(rows[c][d])
                out["start"].append(low - first)
                out["ends"].append(high == int(ends[d]))
                out["tokens"].append(flat[low:high].view(np.int64))
                out["seed"].append(h[i:j].view(np.int64))
                out["at"].append(at[i:j] - low)
            kinds = {**dict.fromkeys((*ROW, "start"), pa.int64()), "ends": pa.bool_()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.list_(pa.int64()))) for k, v in out.items()})

    return run


def places(tokens: np.ndarray, seed: int, at: int) -> np.ndarray:
    """A hash of each place around a seed: the seed, how far the place is from it, and the token there."""
    offset = (np.arange(len(tokens)) - at).astype(np.int64).view(np.uint64)
    return mix64(mix64(tokens.view(np.uint64) ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)) + offset * np.uint64(0x9E3779B97F4A7C15))


def _item_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 512):
        tokens = [np.array(t, np.int64) for t in batch.column("tokens").to_pylist()]
        found = [places(t, s, a).view(np.int64) for t, s, a in zip(tokens, batch.column("seed").to_pylist(), batch.column("item_at").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"item_key": batch.column("item_key"), "item_at": batch.column("item_at"), "seed": batch.column("seed"), "place": pa.array(found, pa.list_(pa.int64()))})


def _region_places(packed: bytes):
    """What a region has around crowded seeds, as far as the bitmap of the items' places knows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for batch in slices(batches, 256):
            out: dict[str, list] = {"region": [], "at": [], "place": []}
            for r in batch.to_pylist():
                tokens = np.array(r["tokens"], np.int64)
                for hit in r["hits"]:
                    h = places(tokens, hit["seed"], hit["at"])
                    a, b = _places(h)
                    known = h[bits[a] & bits[b]].view(np.int64)
                    out["region"] += [r["region"]] * len(known)
                    out["at"] += [hit["at"]] * len(known)
                    out["place"] += known.tolist()
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def _bitmap(rows: DataFrame) -> np.ndarray:
    """2 MB, however many ``seed`` there are; a few tasks make one each."""
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for row in rows.select("seed").coalesce(4).mapInArrow(_bitmaps, "bits binary").collect():
        bits |= np.frombuffer(row.bits, np.uint8)
    return bits


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(start in doc, length, equal tokens) of the best stretch where doc[i] meets item[i - diagonal]; a substitution costs 2."""
    low, high = max(0, diagonal), min(len(doc), len(item) + diagonal)
    if high <= low:
        return 0, 0, 0
    same = doc[low:high] == item[low - diagonal : high - diagonal]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    floor = np.minimum.accumulate(total)
    end = int((total - floor).argmax())
    start = int(total[: end + 1].argmin())
    return low + start, end - start, int(same[start:end].sum())


def needed(n: int, least: int, share: float) -> int:
    """Equal tokens that an overlap with an item of ``n`` tokens takes."""
    return min(least, int(np.ceil(share * n)))


def _possible(least: int, share: float):
    """Lines whose equal tokens can be enough: those in the region, and all that the item has outside of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            keep = []
            for r in batch.select(["tokens", "item", "diagonal", "start", "ends"]).to_pylist():
                doc, item, diagonal = np.array(r["tokens"]), np.array(r["item"]), r["diagonal"]
                low, high = max(0, diagonal), min(len(doc), len(item) + diagonal)
                equal = int((doc[low:high] == item[low - diagonal : high - diagonal]).sum()) if high > low else 0
                outside = (max(0, -diagonal) if r["start"] else 0) + (0 if r["ends"] else max(0, len(item) + diagonal - len(doc)))
                keep.append(equal + outside >= needed(len(item), least, share))
            yield batch.filter(pa.array(keep, pa.bool_())).select([*ROW, "item_key", "line"])

    return run


def _stretches(least: int, share: float):
    """The best stretch of every line of a document, on its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Tokens()
        for batch in slices(batches, 64):
            got: dict[str, list] = {"doc_id": [], "row": [], "item_key": [], "start": [], "length": [], "matches": [], "item_tokens": []}
            for i, text in enumerate(as_bytes(batch.column("text"))):
                tokens = read.text(text).view(np.int64)
                for x in batch.column("lines")[i].as_py():
                    item = np.array(x["item"], np.int64)
                    start, length, matches = overlap(tokens, item, x["line"])
                    if matches >= needed(len(item), least, share):
                        for k, v in zip(got, (batch.column("doc_id")[i].as_py(), batch.column("row")[i].as_py(), x["item_key"], start, length, matches, len(item)), strict=True):
                            got[k].append(v)
            kinds = {"row": pa.list_(pa.int64()), "item_key": pa.string()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in got.items()})

    return run


def _lines(regions: DataFrame, known: DataFrame, items: DataFrame, crowd: int, least: int, share: float) -> DataFrame:
    """(region, item_key, diagonal): where a region and an item share a seed; if it is crowded, a seed and one of the item's rarest places."""
    hits = regions.select("region", F.explode(F.arrays_zip("seed", "at")).alias("x")).select("region", F.col("x.seed").alias("seed"), F.col("x.at").alias("at"))
    crowded = stash(known.groupBy("seed").agg(F.countDistinct("item_key").alias("n")).where(F.col("n") > crowd).select("seed"))
    few = keyed(known, crowded, "seed", "left_anti")
    lines = hits.join(few, "seed").select("region", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal"))
    if not crowded.limit(1).count():
        return lines.distinct()
    around = keyed(known, crowded, "seed", "left_semi").join(items.select("item_key", "tokens"), "item_key")
    around = around.mapInArrow(_item_places, "item_key string, item_at long, seed long, place array<long>")
    around = stash(around.select("item_key", "item_at", "seed", F.size("place").alias("n"), F.explode("place").alias("place")))
    often = around.groupBy("place").agg(F.count("*").alias("df"))
    rarity = F.row_number().over(Window.partitionBy("item_key", "item_at", "seed").orderBy("df", "place"))
    enough = F.least(F.lit(least), F.ceil(F.lit(share) * F.col("n")))
    rare = stash(around.join(often, "place").withColumn("r", rarity).where(F.col("r") <= F.col("n") - enough + 1).select("item_key", "item_at", "place"))
    bits = _bitmap(rare.withColumnRenamed("place", "seed"))
    met = keyed(hits, crowded, "seed", "left_semi").groupBy("region").agg(F.collect_list(F.struct("seed", "at")).alias("hits"))
    found = met.join(regions.select("region", "tokens"), "region").mapInArrow(_region_places(bits.tobytes()), "region long, at long, place long")
    return lines.unionByName(found.join(rare, "place").select("region", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal"))).distinct()


def _overlaps(docs: DataFrame, benchmark: DataFrame, least: int, share: float, crowd: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(doc_id, row, item_id, start, length, matches, item_tokens) for every row, known by id and text, and item that overlap, line by line."""
    read = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).mapInArrow(_items, "item_id long, tokens array<long>, seed array<long>, at array<long>")
    named = stash(read.where("size(seed) > 0").withColumn("item_key", F.sha2(F.array_join(F.transform("tokens", lambda t: F.hex(t)), ",").cast("binary"), 256)))
    items = stash(named.dropDuplicates(["item_key"]).drop("item_id"))
    known = stash(items.select("item_key", F.explode(F.arrays_zip("seed", "at")).alias("x")).select("item_key", F.col("x.seed").alias("seed"), F.col("x.at").alias("item_at")))
    sizes = items.select(F.least(F.size("tokens"), F.lit(15)).alias("n")).distinct().collect()  # 15 at most
    used = sorted({m for r in sizes for m in masks(r.n)})
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(F.col(text_col)), F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"{c} long" for c in ROW)
    found = source.mapInArrow(_regions(_bitmap(known).tobytes(), used), f"{kinds}, start long, ends boolean, tokens array<long>, seed array<long>, at array<long>")
    regions = stash(found.withColumn("region", F.monotonically_increasing_id()))
    lines = _lines(regions, known, items, crowd, least, share)
    rows = lines.join(regions.select("region", *ROW, "start", "ends", "tokens"), "region").join(items.select("item_key", F.col("tokens").alias("item")), "item_key")
    # ``line`` is the diagonal in the whole text.
    rows = rows.select(*ROW, "item_key", "tokens", "item", "diagonal", "start", "ends", (F.col("start") + F.col("diagonal")).alias("line"))
    possible = stash(rows.mapInArrow(_possible(least, share), f"{kinds}, item_key string, line long").distinct())
    per_row = possible.join(items.select("item_key", F.col("tokens").alias("item")), "item_key").groupBy(*ROW).agg(F.collect_list(F.struct("item_key", "item", "line")).alias("lines"))
    no_id = F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_no_id")
    on = ["_id", "_no_id", *ROW[1:]]
    per_row = stash(per_row.select(*no_id, *ROW[1:], "lines"))
    texts = keyed(source.select(*no_id, *ROW, "text"), per_row.select(*on), on, "left_semi").dropDuplicates(on)
    whole = texts.join(per_row, on).select("doc_id", F.array(*ROW[1:]).alias("row"), "text", "lines")
    checked = whole.mapInArrow(_stretches(least, share), "doc_id long, row array<long>, item_key string, start long, length long, matches long, item_tokens long")
    return stash(checked).join(named.select("item_key", "item_id").distinct(), "item_key").drop("item_key")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.75, crowd: int = 64, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, start, length, matches, item_tokens.

    An overlap counts from ``least`` equal tokens, or ``share`` of the item if
    that is fewer. start and length are in tokens of the document; of a pair the
    overlap with the most equal tokens is given, the first of equal ones. Texts
    and overlaps of any length are read whole. Seeds of more than ``crowd``
    items are joined with a place beside them; results don't depend on it.
    """
    found = _overlaps(docs, benchmark, least, share, crowd, id_col, text_col, item_col, item_text)
    best = F.max(F.struct("matches", (-F.col("start")).alias("s"), "length", "item_tokens")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("x.s")).alias("start"), "x.length", "x.matches", "x.item_tokens")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.75, crowd: int = 64, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item. Rows that share an id are told apart by their texts; null and empty texts stay."""
    hit = _overlaps(docs, benchmark, least, share, crowd, id_col, text_col, item_col, item_text)
    keys = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_no_id")]
    hit = stash(hit.select(*keys, F.col("row")[0].alias("_text_a"), F.col("row")[1].alias("_text_b")).distinct())
    own = [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_id"), F.col(id_col).isNull().alias("_no_id")]
    rows = docs.select(F.struct("*").alias("_row"), *own, *row_key(F.col(text_col)))  # no name of ``docs`` can clash
    return keyed(rows, hit, ["_id", "_no_id", "_text_a", "_text_b"], "left_anti").select("_row.*")
