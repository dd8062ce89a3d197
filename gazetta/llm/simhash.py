"""Near-duplicate fingerprints: SimHash, and a distributed vantage-point tree for the pairs.

A document's words, A-Z lower-cased, are cut at ASCII white space. Every
k-word shingle, repeats included, has an XXH64 of its space-joined bytes; a
bit of the fingerprint is 1 if it is set in over half of them. With fewer
words the whole sequence is one shingle; null texts and texts without words
have fingerprint zero, which is linked like any other.

Equal fingerprints are one node. Nodes are linked at ``most`` (2) or fewer
differing bits. The tree has one vantage point and looks at it field by field: a level of f fields
puts a node into the cell of its f Hamming distances to the vantage point's
fields. Fields are disjoint, so by the triangle inequality two linked nodes'
distances differ by 2 at most in sum over all fields: every other cell is
pruned. A node is a member of its own cell and asks the cells within that
bound that lie after its own, so each pair of cells meets once. A cell
with more members than ``leaf`` is split by the next level, whose fields are
halves of these; at the last level a field is a bit, and a cell one node. So
no task holds more than a leaf's members at a time, whatever the groups of copies,
and none of the links within the bound is lost.

A leaf returns links that connect, not all pairs: a star for each group of
members, and one link from an asking node to each group it meets. Minimum
labels join them to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.llm.common import arrow_rows, as_bytes, keyed, slices
from gazetta.llm.near_dup import components
from gazetta.session import stash

#: Fields of the tree's levels; each halves those of the one before.
LEVELS = (4, 8, 16, 32, 64)
#: Cells that random fingerprints spread over, by the first levels.
SPREAD = {4: 2_400, 8: 390_000}


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 with seed 42 of every k-word shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = zip(*(words[i:] for i in range(min(k, len(words)))), strict=False)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in map(b" ".join, parts)), np.uint64)


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """The majority bits of each document's hashes; no hashes give zero.

    Bits are counted eight at a time, one in each byte of a word, over runs of 255 hashes at most.
    """
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    runs = -(-sizes[full] // 255)
    first_run = np.concatenate([[0], np.cumsum(runs)[:-1]])
    begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    starts = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    for j in range(8):
        lanes = (flat >> np.uint64(j)) & np.uint64(0x0101010101010101)
        counted = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(counted.astype(np.int64), first_run, axis=0)
        most = 2 * counts > sizes[full][:, None]
        out[full] |= (most.astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64) + np.uint64(j))).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprinted(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = fingerprints([shingle_hashes(t or b"", k) for t in as_bytes(batch.column("text"))])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))})

    return run


class Level:
    """One level of the tree: cells of ``fields`` distances, and the steps between cells that the bound allows."""

    def __init__(self, fields: int, most: int = 2):
        self.fields, self.width = fields, 64 // fields
        self.room = self.width.bit_length()  # bits that hold a field's distance
        steps = [()]
        for size in range(1, most + 1):
            steps += [(*s, (i, d)) for s in steps for i in range(s[-1][0] + 1 if s else 0, fields) for d in range(-most, most + 1) if d and sum(abs(x) for _, x in s) + abs(d) == size]
        # Steps go field by field; one is ahead if the first field it moves, it moves up.
        self.ahead = np.array([not s or s[0][1] > 0 for s in steps])
        self.moved = np.zeros((len(steps), fields), np.int8)
        for row, s in zip(self.moved, steps, strict=True):
            for i, d in s:
                row[i] = d
        self.none = np.array([not s for s in steps])

    def distances(self, fp: np.ndarray, vantage: int) -> np.ndarray:
        shifts = np.arange(self.fields, dtype=np.uint64) * np.uint64(self.width)
        mask = np.uint64((1 << self.width) - 1)
        return np.bitwise_count(((fp ^ np.uint64(vantage))[:, None] >> shifts) & mask).astype(np.int8)

    def cells(self, d: np.ndarray) -> np.ndarray:
        """Distances of fields, packed into a number."""
        shifts = np.arange(self.fields, dtype=np.uint64) * np.uint64(self.room)
        return (d.astype(np.uint64) << shifts).sum(axis=-1, dtype=np.uint64).view(np.int64)

    def asked(self, d: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, step, cell) of the cells that these steps lead to."""
        rows, taken, cells = [], [], []
        at = max(1, 2_000_000 // (max(1, len(steps)) * self.fields))
        for begin in range(0, len(d), at):
            to = d[begin : begin + at, None, :] + self.moved[steps][None]
            r, s = np.nonzero(((to >= 0) & (to <= self.width)).all(axis=2))
            rows.append(r + begin)
            taken.append(steps[s])
            cells.append(self.cells(to[r, s]))
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return join(rows), join(taken), join(cells)


def _rows(cell: np.ndarray, fp: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"cell": pa.array(cell), "fp": pa.array(fp.view(np.int64)), "asks": pa.array(asks, pa.bool_())})


VISIT = "cell long, fp long, asks boolean"


def _own(level: Level, vantage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(level.cells(level.distances(fp, vantage)))})

    return run


def _visits(level: Level, vantage: int):
    """A node's own cell, and the cells ahead that it asks."""
    steps = np.flatnonzero(level.ahead)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            r, s, cell = level.asked(level.distances(fp, vantage), steps)
            yield _rows(cell, fp[r], ~level.none[s])

    return run


def _split(level: Level, finer: Level, vantage: int):
    """Visits of overfull cells, dealt to the finer cells within them."""
    halves = finer.moved.reshape(len(finer.moved), level.fields, 2).sum(axis=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(len(finer.moved))
        for batch in slices(batches, 512):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            cell, asks = batch.column("cell").to_numpy(), np.asarray(batch.column("asks"))
            coarse, fine = level.distances(fp, vantage), finer.distances(fp, vantage)
            # A member stays where it is, and asks ahead within its old cell.
            for kind, part in ((False, steps[finer.ahead & (halves == 0).all(axis=1)]), (True, steps)):
                rows = np.flatnonzero(asks == kind)
                r, s, to = finer.asked(fine[rows], part)
                inside = level.cells((coarse[rows][r] + halves[s]).astype(np.int8)) == cell[rows][r]
                yield _rows(to[inside], fp[rows][r[inside]], (kind | ~finer.none[s])[inside])

    return run


def groups_within(members: np.ndarray, most: int, step: int = 256) -> np.ndarray:
    """For every member the first one that it is connected with by links among the members."""
    first = np.arange(len(members))
    linked = np.zeros(len(members), bool)
    for at in range(0, len(members), step):
        near = np.bitwise_count(members[at : at + step, None] ^ members) <= most
        linked[at : at + step] = near.sum(axis=1) > 1
    free = np.flatnonzero(linked)
    while len(free):
        seed, wave, free = free[0], free[:1], free[1:]
        while len(wave) and len(free):
            reached = np.zeros(len(free), bool)
            for at in range(0, len(wave), step):
                reached |= (np.bitwise_count(members[wave[at : at + step], None] ^ members[free]) <= most).any(axis=0)
            wave, free = free[reached], free[~reached]
            first[wave] = seed
    return first


def _leaves(most: int, step: int = 256):
    """Links of cells: rows come in the order of cells, members before those who ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, members, first = None, [], None, None
        for batch in batches:
            cells, fps, asks = batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), np.asarray(batch.column("asks"))
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []

            def close() -> None:
                nonlocal members, first
                if members is None and parts:
                    members = np.concatenate(parts)
                    first = groups_within(members, most)
                    more = np.flatnonzero(first != np.arange(len(members)))
                    a.append(members[more])
                    b.append(members[first[more]])

            for begin, end in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if begin == end:
                    continue
                if cells[begin] != cell:
                    close()
                    cell, parts, members, first = cells[begin], [], None, None
                if not asks[begin]:
                    parts.append(fps[begin:end])
                    continue
                close()
                if members is None:
                    continue  # nobody to ask
                for at in range(begin, end, step):
                    asking = fps[at : min(end, at + step)]
                    q, m = np.nonzero(np.bitwise_count(asking[:, None] ^ members) <= most)
                    if len(q):
                        met = np.unique(np.stack([q, first[m]]), axis=1)
                        a.append(asking[met[0]])
                        b.append(members[met[1]])
            if a:
                yield _edges(a, b)
        a, b = [], []
        if members is None and parts:
            members = np.concatenate(parts)
            first = groups_within(members, most)
            more = np.flatnonzero(first != np.arange(len(members)))
            yield _edges([members[more]], [members[first[more]]])

    return run


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a).view(np.int64)), "b": pa.array(np.concatenate(b).view(np.int64))})


def vantage_point(fps: DataFrame, sample: int = 256, tried: int = 16) -> int:
    """Of some fingerprints the one whose distances spread a fixed-size sample over most cells. It has no influence on results."""
    rows = [r.fp for r in fps.orderBy(F.xxhash64("fp")).limit(sample).collect()]
    some = np.array(rows, np.int64).view(np.uint64)
    level = Level(LEVELS[0])
    return max((int(v) for v in some[:tried]), key=lambda v: len(np.unique(level.cells(level.distances(some, v)))), default=0)


def connecting_links(fps: DataFrame, most: int = 2, leaf: int = 1024) -> DataFrame:
    """(a, b) over distinct fingerprints ``fps`` (fp): links that connect exactly what links within the bound connect."""
    n = fps.count()
    vantage = vantage_point(fps)
    at = next((i for i, f in enumerate(LEVELS) if n <= leaf * SPREAD.get(f, 0)), 1)
    level = Level(LEVELS[at], most)
    crowded = _crowded(fps, level, vantage, leaf)
    visits = fps.select("fp").mapInArrow(_visits(level, vantage), VISIT)
    links = None
    while True:
        full = crowded.limit(1).count() > 0
        if full:
            visits = stash(visits)
        here = keyed(visits, crowded, "cell", "left_anti", most=200_000) if full else visits
        found = here.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(_leaves(most), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not full:
            return links
        at += 1
        finer = Level(LEVELS[at], most)
        with arrow_rows(fps.sparkSession, 512):
            visits = stash(keyed(visits, crowded, "cell", "left_semi", most=200_000).mapInArrow(_split(level, finer, vantage), VISIT))
        level = finer
        crowded = stash(visits.where("not asks").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > leaf).select("cell"))


def _crowded(fps: DataFrame, level: Level, vantage: int, leaf: int) -> DataFrame:
    """Cells with more members than a leaf may have."""
    own = fps.select("fp").mapInArrow(_own(level, vantage), "cell long")
    return stash(own.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > leaf).select("cell"))


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_duplicates(docs: DataFrame, shingle: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text", leaf: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (64 bits as a long), component_id. Ids are numbers.

    component_id is the smallest doc_id of the component; it is null if no row
    of the component has an id. Rows that share an id, or are equal, each have
    the component of their own text. An empty table gives no rows.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, 1000):
        signed = stash(text.mapInArrow(_fingerprinted(shingle), "doc_id long, fp long"))
    nodes = stash(signed.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    links = stash(connecting_links(nodes.select("fp"), most, leaf))
    classes = nodes.select("fp", F.col("least_id").alias("component_id"))
    if links.limit(1).count():
        labels = components(links).withColumnRenamed("node", "fp")
        named = stash(nodes.join(labels, "fp"))
        tops = named.groupBy("label").agg(F.min("least_id").alias("top"))
        linked = stash(named.join(tops, "label").select("fp", "top"))
        classes = keyed(nodes, linked, "fp", "left", most=200_000).select("fp", F.coalesce("top", "least_id").alias("component_id"))
    return signed.join(classes, "fp", "left").select("doc_id", "fp", "component_id")
