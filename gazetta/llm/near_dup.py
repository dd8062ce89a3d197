"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document is the set of its distinct k-word shingles over ASCII white space,
A-Z lower-cased; with fewer words the whole sequence is one shingle. Two
documents are linked if 100 * intersection >= percent * union.

Copies with equal sets are one node from the start. Nodes get a SuperMinHash
signature, whose bands deal them into buckets. Buckets are worked off by hubs,
not by pairs: every node is compared with its bucket's most central node on
the full sets. Nodes of buckets that are not one component then are dealt
anew by their rarest shingles, one of which every linked pair shares, and
those buckets are worked off by a growing share of hubs until each is one
component or all of its nodes outside its largest component have been hubs,
so a bucket of many copies and a few others costs rows times others. No link
between nodes that share a band is lost. Verified links are joined to components by minimum
labels with pointer jumping.

Null or empty texts, and texts without words, have no set and no links.
Rows with a null doc_id take part in links, but are never a component's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.llm.common import WordIds, arrow_rows, as_bytes, keyed, mix64, slices
from gazetta.session import stash

SIGNATURE = 126


def band_plan(percent: int, m: int = SIGNATURE, miss: float = 1e-4) -> tuple[int, int]:
    """(bands, rows): the longest rows at which a pair at the threshold is missed with ``miss`` at most."""
    t = percent / 100
    rows = max([1, *(r for r in range(1, m + 1) if (1 - t**r) ** (m // r) <= miss)])
    return m // rows, rows


def shingle_set(words: list[bytes], k: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    w = ids.of(words)
    width = min(k, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for j in range(width):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(h)])
    return np.unique(h)


def superminhash(sets: list[np.ndarray], m: int = SIGNATURE, room: int = 100_000) -> np.ndarray:
    """A row of ``m`` values for each set.

    Step j gives every element the value r + j in the slot that its own random
    permutation has at place j, so later steps only hold larger values: a set
    is done when all of its slots are below j + 1. At most ``room`` elements
    have their permutations in memory at a time, but for a single longer set.
    """
    out = np.full((len(sets), m), np.inf)
    flat = out.ravel()

    def draw(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        u = mix64(x + np.uint64((j + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        r = (u >> np.uint64(11)).astype(np.float64) * 2.0**-53
        return r + j, j + (mix64(u) % np.uint64(m - j)).astype(np.int64)

    groups: list[list[int]] = [[]]
    held = 0
    for i, s in enumerate(sets):
        if held and held + len(s) > room:
            groups.append([])
            held = 0
        groups[-1].append(i)
        held += len(s)
    for group in groups:
        x = np.concatenate([sets[i] for i in group] or [np.empty(0, np.uint64)])
        owner = np.repeat(np.array(group, np.int64), [len(sets[i]) for i in group])
        value, slot = draw(x, 0)
        first = slot
        np.minimum.at(flat, owner * m + slot, value)
        perm = None
        for j in range(1, m):
            alive = (out.max(axis=1) >= j)[owner]
            if not alive.any():
                break
            if not alive.all():
                x, owner, first = x[alive], owner[alive], first[alive]
                perm = None if perm is None else perm[alive]
            rows = np.arange(len(x))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(x), 1))
                perm[rows, first] = 0
            value, at = draw(x, j)
            slot = perm[rows, at].astype(np.int64)
            perm[rows, at] = perm[:, j]
            np.minimum.at(flat, owner * m + slot, value)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(signatures[:, : bands * rows]).view(np.uint64).reshape(len(signatures), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for j in range(rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, j])
    return h.view(np.int64)


def _signed(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids = WordIds()
        for batch in slices(batches, 512):
            sets = [shingle_set((t or b"").lower().split(), k, ids) for t in as_bytes(batch.column("text"))]
            keys = band_keys(superminhash(sets), bands, rows)
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: batch.column(c) for c in ("doc_id", "_text_a", "_text_b")},
                    "doc_key": batch.column("doc_key"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    "bands": pa.array([b if len(s) else None for s, b in zip(sets, keys, strict=True)], pa.list_(pa.int64())),
                }
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids = WordIds()
        for batch in slices(batches, 512):
            sets = [shingle_set((t or b"").lower().split(), k, ids).tobytes() for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"node": pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), "shingles": pa.array(sets, pa.binary())})

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(ok, pa.bool_())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node that can be reached."""
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = stash(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = step.select("node", "label")
        if step.where("label < old").limit(1).count() == 0:
            return labels


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: the links are contracted to links between labels first."""
    if labels is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("label").alias("l"))
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("l", end)).drop("l")
    upper = components(ends.where("a != b")).select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(upper, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = upper.select(F.col("label").alias("node"), F.col("top").alias("label")).join(labels, "node", "left_anti")
    return stash(old.unionByName(fresh))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # A row has two sets, a hub's over and over: few rows a batch bound what a task holds.
    with arrow_rows(pairs.sparkSession, 64):
        return stash(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a binary, b binary, linked boolean"))


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Sizes that a linked pair can have."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 512):
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(at)), pa.array(np.concatenate(sets))], names=["node", "shingle"])


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _by_bucket(rows: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with a narrower table by bucket. Up to a bound that table is broadcast, so that a bucket's rows stay where they are."""
    return keyed(rows, stash(few), "bucket", how, most=200_000)


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component."""
    return _by_bucket(rows, rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket"), "left_semi")


def _top_labels(live: DataFrame) -> DataFrame:
    """(bucket, top, outside, pairs): each bucket's largest component, how many rows are not of it, and the pairs across components."""
    sizes = live.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    tops = sizes.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("live"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    return tops.select("bucket", F.col("m.label").alias("top"), (F.col("live") - F.col("m.c")).alias("outside"), ((F.col("live") * F.col("live") - F.col("squares")) / 2).alias("pairs"))


def _hubs(live: DataFrame, tops: DataFrame, share: float, last: bool) -> tuple[DataFrame, DataFrame]:
    """(hubs, closed): the rows that every row of their bucket is compared with, and the buckets that these comparisons settle.

    Two rows of different components are never both of the largest one, so a
    bucket with ``share`` rows outside it at most is settled by those rows as
    hubs; so is every bucket in the last round. Other buckets draw about ``share`` hubs.
    """
    draw = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    settled = F.lit(last) | (F.col("outside") <= share)
    chosen = F.when(settled, F.col("label") != F.col("top")).otherwise(draw * F.col("k") < share)
    hubs = _by_bucket(live, tops.select("bucket", "top", "outside")).where(chosen)
    return hubs.select("bucket", *[F.col(c).alias(f"hub_{c}") for c in ("node", "n", "label", "rank")]), tops.where(settled).select("bucket")


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """The least number of shared shingles of a linked pair of these sizes."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent)).cast("long")


def _prefixes(open_nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, n, rank, k) over open nodes: a bucket for each of a node's rarest shingles.

    Shingles are ranked by how many open nodes hold them. A linked pair shares
    one whose rank on either side is within n - overlap + 1, so buckets by
    those shingles meet every linked pair. k is the size of the bucket.
    """
    parts = sets.join(open_nodes, "node", "left_semi").mapInArrow(_shingles, "node binary, shingle long")
    held = parts.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = parts.join(held, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("r"))
    ranked = open_nodes.join(ranked, "node").withColumn("own", F.col("n") - F.size("r"))  # shingles of this node alone rank first
    width = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100).cast("long") + 1 - F.col("own")
    dealt = ranked.where(width > 0).select("node", "n", "own", F.posexplode(F.slice("r", F.lit(1), width.cast("int"))).alias("at", "x"))
    dealt = stash(dealt.select(F.col("x.shingle").alias("bucket"), "node", "n", (F.col("own") + F.col("at") + 1).alias("rank")))
    return stash(_by_bucket(dealt, dealt.groupBy("bucket").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1")))


def _open(members: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Members of prefix buckets that may still have an unknown link: their rank suits the smallest partner that the bucket holds."""
    least = F.greatest(F.col("least"), F.ceil(F.col("n") * F.lit(percent) / 100).cast("long"))
    rows = members.where(F.col("rank") <= F.col("n") - _overlap(F.col("n"), least, percent) + 1)
    return stash(_mixed(_labelled(rows, labels)))


def _digests(text: Column) -> list[Column]:
    """Two hashes that stand for a text among the rows of one id."""
    return [F.xxhash64(text).alias("_text_a"), F.xxhash64(text, F.lit("again")).alias("_text_b")]


def _classified(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, _text_a, _text_b, n_shingles, label, component_id) per row; label is null for rows without a set."""
    bands, rows = band_plan(percent)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_digests(F.col(text_col)), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, 1000):
        signed = stash(text.mapInArrow(_signed(shingle, bands, rows), "doc_id long, _text_a long, _text_b long, doc_key long, n_shingles long, node binary, bands array<long>"))
    # A node is a distinct set; its bands depend on the set alone.
    nodes = stash(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("doc_key").alias("doc_key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    dealt = nodes.select("node", "doc_key", "n", F.explode("bands").alias("bucket"))
    full = dealt.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    members = stash(_by_bucket(dealt, full).select("bucket", "k", "node", "n", "doc_key"))
    n_members = members.count()
    chosen = members.select("doc_key").distinct()
    with arrow_rows(docs.sparkSession, 1000):
        sets = stash(keyed(text.where("text is not null"), stash(chosen), "doc_key", "left_semi").select("text").mapInArrow(_sets(shingle), "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")))
    # The first hub of a bucket is the node with the fullest buckets: copies resemble their source more than each other.
    degree = members.groupBy("node").agg(F.sum("k").alias("degree"))
    hubs = members.join(degree, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct("degree", "node")).alias("hub"))
    pairs = _by_bucket(members, hubs).where((F.col("node") != F.col("hub.node")) & _alike(F.col("n"), F.col("hub.n"), percent))
    pairs = pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    tried = _verified(pairs, sets, percent)
    failed, labels = tried.where("not linked").select("a", "b"), None
    if tried.where("linked").limit(1).count():
        labels = _merged(None, tried.where("linked").select("a", "b"))
    labelled = stash(_labelled(members.select("bucket", "node", "n"), labels))
    nodes_left = stash(_mixed(labelled).select("node", "n").distinct())
    with arrow_rows(docs.sparkSession, 500):
        prefixes, share = _prefixes(nodes_left, sets, percent), 4
    while True:
        live = _open(prefixes, labels, percent)
        tops = stash(_top_labels(live))
        left = tops.agg(F.sum("pairs")).first()[0]
        if not left:
            break  # no open bucket is mixed
        last = left <= 4 * n_members  # no more than in proportion to the input
        hubs, closed = _hubs(live, tops, share, last)
        shared = _overlap(F.col("n"), F.col("hub_n"), percent)
        suits = (F.col("rank") <= F.col("n") - shared + 1) & (F.col("hub_rank") <= F.col("hub_n") - shared + 1)
        pairs = _by_bucket(live, hubs).where((F.col("label") != F.col("hub_label")) & _alike(F.col("n"), F.col("hub_n"), percent) & suits)
        pairs = pairs.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct().join(failed, ["a", "b"], "left_anti")
        tried = _verified(pairs, sets, percent)
        if tried.where("linked").limit(1).count():
            labels = _merged(labels, tried.where("linked").select("a", "b"))
        if last:
            break
        failed = failed.unionByName(tried.where("not linked").select("a", "b"))
        prefixes = stash(_by_bucket(prefixes, closed, "left_anti"))
        share *= 4
    named = nodes.select("node", "least_id")
    if labels is None:
        classes = named.select("node", F.col("node").alias("label"), F.col("least_id").alias("component_id"))
    else:
        named = stash(named.join(labels, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("label")))
        # Only components of several nodes need a look; a table of them meets their rows where they are, while it is small.
        tops = stash(named.groupBy("label").agg(F.min("least_id").alias("top"), F.count("*").alias("c")).where("c > 1").select("label", "top"))
        classes = keyed(named, tops, "label", "left", most=200_000).select("node", "label", F.coalesce("top", "least_id").alias("component_id"))
    return signed.select("doc_id", "_text_a", "_text_b", "n_shingles", "node").join(classes, "node", "left").drop("node")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. Ids are numbers.

    component_id is the smallest doc_id of the component; kept marks the rows
    that have it as their own. A component without any doc_id keeps its rows,
    with a null component_id. Rows that share an id are told apart by their
    texts: each has the component of its own text.
    """
    out = _classified(docs, shingle, percent, id_col, text_col)
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component left: one with its smallest id, by a hash of the text where several have it.

    A null id is larger than any other. Rows without words are no copies and
    stay. Rows are told apart by id and text: of rows equal in both, one stays,
    whichever its other columns are.
    """
    key = ["doc_id", "_text_a", "_text_b"]
    found = stash(_classified(docs, shingle, percent, id_col, text_col).where("label is not null").groupBy("label", *key).agg(F.count("*").alias("n")))
    first = F.struct(F.col("doc_id").isNull(), *key)
    best = stash(found.groupBy("label").agg(F.min(first).alias("best"), F.count("*").alias("c")).where("c > 1").select("label", "best"))
    ranked = stash(keyed(found, best, "label", "left", most=200_000).select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_no_id"), *key[1:], F.coalesce(first == F.col("best"), F.lit(True)).alias("best"), "n"))
    on = ["_id", "_no_id", *key[1:]]
    id_key = [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_id"), F.col(id_col).isNull().alias("_no_id")]
    rows = docs.select(F.struct("*").alias("_row"), *id_key, *_digests(F.col(text_col)))  # no name of ``docs`` can clash
    rows = keyed(rows, stash(ranked.where("not best").select(*on)), on, "left_anti")
    twice = stash(ranked.where("best and n > 1").select(*on))
    if twice.limit(1).count():
        rows = keyed(rows, twice, on, "left_anti").unionByName(keyed(rows, twice, on, "left_semi").dropDuplicates(on))
    return rows.select("_row.*")
