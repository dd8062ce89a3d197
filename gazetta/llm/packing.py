"""Best-fit packing of tokenised documents by hierarchical residual packing.

Partitions tokenise their documents, cut those that are too long, and pack
the pieces best-fit by falling length. Nearly full bins are final. Underfull
bins go on as items: a few partitions' bins meet in one task, are packed
best-fit again, and so on up a tree until one task holds the rest or a round
no longer saves a bin.

A null text is an empty document of one end token. Rows are packed as they
come: repeated rows are packed as often as they occur, null ids are kept. Ids
are numbers; other columns than id and text are not read.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetta.llm.common import as_bytes, slices
from gazetta.session import stash

MEMBER = "struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>"
ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


class Tokens:
    """Ids of texts, remembered by word.

    For texts of ASCII and Latin letters the tokenizer's own rule for words is
    applied here, to the lower-cased text, and every distinct word is encoded
    once. Texts with other characters, or with the text of a special token,
    are encoded whole. Two generations of words are kept: frequent ones move
    on to the next, so memory is bounded and rarely cold.
    """

    #: The tokenizer's rule, for the characters that OTHER lets pass.
    WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u012f]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u012f]+")
    OTHER = re.compile(r"[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]|<\|")

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids end a word.
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = most

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_words(self, words: list[str], together: int = 200) -> list[bytes]:
        """Ids of each word. Words are encoded many to a text, with a space between, and cut after the ids that end a word."""
        runs = [words[at : at + together] for at in range(0, len(words), together)]
        out: list[bytes] = []
        for at in range(0, len(runs), 64):
            part = runs[at : at + 64]
            for run, ids in zip(part, self._encoded([" ".join(run) for run in part]), strict=True):
                cuts = (4 * np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 4).tolist()
                if len(cuts) == len(run) and cuts[-1] == len(ids):
                    out += [ids[x:y] for x, y in zip([0, *cuts], cuts)]
                else:  # a vocabulary without ends of words
                    out += self._encoded(run)
        return out

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.words) > self.most:
            self.older, self.words = self.words, {}
        said = [t.decode() for t in texts]
        whole = {i: ids for i, t in enumerate(said) if self.OTHER.search(t) for ids in self._encoded([t])}
        split = [[] if i in whole else self.WORD.findall(t.lower()) for i, t in enumerate(said)]
        words, older = self.words, self.older
        fresh = set().union(*split).difference(words)
        known = fresh.intersection(older)
        words.update((w, older[w]) for w in known)
        fresh = list(fresh - known)
        words.update(zip(fresh, self._encoded_words(fresh), strict=True))
        get = words.__getitem__
        return [whole[i] if i in whole else b"".join(map(get, w)) for i, w in enumerate(split)]


#: One memory for all tasks of a worker process.
_TOKENS: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    # A task has one core; the tokenizer's own threads would only wait for each other.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    room: list[int] = []  # open bins' room, ascending, and which bins they are
    which: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(room, n)
        if at < len(room):
            left, b = room.pop(at) - n, which.pop(at)
            bins[b].append(i)
        else:
            left, b = size - n, len(bins)
            bins.append([i])
        if left:
            at = bisect.bisect_left(room, left)
            room.insert(at, left)
            which.insert(at, b)
    return bins


def _packed(items: list[tuple[int, list[dict]]], size: int, full: int, last: bool) -> pa.RecordBatch:
    lengths = np.array([n for n, _ in items], np.int64)
    used, members = [], []
    for b in best_fit(lengths, size):
        used.append(int(lengths[b].sum()))
        inside, at = [m for i in b for m in items[i][1]], 0
        for m in inside:
            m["offset"] = at
            at += m["length"]
        members.append(inside)
    return pa.RecordBatch.from_pydict({"used": pa.array(used, pa.int64()), "final": pa.array([last or n >= full for n in used], pa.bool_()), "members": pa.array(members, pa.list_(ITEM))})


BINS = f"used long, final boolean, members array<{MEMBER}>"


def _first(path: str, size: int, full: int, end_id: int, together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        end = np.array([end_id], "<u4").tobytes()
        items: list[tuple[int, list[dict]]] = []
        for batch in slices(batches, 512):
            found = tokens.texts([t or b"" for t in as_bytes(batch.column("text"))])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    items.append((len(part) // 4, [{"doc_id": doc_id, "piece": piece, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}]))
            if len(items) >= together:
                yield _packed(items, size, full, False)
                items = []
        if items:
            yield _packed(items, size, full, False)

    return run


def _again(size: int, full: int, last: bool, together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[int, list[dict]]] = []
        held = 0
        for batch in slices(batches, 1024):
            part = batch.column("members").to_pylist()
            items += zip(batch.column("used").to_pylist(), part, strict=True)
            held += sum(map(len, part))
            if len(items) >= together or held >= 4 * together:
                yield _packed(items, size, full, last)
                items, held = [], 0
        if items:
            yield _packed(items, size, full, last)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, nearly: float = 0.998, together: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file on every node, ``together``
    the most items that a task packs at once (and a quarter of the most pieces in them), ``nearly`` the share from which
    a bin counts as full.
    """
    full = math.ceil(size * nearly)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bins = stash(source.mapInArrow(_first(tokenizer, size, full, end_id, together), BINS))
    done = [bins.where("final")]
    while True:
        rest = bins.where("not final")
        n, held = rest.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        parts = max(1, math.ceil(n / (together / 4)), math.ceil(held / together))
        last = parts == 1
        # Bins of a task differ in fill; dealing them by a hash of their places in the files mixes them, equal rows too.
        dealt = rest.repartition(parts, F.xxhash64(F.monotonically_increasing_id()))
        bins = stash(dealt.mapInArrow(_again(size, full, last, together), BINS))
        if not last and bins.count() > 0.98 * n:
            done.append(bins)
            break
        done.append(bins.where("final"))
        if last:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    numbered = out.select(F.monotonically_increasing_id().alias("sequence_id"), "members")  # before the explode: one number a bin
    return numbered.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
