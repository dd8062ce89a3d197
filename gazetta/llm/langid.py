"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text (ASCII letters lower-cased), marks,
digits and spaces included, in windows of ``WIDTH`` bytes and labels every byte
position; a document's probabilities are the mean over all positions of all
its windows. States start anew at each window, never at a word, so what
crosses words is read too, and a text of any length takes bounded memory.

Training is by backpropagation through time in numpy, on windows of a bounded
sample of documents of each language, so that a rare language is learned like
a common one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazetta.llm.common import as_bytes, draw, draw_bits, keyed, slices
from gazetta.session import stash

WIDTH = 64
UNKNOWN = "und"
ASCII_LETTER = re.compile(rb"[a-zA-Z]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of bytes padded with 0, their lengths, which text each is of), in the order of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WIDTH)
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = np.frombuffer(b"".join(t.lower().ljust(int(n) * WIDTH, b"\0") for t, n in zip(texts, counts, strict=True)), np.uint8)
    return flat.reshape(-1, WIDTH), np.minimum(WIDTH, sizes[owner] - at * WIDTH), owner


class Network:
    """Byte embedding, a gated recurrent layer in each direction, a softmax at every position."""

    def __init__(self, classes: int, hidden: int = 12, embed: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {"e": rng.normal(0, 0.3, (256, embed)), "v": rng.normal(0, 0.2, (2 * hidden, classes)), "c": np.zeros(classes)}
        for d in "fb":
            self.p |= {"w" + d: rng.normal(0, 1 / np.sqrt(embed), (embed, 3 * hidden)), "u" + d: rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)), "d" + d: np.zeros(3 * hidden)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _layer(self, d: str, x: np.ndarray, mask: np.ndarray, order: range, keep: bool) -> tuple[np.ndarray, list]:
        p, k = self.p, self.h
        state, out, tape = np.zeros((len(x), k), np.float32), np.zeros((*mask.shape, k), np.float32), []
        pre = x @ p["w" + d] + p["d" + d]
        for t in order:
            rec = state @ p["u" + d][:, : 2 * k]
            zr = _sigmoid(pre[:, t, : 2 * k] + rec)
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(pre[:, t, 2 * k :] + (r * state) @ p["u" + d][:, 2 * k :])
            m = mask[:, t, None]
            new = np.where(m, z * state + (1 - z) * n, state)
            if keep:
                tape.append((t, state, z, r, n, m))
            state = out[:, t] = new
        return out, tape

    def forward(self, b: np.ndarray, lengths: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        width = int(lengths.max(initial=1))
        b = b[:, :width]
        mask = np.arange(width) < lengths[:, None]
        x = self.p["e"][b]
        f, tf = self._layer("f", x, mask, range(width), keep)
        g, tg = self._layer("b", x, mask, range(width - 1, -1, -1), keep)
        h = np.concatenate([f, g], axis=2)
        s = h @ self.p["v"] + self.p["c"]
        s -= s.max(axis=2, keepdims=True)
        y = np.exp(s)
        y /= y.sum(axis=2, keepdims=True)
        return y, (b, x, mask, h, tf, tg)

    def gradients(self, b: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        y, (b, x, mask, h, tf, tg) = self.forward(b, lengths)
        p, k = self.p, self.h
        g = {n: np.zeros_like(v) for n, v in p.items()}
        ds = (y - target[:, None, :]) * mask[:, :, None] / mask.sum()
        g["v"] = np.tensordot(h, ds, ((0, 1), (0, 1)))
        g["c"] = ds.sum((0, 1))
        dh, dx = ds @ p["v"].T, np.zeros_like(x)
        for d, tape, part in (("f", tf, dh[:, :, :k]), ("b", tg, dh[:, :, k:])):
            u, w, carry = p["u" + d], p["w" + d], np.zeros((len(x), k), np.float32)
            for t, state, z, r, n, m in reversed(tape):
                up = carry + part[:, t]
                new = np.where(m, up, 0)
                dn = new * (1 - z) * (1 - n * n)
                drs = dn @ u[:, 2 * k :].T
                dzr = np.concatenate([new * (state - n) * z * (1 - z), drs * state * r * (1 - r)], axis=1)
                carry = np.where(m, new * z + drs * r + dzr @ u[:, : 2 * k].T, up)
                pre = np.concatenate([dzr, dn], axis=1)
                g["u" + d][:, : 2 * k] += state.T @ dzr
                g["u" + d][:, 2 * k :] += (r * state).T @ dn
                g["w" + d] += x[:, t].T @ pre
                g["d" + d] += pre.sum(0)
                dx[:, t] += pre @ w.T
        np.add.at(g["e"], b, dx)
        return g

    def fit(self, b: np.ndarray, lengths: np.ndarray, label: np.ndarray, steps: int, batch: int = 192, rate: float = 0.01, seed: int = 5) -> None:
        """Adam; a batch draws languages evenly, and cuts windows short at random, as texts can be."""
        rng = np.random.default_rng(seed)
        classes = len(self.p["c"])
        own = [np.flatnonzero(label == i) for i in range(classes)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for i in range(1, steps + 1):
            at = np.array([own[k][rng.integers(len(own[k]))] for k in rng.integers(classes, size=batch)])
            short = np.where(rng.random(batch) < 0.5, rng.integers(4, WIDTH + 1, batch), WIDTH)
            lr = rate * min(1, 2 * (1 - (i - 1) / steps))
            for k, g in self.gradients(b[at], np.minimum(lengths[at], short), np.eye(classes, dtype=np.float32)[label[at]]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)

    def _states(self, d: str, b: np.ndarray, mask: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        """(t, state by unit, then window) along one direction; b and mask by time, then window. The state is zero where padding comes first."""
        p, k = self.p, self.h
        half = np.repeat(np.array([0.5, 1], np.float32), [2 * k, k])  # a sigmoid is a tanh of half its input
        inputs = np.ascontiguousarray(((p["e"] @ p["w" + d] + p["d" + d]) * half).T)
        u = np.ascontiguousarray((p["u" + d] * half).T)
        gates, news = u[: 2 * k], u[2 * k :]
        n = b.shape[1]
        state, zr, new, x = (np.zeros((rows, n), np.float32) for rows in (k, 2 * k, k, 3 * k))
        for t in range(len(b)) if d == "f" else range(len(b) - 1, -1, -1):
            np.take(inputs, b[t], axis=1, out=x, mode="clip")
            np.matmul(gates, state, out=zr)
            zr += x[: 2 * k]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            zr[k:] *= state
            np.matmul(news, zr[k:], out=new)
            new += x[2 * k :]
            np.tanh(new, out=new)
            state -= new
            state *= zr[:k]
            state += new
            if mask is not None:
                state *= mask[t]
            yield t, state

    def pooled(self, b: np.ndarray, lengths: np.ndarray, block: int = 1024) -> np.ndarray:
        """For each window the sum of its positions' probabilities."""
        out = np.zeros((len(b), len(self.p["c"])), np.float32)
        order = np.argsort(-lengths, kind="stable")  # full windows first: their blocks need no mask
        forth, back = np.ascontiguousarray(self.p["v"][: self.h].T), np.ascontiguousarray(self.p["v"][self.h :].T)
        for at in range(0, len(b), block):
            rows = order[at : at + block]
            width = int(lengths[rows[0]])
            x = np.ascontiguousarray(b[rows, :width].T)
            mask = None if lengths[rows[-1]] == width else (np.arange(width)[:, None] < lengths[rows]).astype(np.float32)
            s = np.empty((width, out.shape[1], len(rows)), np.float32)
            for t, state in self._states("f", x, None):
                np.matmul(forth, state, out=s[t])
            for t, state in self._states("b", x, mask):
                s[t] += back @ state
            s += self.p["c"][:, None]
            s -= s.max(axis=1, keepdims=True)
            np.exp(s, out=s)
            s /= s.sum(axis=1, keepdims=True)
            if mask is not None:
                s *= mask[:, None, :]
            out[rows] = s.sum(0).T
        return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    network: Network | None


def _windows(per_doc: int):
    """(lang, window, n): up to ``per_doc`` windows of each text, evenly spaced over all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            b, lengths, owner = encode([t or b"" for t in as_bytes(batch.column("text"))])
            counts = np.bincount(owner, minlength=batch.num_rows)
            first = np.cumsum(counts) - counts
            rows = np.concatenate([np.empty(0, np.int64), *[f + np.unique(np.linspace(0, n - 1, per_doc).astype(np.int64)) for f, n in zip(first, counts, strict=True) if n]])
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang").take(pa.array(owner[rows])), "window": pa.array([x.tobytes() for x in b[rows]], pa.binary()), "n": pa.array(lengths[rows])})

    return run


def fit_languages(docs: DataFrame, max_docs: int = 500, per_doc: int = 12, steps: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on ``max_docs`` documents of each language, and ``per_doc`` windows of each of them, at most.

    A language is learned if any of its texts has a byte. Repeated rows count
    as often as they occur, up to the bound.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    # Ids are hashed with the text: rows without an id are drawn like others.
    key = [F.col("id"), F.substring("text", 1, 200)]
    # The drawn number may have as many bits as leave ``max_docs`` rows of the language or just more: a narrow count, then a cut for each language.
    counts = known.groupBy("lang", draw_bits(*key).alias("bits")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("lang").orderBy("bits"))
    cuts = stash(counts.withColumn("upto", running).groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= max_docs, F.col("bits"))), F.max("bits")).alias("most")))
    near = keyed(known, cuts, "lang", "inner").where(draw_bits(*key) <= F.col("most"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(draw(*key)))
    sample = near.withColumn("place", first).where(F.col("place") <= max_docs).select("lang", "text")
    rows = sample.mapInArrow(_windows(per_doc), "lang string, window binary, n long").groupBy("lang", "window", "n").agg(F.count("*").alias("times"))
    # What reaches the driver is bounded for each language on its own.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("window"), "window", "n"))
    rows = rows.withColumn("place", place).where(F.col("place") <= max_docs * per_doc).orderBy(F.xxhash64("window"), "window", "lang").collect()
    languages = sorted({r["lang"] for r in rows})
    if len(languages) < 2:
        return LanguageModel(languages, None)
    place = {x: i for i, x in enumerate(languages)}
    b = np.frombuffer(b"".join(r["window"] for r in rows), np.uint8).reshape(-1, WIDTH)
    network = Network(len(languages))
    network.fit(b, np.array([r["n"] for r in rows], np.int64), np.array([place[r["lang"]] for r in rows]), steps)
    return LanguageModel(languages, network)


def _has_letter(text: bytes) -> bool:
    import regex

    return bool(ASCII_LETTER.search(text) or regex.search(r"\p{L}", text.decode("utf-8", "replace")))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per row. A text without a letter, or null, is ``und`` with score 0.

    With one learned language every other text gets it with score 1; with
    none, every text is ``und``. Of equal probabilities the language that
    sorts first counts. Repeated rows get equal answers.
    """
    languages = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            found = [i for i, t in enumerate(texts) if languages and _has_letter(t)]
            if model.network is None:
                for i in found:
                    pred[i], score[i] = languages[0], 1.0
            elif found:
                b, lengths, owner = encode([texts[i] for i in found])
                total = np.zeros((len(found), len(languages)))
                np.add.at(total, owner, model.network.pooled(b, lengths))
                total /= np.maximum(1, np.array([len(texts[i]) for i in found]))[:, None]
                for i, y in zip(found, total, strict=True):
                    best = int(y.argmax())
                    pred[i], score[i] = languages[best], float(min(1.0, y[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
