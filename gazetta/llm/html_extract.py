"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks, each with the path of its open
block elements. Every leaf has a vector of hashed path parts, hashed words
and a few measures. A bidirectional LSTM in numpy reads the whole sequence and
labels every block as main text or not; blocks labelled main text are joined
in page order.

There are no labels to learn from, so a bounded sample of pages is labelled
by rules on element names and classes, or by text density where a page names
nothing. Training also sees those pages with other names for the same parts
and with further kinds of boilerplate put in, so that the network learns from
words, context and many namings, not one page layout.

Comments, scripts, styles, and what else never shows are no blocks. A null or
empty page has an empty text.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetta.llm.common import bounded_sample, slices

#: Fixed values of HTML: elements that start a block, whose content is no markup, or that have no end tag.
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style template noscript iframe object svg math textarea title xmp noembed noframes".split())
RAW = HIDDEN - frozenset("template object svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag with quoted attributes, and one that ends at the first angle bracket whatever the quotes say.
TAG = re.compile(r"</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
BARE_TAG = re.compile(r"</?[A-Za-z][^>]*+>")
END_TAGS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
SCRIPT = re.compile(r"<!(?=--)|-->|</?script(?=[\s/>])", re.I)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

PATH, WORDS = 48, 16
MEASURES = 8
WIDTH = PATH + WORDS + MEASURES

MAIN_NAMES = ("article", "main", "content", "post", "entry", "story", "body-text", "article-body", "main-content", "post-content", "entry-content", "story-body")
SIDE_NAMES = {
    "menu": ("nav", "div.menu", "ul.nav", "div.navbar", "div#navigation", "div.breadcrumb"),
    "header": ("header", "div.header", "div#masthead", "div.site-header", "div.topbar"),
    "footer": ("footer", "div.footer", "div#footer", "div.site-footer", "div.copyright"),
    "sidebar": ("aside", "div.sidebar", "aside.related", "div#sidebar", "div.widget", "section.related"),
    "notice": ("div.cookie", "div.cookie-notice", "div.notice", "div.banner", "div.alert", "div.popup", "div.modal", "div.newsletter"),
    "advert": ("div.ad", "div.ads", "aside.advert", "div.sponsored", "div.promo", "div.advertisement"),
    "form": ("form", "form.search", "form.signup", "div.form", "div.subscribe"),
    "comments": ("section.comments", "div.comments", "div#comments", "ol.commentlist", "div.comment", "div.replies", "article.comment"),
}
SIDE_WORDS = frozenset("nav menu navbar navigation breadcrumb breadcrumbs header masthead topbar footer copyright aside sidebar related widget cookie cookies consent notice banner alert popup modal newsletter ad ads advert adverts advertisement sponsored sponsor promo form search signup subscribe login share social comment comments commentlist replies reply respond disqus recommended trending tags legal disclaimer toolbar pagination pager".split())
MAIN_WORDS = frozenset("article main content post entry story".split())


def raw_end(page: str, name: str, at: int, nested: bool = True) -> tuple[int, bool]:
    """Where raw content from ``at`` on ends with its end tag, the page's end if it has none; and whether comments in scripts still count.

    A script inside a comment inside a script has an end tag of its own. Where
    such a comment is never closed, the first end tag counts, for later
    scripts too, so that a page is not read again and again.
    """
    nested = nested and name == "script"
    first, depth = -1, 0  # 1: in a comment, 2: in a script inside it
    for m in (SCRIPT if nested else END_TAGS[name]).finditer(page, at):
        t = m[0]
        if t == "<!":
            depth = depth or 1
        elif t == "-->":
            depth = 0
        elif t[1] != "/":
            depth = 2 if depth else 0
        else:
            first = m.start() if first < 0 or depth < 2 else first
            if depth < 2:
                return page.find(">", first) + 1 or len(page), True
            depth = 1
    return (page.find(">", first) + 1 or len(page)) if first >= 0 else len(page), False


class Open:
    """Open block elements: names, names with their marks, and how often each name is open."""

    #: Of deeper nests a block's path has the outermost and innermost elements.
    OUTER, INNER = 8, 24

    def __init__(self) -> None:
        self.bare: list[str] = []
        self.full: list[str] = []
        self.count: dict[str, int] = {}

    def push(self, name: str, full: str) -> None:
        self.bare.append(name)
        self.full.append(full)
        self.count[name] = self.count.get(name, 0) + 1

    def pop(self) -> str:
        name = self.bare.pop()
        self.full.pop()
        self.count[name] -= 1
        return name

    def close(self, name: str) -> None:
        if self.count.get(name):
            while self.pop() != name:
                pass

    def path(self) -> tuple[str, ...]:
        deep = len(self.full) > self.OUTER + self.INNER
        return tuple(self.full[: self.OUTER] + self.full[-self.INNER :] if deep else self.full)


#: Fixed values of HTML: elements that an open element of the same family ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}


def leaves(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of the text in links) of every block that has text, in page order. Time is linear in the page."""
    out, text, linked, in_link = [], [], 0, 0
    opened, hidden, depth = Open(), "", 0
    quoted, nested = True, True

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        if words and not opened.count.get("head"):
            out.append((opened.path(), words, min(1.0, linked / len(words))))
        text.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            t = html.unescape(raw)
            text.append(t)
            linked += len(t) if in_link else 0

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        left = page.find("<", at)
        if left < 0 or left > last:  # no tag ends after this
            rest = page[at:]
            odd = re.search(r"<[!?]", rest)
            said(rest[: odd.start()] if odd else rest)
            if odd and rest.startswith("<![CDATA[", odd.start()) and not hidden:
                text.append(rest[odd.start() + 9 :])
            break
        said(page[at:left])
        if page.startswith("<!--", left):
            at = page.find("-->", left + 4) + 3
            at = at if at > 2 else size
            continue
        if page.startswith("<![CDATA[", left):
            at = page.find("]]>", left + 9)
            if not hidden:
                text.append(page[left + 9 : at if at >= 0 else size])
            at = at + 3 if at >= 0 else size
            continue
        if page[left + 1 : left + 2] in ("!", "?"):
            at = page.find(">", left) + 1 or size
            continue
        m = TAG.match(page, left) if quoted else None
        if m is None:
            m = BARE_TAG.match(page, left)
            if m is None:
                said("<")
                at = left + 1
                continue
            quoted = False  # a quote is open to the page's end: quotes count no more
        t, at = m[0], m.end()
        name, closing = NAME.match(t)[1].lower(), t[1] == "/"
        if name in RAW and not closing:
            if name in BLOCKS and not hidden:
                flush()
            if not t.endswith("/>"):
                at, still = raw_end(page, name, at, nested)
                nested = nested and (still or name != "script")
        elif hidden:
            if name == hidden and not t.endswith("/>"):
                depth += -1 if closing else 1
                hidden = hidden if depth else ""
        elif name in HIDDEN:
            if not closing and not t.endswith("/>"):
                hidden, depth = name, 1
        elif name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS:
            flush()
            if closing:
                opened.close(name)
                in_link = 0
                continue
            if opened.bare and opened.bare[-1] == "p":
                opened.pop()
            while opened.bare and opened.bare[-1] in ENDS.get(name, ()):
                opened.pop()
            if name == "body":
                opened.close("head")
            if name not in VOID:
                marks = [w for a in ATTRIBUTE.finditer(t) for w in (a[2] or a[3] or a[4] or "").lower().split()]
                opened.push(name, ".".join([name, *marks]))
    flush()
    return out


def _parts(path: tuple[str, ...]) -> list[str]:
    """Element names, whole class and id names, and their parts at hyphens and underscores; the last two once more, as such."""
    out = []
    for depth, x in enumerate(reversed(path)):
        pieces = x.split(".")
        out += pieces
        out += [w for p in pieces[1:] for w in re.split(r"[-_]", p) if w != p]
        if depth < 2:
            out += [f"{depth}:{p}" for p in pieces]
    return out


class Buckets(dict):
    """String to a place in a vector and a sign, remembered up to a limit."""

    def __init__(self, size: int, limit: int = 200_000):
        super().__init__()
        self.size, self.limit = size, limit

    def __missing__(self, x: str) -> tuple[int, float]:
        if len(self) >= self.limit:
            self.clear()
        h = zlib.crc32(x.encode("utf-8", "replace"))
        got = self[x] = (h % self.size, 1.0 if h >> 16 & 1 else -1.0)
        return got


class Vectors:
    def __init__(self) -> None:
        self.paths, self.words = {}, Buckets(WORDS)

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 50_000:
                self.paths.clear()
            v = np.zeros(PATH, np.float32)
            for part in _parts(path):
                for salt in "ab":
                    h = zlib.crc32((salt + part).encode("utf-8", "replace"))
                    v[h % PATH] += 1.0 if h >> 16 & 1 else -1.0
            self.paths[path] = np.clip(v / 2, -2, 2)
        return self.paths[path]

    def page(self, blocks: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
        out = np.zeros((len(blocks), WIDTH), np.float32)
        for i, (path, text, linked) in enumerate(blocks):
            out[i, :PATH] = self.path(path)
            words = text.split(" ")
            at = np.array([self.words[w] for w in words])
            out[i, PATH : PATH + WORDS] = np.bincount(at[:, 0].astype(np.int64), at[:, 1], WORDS) / np.sqrt(len(words)) / 2
            out[i, PATH + WORDS :] = (np.log1p(len(words)) / 4, np.log1p(len(text)) / 6, linked, text[-1] in ".!?\"'", i / len(blocks), len(path) / 8, sum(map(str.isdigit, text)) / len(text), "©" in text)
        return out


def rule(blocks: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """Labels for training: the nearest ancestor that names a part decides; pages that name none go by density."""
    got, named = [], False
    for path, text, linked in blocks:
        label = 0
        for x in reversed(path):
            words = {w for p in x.split(".") for w in re.split(r"[-_]", p)}
            if words & SIDE_WORDS:
                break
            if words & MAIN_WORDS:
                # A main part inside a side part, as a comment's article, is no main text.
                outer = {w for y in path[: path.index(x)] for p in y.split(".") for w in re.split(r"[-_]", p)}
                label, named = int(not outer & SIDE_WORDS), True
                break
        got.append(label)
    if not named:
        got = [int(len(t.split()) >= 8 and share < 0.3 and not any({w for p in x.split(".") for w in re.split(r"[-_]", p)} & SIDE_WORDS for x in path)) for path, t, share in blocks]
    return np.array(got, np.float32)


def variants(pages: list[list[tuple[tuple[str, ...], str, float]]], seed: int = 11, copies: int = 3) -> list[tuple[list, np.ndarray]]:
    """Pages as they are, and copies with other names for their parts and more boilerplate put in."""
    rng = np.random.default_rng(seed)
    short = [b[1] for p in pages for b in p if len(b[1]) < 200] or ["text"]

    def pick(names):
        return names[int(rng.integers(len(names)))]

    out = []
    for page in pages:
        labels = rule(page)
        out.append((page, labels))
        for _ in range(copies):
            main = pick(("article", "main", "div." + pick(MAIN_NAMES), "div#" + pick(MAIN_NAMES), "section." + pick(MAIN_NAMES), "article." + pick(MAIN_NAMES))).replace("#", ".")
            new, got = [], []

            def put(kind: str, where: tuple[str, ...]) -> None:
                base = (*where, pick(SIDE_NAMES[kind]).replace("#", "."))
                inner = {"menu": ("ul", "li"), "comments": ("div.comment",), "form": ("p",)}.get(kind, ())
                for _ in range(int(rng.integers(1, 5))):
                    tail = (*inner, *(("p",) if rng.random() < 0.5 else ()))
                    new.append(((*base, *tail), pick(short), float(kind == "menu" or rng.random() < 0.15)))
                    got.append(0.0)

            body = ("html", "body", *(("div.wrapper",) if rng.random() < 0.3 else ()))
            for kind in ("notice", "header", "menu", "advert"):
                if rng.random() < 0.4:
                    put(kind, body)
            for (path, text, share), label in zip(page, labels, strict=True):
                if label:
                    tail = tuple(x for x in path if x.partition(".")[0] in ("p", "h1", "h2", "h3", "ul", "li", "blockquote", "td", "tr", "table"))
                    if rng.random() < 0.04:
                        put(pick(("advert", "sidebar", "notice", "form")), (*body, main))
                    new.append(((*body, main, *tail[-3:]), text, share))
                    got.append(1.0)
                elif rng.random() < 0.5:
                    new.append((path, text, share))
                    got.append(0.0)
            for kind in ("comments", "sidebar", "form", "footer", "advert"):
                if rng.random() < 0.4:
                    put(kind, (*body, main) if rng.random() < 0.3 else body)
            out.append((new, np.array(got, np.float32)))
    return out


class Labeller:
    """An LSTM in each direction over a page's leaves, and a logistic unit for each leaf."""

    def __init__(self, hidden: int = 16, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {"v": rng.normal(0, 0.2, (2 * hidden + WIDTH, 1)), "c": np.zeros(1)}
        for d in "fb":
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1
            self.p |= {"w" + d: rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * hidden)), "u" + d: rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)), "d" + d: bias}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _layer(self, d: str, x: np.ndarray, mask: np.ndarray, order: range, keep: bool) -> tuple[np.ndarray, list]:
        k, u = self.h, self.p["u" + d]
        state, cell = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
        out, tape = np.zeros((*mask.shape, k), np.float32), []
        pre = x @ self.p["w" + d] + self.p["d" + d]
        for t in order:
            a = pre[:, t] + state @ u
            gates = 0.5 * np.tanh(0.5 * a[:, : 3 * k]) + 0.5
            i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(a[:, 3 * k :])
            m = mask[:, t, None]
            new = f * cell + i * g
            th = np.tanh(new)
            if keep:
                tape.append((t, state, cell, i, f, o, g, th, m))
            cell = np.where(m, new, cell)
            state = np.where(m, o * th, state)
            out[:, t] = state
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        n = mask.shape[1]
        f, tf = self._layer("f", x, mask, range(n), keep)
        b, tb = self._layer("b", x, mask, range(n - 1, -1, -1), keep)
        h = np.concatenate([f, b, x], axis=2)
        y = 0.5 * np.tanh(0.5 * (h @ self.p["v"] + self.p["c"])[:, :, 0]) + 0.5
        return y, h, tf, tb

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        y, h, tf, tb = self.forward(x, mask, True)
        k, p = self.h, self.p
        g = {n: np.zeros_like(v) for n, v in p.items()}
        ds = ((y - target) * mask / mask.sum())[:, :, None]
        g["v"], g["c"] = np.tensordot(h, ds, ((0, 1), (0, 1))), ds.sum((0, 1))
        dh = ds @ p["v"].T
        for d, tape, part in (("f", tf, dh[:, :, :k]), ("b", tb, dh[:, :, k : 2 * k])):
            up, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            for t, state, cell, i, f, o, c, th, m in reversed(tape):
                got = up + part[:, t]
                new = np.where(m, got, 0)
                dcell = np.where(m, dc, 0) + new * o * (1 - th * th)
                da = np.concatenate([dcell * c * i * (1 - i), dcell * cell * f * (1 - f), new * th * o * (1 - o), dcell * i * (1 - c * c)], axis=1)
                up = np.where(m, da @ p["u" + d].T, got)
                dc = np.where(m, dcell * f, dc)
                g["u" + d] += state.T @ da
                g["w" + d] += x[:, t].T @ da
                g["d" + d] += da.sum(0)
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 400, batch: int = 24, rate: float = 0.01, seed: int = 4) -> None:
        """Adam; a batch holds pages of like length."""
        rng = np.random.default_rng(seed)
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for n in range(1, steps + 1 if pages else 1):
            at = int(rng.integers(max(1, len(pages) - batch + 1)))
            x, mask, y = padded(pages[at : at + batch])
            lr = rate * min(1, 2 * (1 - (n - 1) / steps))
            for k, g in self.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.99**n)) + 1e-7)).astype(np.float32)

    def label(self, pages: list[np.ndarray], room: int = 40_000) -> list[np.ndarray]:
        """A probability for each leaf. Pages are read in blocks of like length of ``room`` leaves, or one longer page."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            take = 1
            while take < len(order) and (take + 1) * len(pages[order[take]]) <= room:
                take += 1
            part, order = order[:take], order[take:]
            x, mask, _ = padded([(pages[i], np.zeros(len(pages[i]), np.float32)) for i in part])
            y = self.forward(x, mask)[0]
            for j, i in enumerate(part):
                out[i] = y[j, : len(pages[i])]
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = max(len(x) for x, _ in pages)
    x, mask, y = np.zeros((len(pages), n, WIDTH), np.float32), np.zeros((len(pages), n), bool), np.zeros((len(pages), n), np.float32)
    for i, (a, b) in enumerate(pages):
        x[i, : len(a)], mask[i, : len(a)], y[i, : len(a)] = a, True, b
    return x, mask, y


def fit_labeller(pages: DataFrame, max_pages: int = 150, max_chars: int = 200_000, steps: int = 400, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    """Fit on ``max_pages`` pages of up to ``max_chars`` characters at most."""
    rows = bounded_sample(pages.where(F.col(html_col).isNotNull() & (F.length(html_col) <= max_chars)).select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), F.col("id"), max_pages).limit(2 * max_pages).collect()
    parsed = [x for x in (leaves(r["html"]) for r in sorted(rows, key=lambda r: (r["id"] is None, r["id"], r["html"]))) if x]
    vectors, out = Vectors(), Labeller()
    out.fit([(vectors.page(p), y) for p, y in variants(parsed)], steps)
    return out


def extract_text(pages: DataFrame, labeller: Labeller, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` with the main text of the whole html; other columns pass through."""
    if text_col in pages.columns:
        raise ValueError(f"{text_col} is a column already; name another")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in slices(batches, 256):
            parsed = [leaves(p or "") for p in batch.column(html_col).to_pylist()]
            labels = labeller.label([vectors.page(p) for p in parsed])
            text = [" ".join(b[1] for b, y in zip(p, got, strict=True) if y >= 0.5) for p, got in zip(parsed, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, text_col])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(text_col, T.StringType())]))
