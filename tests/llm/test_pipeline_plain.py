"""The pipeline's stages, each against a plain version of it in Python on the same input, and all of them together."""

import random
import re
import zlib

import numpy as np
import pytest
from test_overlaps import all_pairs

import corpus_pipeline

public = pytest.importorskip("public_tokenizers")

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)")
OTHERS = (re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}"))


def without_copies(rows):
    """All pairs of five-word shingle sets; of each component the smallest id stays, texts without words too."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), r["text"] or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None)
    label = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and label[a] != label[b] and 100 * len(x & y) >= 80 * len(x | y):
                    label = [min(label[a], label[b]) if k in (label[a], label[b]) else k for k in label]
                    moved = True
    first = {}
    for k, r in sorted(zip(label, rows, strict=True), key=lambda kr: kr[1]["doc_id"]):
        first.setdefault(k, r["doc_id"])
    return {r["doc_id"] for k, r in zip(label, rows, strict=True) if first[k] == r["doc_id"]}


def hidden(rows):
    """Texts with the values of fewer than three owners replaced."""
    found, owners = [], {}
    for r in rows:
        text = r["text"] or ""
        spans = [m.span(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
        spans += [m.span() for p in OTHERS for m in p.finditer(text)]
        found.append(sorted(spans))
        for x, y in spans:
            owners.setdefault(text[x:y], set()).add(r["source"])
    out = {}
    for r, spans in zip(rows, found, strict=True):
        text = r["text"]
        for x, y in reversed(spans):
            if len(owners[r["text"][x:y]]) < 3:
                text = text[:x] + "[SECRET]" + text[y:]
        out[r["doc_id"]] = text
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(31)
    words = [f"{a}{b}{c}" for a in "ghjklm" for b in "ou" for c in "lmnrst"] + ["the", "of"]

    def prose(n):
        return rng.choices(words, k=n)

    items = [prose(rng.choice([14, 30, 60])) for _ in range(6)]
    texts = [prose(rng.randint(20, 90)) for _ in range(90)]
    for i in range(90, 130):  # copies with some words changed, on both sides of the bar, and copies of copies
        t = list(texts[rng.randrange(60, i)])
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = "changed"
        texts.append(t)
    for i in range(8):  # passages, some with words put in their place
        p = list(items[i % 6])
        for at in range(2, len(p), rng.choice([4, 9])):
            p[at] = "put"
        texts[i * 3] = texts[i * 3][:10] + p + texts[i * 3][10:]
    shared, two = "zq" * 8, "GHJKLMNPQRSTUVWX"
    for i in range(30, 50):
        texts[i][5:5] = rng.choice([[f"token={shared}"], [f"AKIA{two}{i // 10}"], [f"{rng.getrandbits(128):032x}"], ['api_key: "' + "".join(rng.choices("ghjkxyz", k=20)) + '"']])
    junk = [["CLICK!!!", "$$$", str(k)] * rng.randint(5, 30) for k in range(60)]
    rows = [(i, " ".join(t), "en", f"s{i % 4}", 0) for i, t in enumerate(texts + junk)] + [(900, None, "en", "s0", 0), (901, "", "en", "s1", 0)]
    base = str(tmp_path_factory.mktemp("plain"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i < 130), 0) for i in range(190)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, items


def test_stages_are_those_of_plain_python(spark, corpus):
    base, items = corpus
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{base}/documents.parquet")
    good = stages["quality"](spark, docs, base)
    rows = good.collect()
    ids = {r.doc_id for r in rows}
    assert set(range(130)) <= ids and not ids & set(range(130, 190))

    unlike = stages["near_dedup"](spark, good, base)
    assert {r.doc_id for r in unlike.collect()} == without_copies(rows) and unlike.count() < len(rows)

    rows = unlike.collect()
    clean = stages["decontaminate"](spark, unlike, base)
    passages = [(k, " ".join(t)) for k, t in enumerate(items)]
    hits = {r.doc_id for r in rows if all_pairs([(0, r.text)], passages)}
    assert len(hits) >= 5 and {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - hits

    rows = clean.collect()
    safe = stages["secrets"](spark, clean, base)
    want = hidden(rows)
    assert {r.doc_id: r.text for r in safe.collect()} == want
    assert sum("[SECRET]" in (t or "") for t in want.values()) >= 5 and any("zq" * 8 in (t or "") for t in want.values())

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    packed = corpus_pipeline.run(spark, base).collect()
    pieces = []
    for i, t in want.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        pieces += [(i, p, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(pieces)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(p[3] for p in pieces) // 4096) + 1
