"""The transducer against a plain list, the audit against plain Python."""

import random
from collections import Counter

import pytest

from gazetta.llm import contracts
from gazetta.llm.divergence import Transducer, source_divergence, terms


def plain_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if ord(c) > 0x7F or c.isascii() and c.isalpha():
            word += c.lower() if c.isascii() else c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_audit(rows, least=10, top=10):
    rows = [(l or "", s or "", plain_terms(t)) for l, s, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(w for r in mine for w in set(r[2]))
        kept = sorted((w for w in df if df[w] >= least), key=str.encode)
        v, sources = len(kept), sorted({r[1] for r in mine}, key=str.encode)
        counts = {s: Counter(w for r in mine if r[1] == s for w in r[2]) for s in sources}
        counts[None] = sum(counts.values(), Counter())
        total = {s: sum(c[w] for w in kept) for s, c in counts.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 2) // (total[s] + 2 * v) for w in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -x, i + 1) for i, (x, _, o) in enumerate(pairs)]
            best = sorted((-f(p[s][w], p[None][w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > p[None][w])[:top]
            out += [(lang, s, "term", w, -x, i + 1) for i, (x, _, w) in enumerate(best)]
    return sorted(out)


def test_terms_split_on_ascii_only():
    for t in ["", "don't stop", "Ünïcode x É", "a1b2 c_d", "[x]{y}~z\x7fq`r@s", "日本 語"]:
        assert [w.decode() for w in terms(t.encode())] == plain_terms(t)


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_ordinals_are_places_in_the_sorted_list(n):
    rng = random.Random(n)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 7))).encode() for _ in range(n)})
    machine = Transducer.unpack(Transducer.build(words).pack())
    asked = [*words, b"", b"zzz", *[w + b"x" for w in words[:20]], *[w[:-1] for w in words[:20] if len(w) > 1]]
    place = {w: i for i, w in enumerate(words)}
    assert machine.ordinals(asked).tolist() == [place.get(w, -1) for w in asked]


def test_automaton_is_minimal():
    """No two states accept the same endings, and shared endings are stored once."""
    words = sorted(f"{a}{b}ing".encode() for a in "abcdefgh" for b in "klmn")
    machine = Transducer.build(words)
    assert len(machine.final) == 6 and len(machine.keys) == 8 + 4 + 3
    endings: dict = {}
    for state in range(len(machine.final)):
        rows = machine.keys >> 8 == state
        shape = (bool(machine.final[state]), tuple(machine.keys[rows] & 255), tuple(machine.target[rows]))
        assert endings.setdefault(shape, state) == state


def some_rows(n=260):
    rng = random.Random(9)
    words = {l: [f"{a}{b}{l}" for a in "bcdfgé" for b in ("a", "ei", "ö")] for l in ("en", "de")}
    rows = []
    for i in range(n):
        lang, source = ("en", "de")[i % 2], f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}"
        pool = words[lang][: 18 - 3 * int(source[1])]
        rows.append((lang, source, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(pool, k=rng.randint(0, 30)))))
    rows += [("en", "wordless", "123 !"), ("en", "wordless", None), (None, None, "alone x"), ("fr", "a", "peu"), ("fr", "b", "de"), (None, "s0", None), rows[0], rows[0], ("de", "s1", "lang " * 50_000)]
    rows += [("tie", s, "x y z") for s in ("a", "b", "é", "z") for _ in range(5)]  # equal frequencies everywhere
    return rows


@pytest.mark.parametrize("how", [{}, {"per_shard": 3}, {"per_shard": 3, "broadcast_bytes": 0}])
def test_audit_is_the_plain_one(spark, how):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, source string, text string, term string, ordinal int, n int")
    assert sorted(map(tuple, source_divergence(docs, **how).collect())) == plain_audit(rows)


def test_audit_of_many_sources(spark):
    """More sources than a block holds."""
    rng = random.Random(3)
    rows = [("en", f"s{i % 130}", " ".join(rng.choices("alpha beta gamma delta".split(), k=6))) for i in range(400)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, source_divergence(docs).collect())) == plain_audit(rows)


def test_audit_columns_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame(some_rows(), "lang string, source string, text string")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    got = contracts.divergence(spark, str(tmp_path))
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert got.count() == 0
