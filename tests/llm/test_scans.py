"""Personal data, secrets and licences against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from gazetta.llm import pii
from gazetta.llm.licenses import KNOWN, scan_licenses
from gazetta.llm.secrets import redact_secrets, scan_secrets, span_text

SCHEMA = "doc_id long, text string, source string, row string, kind string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}", "r", None) for i, t in enumerate(texts)], SCHEMA)


def plain_pii(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    pieces = ["a@b.co", "x@@y.z", "@q.r", "a.b+c@d-e.f.g", "1.2.3.4", "256.1.1.1", "4539578763621486", "4539 5787 6362 1486", "+1 (366) 555-9807", "+12", "é", " ", "-", ".", "0", "12", "@"]
    for _ in range(5000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(t) == plain_pii(t), t


def test_luhn():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_context_finds_an_unseen_identifier(spark):
    seeds = [f"words here cardno {n} and more" for n in ("4539578763621486", "6011000990139424", "5500005555555559", "4111111111111111")]
    texts = [*seeds, "words here cardno 4539578763621487 and more", "the year 19991999 was plain", None, ""]
    got = {r.doc_id: r for r in pii.extract_pii(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [tuple(x) for x in got[4].added] == [(18, 2, 34)]
    assert all(not got[i].added for i in range(len(texts)) if i != 4)
    assert not got[6].base and not got[7].base


def plain_secrets(t):
    out = []
    key = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password")
    words = [key] + ["".join(f"[{c.upper()}{c}]" for c in w) for w in ("passwd", "secret", "token")] + ["[Aa][Pp][Ii]_?[Kk][Ee][Yy]"]
    for m in re.finditer("(" + "|".join(words) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 12:
            out.append(("assign", m.start(), m.end(), 0))
    out += [("access", m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in sorted(out, key=lambda x: (x[1], x[3])))


def test_secret_spans_match_the_patterns(spark):
    rng = random.Random(6)
    pieces = ["token: ", "api_key=", "Password = '", "abcdefghijkl", "0123456789abcdef", "AKIA", "ABCDEFGHIJ1234", "\u0001", "é", " ", "=", "secret", '"', ":", "🔦", "x9"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(800)] + [None, "", "token: api_key: abcdefghijklmnop"]
    got = {r.doc_id: r.spans for r in scan_secrets(frame(spark, texts), owner_col="source").select("doc_id", span_text(F.col("base")).alias("spans")).collect()}
    assert got == {i: plain_secrets(t or "") for i, t in enumerate(texts)}


def test_ownership_tells_examples_from_live_values(spark):
    copied, own, free = "token=" + "c" * 16, "token=" + "d" * 5 + "ZZ9" * 4, "Zx9" * 9
    texts = [copied, copied, copied, own, f"plain {free} words", None]
    got = {r.doc_id: r for r in scan_secrets(frame(spark, texts), owner_col="source").collect()}
    # The run of c is a hex match as well.
    assert [got[i].n_copied for i in range(3)] == [2, 2, 2] and got[0].n_live == 0
    assert got[3].n_live >= 1 and [x.kind for x in got[4].added] == ["token"]
    assert scan_secrets(frame(spark, texts).limit(0)).count() == 0


def test_redaction_leaves_clean_texts(spark):
    texts = ["token = \"abcdefghijkl\" x", "AKIA" + "A" * 16 + " y", "0123456789abcdef", "clean text", None, "", "token: short"]
    got = [r.text for r in redact_secrets(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == ['token = "[SECRET]" x', "[SECRET] y", "[SECRET]", "clean text", None, "", "token: short"]


def test_licenses(spark):
    mit = KNOWN[0][1]
    texts = [f"Copyright (c) 2020 Someone\n{mit.upper()}", mit.replace("sublicense", "sub-licence").replace(" ", "\n"), "a b\nReleased under the MIT licence\nReleased under the MIT License!", "no licence", None, "", "..."]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, texts)).collect()}
    assert [got[i].license for i in range(7)] == ["MIT", "MIT", None, None, None, None, None]
    assert got[2].line_licenses == ["MIT"] and got[2].n_lines == 2
    assert got[4].digest is None and got[6].digest is None
    assert got[3].digest == hashlib.sha256(b"no license").hexdigest()
    assert scan_licenses(frame(spark, texts).limit(0)).count() == 0


def test_published_texts_and_identifiers(spark):
    import pathlib

    import pytest

    shelf = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = ["// SPDX-License-Identifier: Apache-2.0\nint x;", "# SPDX-License-Identifier: GPL-3.0-or-later", "x SPDX-License-Identifier: MIT y", None, "", "word " * 100_000, "Copyright 2020 A\n" + KNOWN[-1][1], "Copyright 2020 A\n" + KNOWN[-1][1]]
    found = [n for n in names if (shelf / n).exists()]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, texts + [(shelf / n).read_text() for n in found])).collect()}
    assert [got[i].line_licenses for i in range(4)] == [["Apache-2.0"], ["GPL-3.0"], [], []] and got[1].license == "GPL-3.0"
    assert got[6].license == got[7].license == "Unlicense" and got[5].license is None
    assert [got[len(texts) + i].license for i in range(len(found))] == [names[n] for n in found]
    if not found:
        pytest.skip("no published texts on this machine")
