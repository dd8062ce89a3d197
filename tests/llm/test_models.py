"""Trained operators: gradients by differences, learning on small tables, odd rows."""

import random

import numpy as np
import pytest

from gazetta.llm import html_extract, langid, quality
from gazetta.llm.common import held_out


def differences(net, loss, grads, at):
    for k, i in at.items():
        net.p[k][i] += 1e-3
        up = loss()
        net.p[k][i] -= 2e-3
        down = loss()
        net.p[k][i] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][i]) < 2e-3 + 0.05 * abs(grads[k][i]), k


def test_byte_network_gradients():
    net = langid.Network(3, hidden=4, embed=3)
    b, lengths, _ = langid.encode([b"abc", b"Hello", "añb".encode()])
    target = np.eye(3, dtype=np.float32)

    def loss():
        y, (_, _, m, *_) = net.forward(b, lengths)
        return -(np.log(y) * target[:, None, :]).sum(2)[m].sum() / m.sum()

    g = net.gradients(b, lengths, target)
    differences(net, loss, g, {k: tuple(n // 2 for n in v.shape) for k, v in net.p.items() if k != "e"} | {"e": (int(b[0, 1]), 1)})


def test_pooling_is_the_mean_of_all_positions():
    """The fast way over blocks of windows against the network as it is trained, text by text."""
    rng, net = random.Random(8), langid.Network(3, hidden=5, embed=4)
    texts = ["".join(rng.choices("abc é,.1\n", k=rng.choice([1, 3, 63, 64, 65, 200]))).encode() for _ in range(40)] + [b""]
    b, lengths, owner = langid.encode(texts)
    got = np.zeros((len(texts), 3))
    np.add.at(got, owner, net.pooled(b, lengths, block=16))
    for i, t in enumerate(texts):
        assert (owner == i).sum() == -(-len(t) // langid.WIDTH) and lengths[owner == i].sum() == len(t)
        total = np.zeros(3)
        for at in range(0, len(t), langid.WIDTH):
            x = np.frombuffer(t[at : at + langid.WIDTH].lower(), np.uint8)
            total += net.forward(x[None], np.array([len(x)]))[0][0].sum(0)
        assert np.allclose(got[i], total, atol=1e-4)


def test_block_labeller_gradients():
    rng = np.random.default_rng(0)
    net = html_extract.Labeller(hidden=3)
    x, mask, y = html_extract.padded([(rng.normal(size=(n, html_extract.WIDTH)), (rng.random(n) > 0.5).astype(float)) for n in (5, 3)])

    def loss():
        p = net.forward(x, mask)[0]
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    g = net.gradients(x, mask, y)
    differences(net, loss, g, {k: tuple(n // 2 for n in v.shape) for k, v in net.p.items()})


LANG = "doc_id long, text string, lang string, lang_pred string"


def test_languages_are_learned(spark):
    rng = random.Random(1)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["ñac", "ció", "llo", "que"]}
    rows = [(i, " ".join("".join(rng.choices(parts[g], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 30))), g, "x") for i in range(120) for g in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame(rows, LANG)
    model = langid.fit_languages(docs.where(~held_out()), steps=80)
    odd = spark.createDataFrame([(900, None, None, None), (901, "", None, None), (902, "12 ²!", None, None), (None, "tion ing", None, None)], LANG)
    got = langid.predict_languages(docs.union(odd), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 124
    assert np.mean([by[i].lang_pred == g for i, _, g, _ in rows]) > 0.95
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_or_with_one_label(spark):
    docs = spark.createDataFrame([(1, "abc", None, "x"), (2, "", None, "x")], LANG)
    assert {r.lang_pred for r in langid.predict_languages(docs, langid.fit_languages(docs)).collect()} == {"und"}
    one = spark.createDataFrame([(1, "abc", "aa", "x"), (2, "", None, "x")], LANG)
    assert {r.doc_id: r.lang_pred for r in langid.predict_languages(one, langid.fit_languages(one)).collect()} == {1: "aa", 2: "und"}
    assert langid.predict_languages(docs.limit(0), langid.fit_languages(docs.limit(0))).count() == 0


def test_a_rare_language_is_learned(spark):
    rng = random.Random(4)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["ñac", "ció", "llo", "que"], "cc": ["zw", "xk", "vj", "qq"]}

    def text(g):
        return " ".join("".join(rng.choices(parts[g], k=rng.randint(1, 3))) for _ in range(20))

    rows = [(i, text(g), g) for i in range(400) for g in [("aa", "bb")[i % 2] if i >= 6 else "cc"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, max_docs=30, steps=80)
    assert model.languages == ["aa", "bb", "cc"]
    odd = [(900, text("cc") * 5_000, None), (900, "12 34", None), (901, "...", None), (902, text("bb"), None), (902, text("bb"), None)]
    got = langid.predict_languages(spark.createDataFrame(odd, docs.schema), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == [(900, "cc"), (900, "und"), (901, "und"), (902, "bb"), (902, "bb")]


def test_quality_is_learned(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in "aeiou"]
    rows = []
    for i in range(300):
        t = " ".join(rng.choices(words, k=rng.randint(5, 80)))
        rows.append((i, t if i % 3 else t.upper().replace(" ", "!! "), "x"))
    docs = spark.createDataFrame([*rows, (500, None, "x"), (501, "", "x"), (None, "plain words", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    stats = quality.document_statistics(docs)
    model = quality.fit_quality(quality.label_statistics(stats.where(~held_out()), labels))
    got = {r.doc_id: r.score for r in quality.score_statistics(stats, model).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == (i % 3 > 0) for i in range(300)]) > 0.97
    passed = quality.score_documents(docs, model)
    assert passed.columns == ["doc_id", "text", "score", "quality_score"]
    assert {r.doc_id: r.quality_score for r in passed.collect()}[5] == pytest.approx(got[5], abs=1e-3)
    with pytest.raises(ValueError):
        quality.score_documents(docs, model, score_col="score")


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    stats = quality.document_statistics(docs)
    model = quality.fit_quality(quality.label_statistics(stats, spark.createDataFrame([], "doc_id long, quality int")))
    assert [r.score for r in quality.score_statistics(stats, model).collect()] == [0.5]


def page(main, extra="", tag="article"):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home page</a></li></ul></nav><!-- c --><div class="ad">Buy &amp; save now</div><{tag}><h1>Head</h1>{main}</{tag}>{extra}<footer>&copy; site words</footer></body></html>'


def test_leaves():
    got = html_extract.leaves('<p>a <b>b</b>&amp;<br>c<p>d</p><script>x<p>y</script>tail<!-- n --> <a href="q>r">link</a><textarea>no</textarea>')
    assert [(t, round(s, 1)) for _, t, s in got] == [("a b& c", 0.0), ("d", 0.0), ("tail link", 0.4)]
    assert html_extract.leaves("") == [] and html_extract.leaves("<p") != [None]


def test_main_text(spark):
    rng = random.Random(3)

    def prose():
        return "".join("<p>" + " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(8, 40))) + ".</p>" for _ in range(rng.randint(2, 6)))

    mains = [prose() for _ in range(60)]
    rows = [(i, "u", page(m), "x") for i, m in enumerate(mains)] + [(100, "u", None, "x"), (101, "u", "", "x"), (None, None, page(mains[0]), None)]
    rows += [(102, "u", page(mains[1], '<section class="comments"><div class="comment"><p>I liked this a lot, thanks.</p></div></section><form><p>Sign up to our letter</p></form>', "main"), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.main_text for r in html_extract.extract_text(pages, html_extract.fit_labeller(pages, steps=250)).collect()}

    def want(m):
        return "Head " + m.replace("</p><p>", " ").replace("<p>", "").replace("</p>", "")

    assert np.mean([got[i] == want(m) for i, m in enumerate(mains)]) == 1
    assert got[100] == got[101] == "" and got[None] == want(mains[0]) and got[102] == want(mains[1])
    assert html_extract.extract_text(pages.limit(0), html_extract.fit_labeller(pages.limit(0))).count() == 0
