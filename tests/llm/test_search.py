"""Decontamination and top-k against brute force, and the pipeline."""

import math
import random

import numpy as np
import pytest

from gazetta.llm.decontaminate import contaminated, drop_contaminated, overlap
from gazetta.llm.topk import top_k

DOCS = "doc_id long, text string, item_id string"


def test_benchmark_passages_are_found(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(15, 60)))) for i in range(30)]
    rows, planted = [], {}
    for i in range(200):
        t = rng.choices(words, k=rng.randint(0, 150))
        if i % 4 == 0:
            item, passage = items[i % 30][0], items[i % 30][1].split()
            if i % 8 == 0:  # substitutions
                for at in range(6, len(passage) - 1, 9):
                    passage[at] = "SUB"
            at = rng.randint(0, len(t))
            t[at:at] = [w.upper() + "," for w in passage]
            planted[i] = item
        rows.append((i, " ".join(t), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (None, items[3][1], "x"), (902, "... !!", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([*items, (50, None), (51, "too short"), (None, "")], "item_id long, text string")
    got = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {*planted.items(), (None, 3)}
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [r[0] for r in rows if r[0] is not None and r[0] not in planted]
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_overlap_tolerates_substitutions():
    item = np.arange(20)
    doc = np.concatenate([[90, 91], item, [92]])
    doc[10] = 77
    assert overlap(doc, item, 2) == (2, 20, 19)
    assert overlap(doc, item, 500) == (0, 0, 0)


@pytest.mark.parametrize("blocks", [{}, {"query_block": 3, "row_block": 7, "least_blocks": 2}])
def test_top_k_matches_brute_force(spark, blocks):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) if abs(x) > 0.5 else 0.0 for x in rng.normal(size=6)], "x") for i in range(60)]
    rows += [(60 + i, rows[5][1], "x") for i in range(20)]  # ties
    rows += [(200, None, "x"), (250, [1.0, None], "x"), (300, [math.nan] * 6, "x"), (350, [math.inf] * 6, "x"), (None, [1.0] * 6, "x"), (400, [], "x"), (450, [1.0, 2.0], "x")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(v, v.where("vec_id % 50 = 0"), **blocks).collect())
    sound = {r[0]: np.floor(256 * np.array(r[1], np.float32).astype(float)).astype(int) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])}
    want = []
    for q in sorted(i for i in sound if i % 50 == 0):
        n = lambda a, b: min(len(a), len(b))
        scored = sorted((-int(np.dot(sound[q][: n(sound[q], w)], w[: n(sound[q], w)])), i) for i, w in sound.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == want


def test_top_k_of_nothing(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(v, v).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    good = [prose(60) for _ in range(80)]
    item = prose(30)
    texts = [*good, *[prose(60).upper().replace(" ", "!! ") for _ in range(40)], good[0], good[1] + " end", "x " + item, prose(60) + " token=abcdefghijklmnop"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 80 <= i < 120), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"], name
        kept.append({r.doc_id: r for r in docs.collect()})
    # Junk goes, then the exact and the near copy, then the passage; the secret is hidden.
    assert set(kept[0]) == {*range(80), *range(120, 124)}
    assert set(kept[1]) == {*range(80), 122, 123}
    assert set(kept[2]) == {*range(80), 123}
    assert {i: r.text for i, r in kept[3].items()} == dict(enumerate(good)) | {123: texts[123].replace("abcdefghijklmnop", "[SECRET]")}
    assert kept[3][123].n_chars == len(kept[3][123].text) and kept[3][5].n_chars == len(good[5])
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 81
