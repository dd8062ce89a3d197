"""The thin queries by column, and the pipeline on odd rows: repeated ids, nulls, empty and very long texts, an empty table."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from gazetta.llm import contracts, quality
from gazetta.llm.topk import top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    base = str(tmp_path_factory.mktemp("sf"))
    words = {"en": ["the", "with", "thing", "other", "house"], "de": ["über", "schön", "und", "nicht", "haus"]}
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        t = " ".join(rng.choices(words[lang], k=rng.randint(8, 60)))
        rows.append((i, t if i % 5 else "!!! BUY " * 9, lang, f"s{i % 3}", len(t)))
    item = " ".join(f"bench{k}" for k in range(30))
    rows += [(200, f"intro words {item} end", "en", "s1", 9), (3, "quite another text under an id that is taken already", "en", "s1", 9)]
    rows += [(3, rows[3][1], "de", "s2", 9), (None, f"{item} again", None, None, None), (None, "no id at all here", None, None, 3), (201, None, "en", "s1", None), (202, "", None, None, 0), (203, "word " * 60_000, "en", "s0", 9)]
    spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS score", "1 AS _row").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    html = "<html><body><nav><a href='/'>Home</a></nav><article><p>One two &amp; three four five six seven eight.</p><p>Nine  ten eleven twelve é.</p></article><footer>foot</footer></body></html>"
    spark.createDataFrame([(1, "u", html), (1, "u", html), (2, None, None), (3, "v", "")], "page_id long, url string, html string").write.parquet(f"{base}/pages.parquet")
    return base, rows


def test_quality_columns(spark, tables):
    base, rows = tables
    got = contracts.quality_scores(spark, base).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id) for r in got)
    right = [r.predicted == int(r.doc_id % 5 > 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 160]
    assert np.mean(right) > 0.95


def test_quality_regression_is_the_solution_of_its_normal_equations(spark, tables):
    """The partition sums against one matrix of all fitted rows."""
    from pyspark.sql import functions as F

    base, _ = tables
    stats = quality.document_statistics(spark.read.parquet(f"{base}/documents.parquet"))
    labelled = quality.label_statistics(stats, spark.read.parquet(f"{base}/labels.parquet"))
    model = quality.fit_quality(labelled)
    rows = labelled.withColumn("cal", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibrate")), F.lit(5)) == 0).where("not cal").collect()
    x, y = model.fourier(np.array([r.stats for r in rows], np.float64)), np.array([r.label for r in rows], float)
    reg = 1e-4 * len(rows) * np.eye(x.shape[1])
    reg[-1, -1] = 1e-10
    assert np.allclose(model.beta, np.linalg.solve(x.T @ x + reg, x.T @ y), atol=1e-6)


def test_language_columns(spark, tables):
    base, rows = tables
    got = contracts.languages(spark, base).collect()
    assert len(got) == len(rows) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (201, 202)} == {201: "und", 202: "und"}
    assert np.mean([r.lang_pred == ("en", "de")[r.doc_id % 2] for r in got if r.doc_id is not None and r.doc_id < 160 and r.doc_id % 5 and r.doc_id != 3]) > 0.95


def test_main_text_columns(spark, tables):
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in contracts.main_text(spark, tables[0]).collect()), key=str)
    text = "One two & three four five six seven eight. Nine ten eleven twelve é."
    assert got == [(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (3, "v", "", 0)]


def test_near_dedup_packing_and_overlap_columns(spark, tables):
    base, rows = tables
    got = contracts.near_dedup(spark, base).collect()
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    packed = contracts.packed(spark, base).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows) and all(0 < r.length <= 4096 for r in packed)
    found = contracts.benchmark_overlaps(spark, base).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(200, 1), (None, 1)}
    secrets = contracts.secret_spans(spark, base).collect()
    assert len(secrets) == len(rows) and {r.base_sha256 for r in secrets} == {hashlib.sha256(b"").hexdigest()}


def test_pipeline_keeps_clean_rows_and_its_settings(spark, tables):
    base, rows = tables
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{base}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, base)
        assert kept.columns == docs.columns, name
        if name == "near_dedup":
            assert "quite another text under an id that is taken already" in [r.text for r in kept.where("doc_id = 3").collect()]
    texts = {r.text for r in kept.collect()}
    assert not any(t and "bench7" in t for t in texts)
    assert spark.conf.get(key) == before
    assert corpus_pipeline.run(spark, base).count() > 0


def test_pipeline_on_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_top_k_takes_the_smallest_vector_of_a_repeated_query(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5]), (3, [0.1, 0.9])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [0.0, 1.0]), (9, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(v, q, k=1).collect()] == [(2, 65536)]
