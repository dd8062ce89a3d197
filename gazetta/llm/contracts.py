"""The thin queries over the given tables; each derives its columns from an operator's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.llm import html_extract, langid, pii, quality, secrets
from gazetta.llm.common import held_out
from gazetta.llm.decontaminate import contaminated
from gazetta.llm.divergence import source_divergence
from gazetta.llm.licenses import scan_licenses
from gazetta.llm.near_dup import near_duplicates
from gazetta.llm.packing import pack
from gazetta.llm.simhash import fingerprint_text, simhash_duplicates
from gazetta.llm.topk import top_k
from gazetta.llm.zone_clusters import centroid_digest, zone_clusters
from gazetta.session import stash, table


def _counted(field: str, value: int | str) -> Column:
    """Base spans with this value."""
    return F.size(F.filter("base", lambda x: x[field] == value)).cast("long")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stash(quality.document_statistics(table(spark, sf_dir, "documents")))
    labelled = quality.label_statistics(stats.where(~held_out()), table(spark, sf_dir, "labels"))
    scored = quality.score_statistics(stats, quality.fit_quality(labelled))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract_pii(table(spark, sf_dir, "documents"))
    counts = [_counted("order", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), owner_col="source")
    counts = [_counted("kind", k).alias(f"n_{k}") for k in secrets.BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_copied",
    )


def license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"), "n_lines")


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extract_text(pages, html_extract.fit_labeller(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = langid.predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, centroids = zone_clusters(table(spark, sf_dir, "embeddings"))
    placed = stash(placed)
    sums = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # One row a centroid, 40 in all.
    rows = [(c, sums.get(c, 0), sum(sums.values()), centroid_digest(x)) for c, x in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
