"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Every stage works on all rows that the one before kept. All but the last
return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.llm import quality
from gazetta.llm.common import arrow_rows, free_name, held_out, keyed
from gazetta.llm.decontaminate import drop_contaminated
from gazetta.llm.near_dup import drop_near_duplicates
from gazetta.llm.packing import pack
from gazetta.llm.secrets import redact_secrets
from gazetta.session import stash, table

#: Some stages can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def small_batches(stage: Callable) -> Callable:
    """A stage that runs with batches of 1,000 rows between the JVM and Python, as whole texts are long, and gives the session its setting back.

    What a stage does in Python it writes itself, so the setting need not outlast it.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with arrow_rows(spark, 1000):
            return stage(spark, docs, sf_dir)

    return run


@small_batches
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under 0.3, as surely junk, go. Repeated rows have equal scores; null and empty texts are scored too."""
    labels = table(spark, sf_dir, "labels")
    # Only labelled rows are fitted on, so only their statistics are counted before the model is there.
    known = keyed(docs.where(~held_out()), labels.select("doc_id").distinct(), "doc_id", "left_semi")
    labelled = quality.label_statistics(stash(quality.document_statistics(known)), labels)
    score = free_name(docs, "_quality_score")
    scored = quality.score_documents(docs, quality.fit_quality(labelled), score_col=score)
    return stash(scored.where(F.col(score) >= 0.3).drop(score))


@small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8. Rows that share an id are told apart by their texts; texts without words stay."""
    return drop_near_duplicates(docs)


@small_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, each row by its own text. Null and empty texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are replaced, by their owners over all rows; n_chars follows where a text has changed. Null texts stay null."""
    return redact_secrets(docs, owner_col="source", length_col="n_chars")


@small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 4096 tokens, best-fit. Null and empty texts are a document of one end token; repeated rows are packed as often as they occur."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_benchmark),
    ("secrets", hide_secrets),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
