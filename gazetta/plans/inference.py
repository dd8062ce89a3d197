"""Model calls as operators: a Python callable is shipped to the tasks, and rows go in batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.functions.replies import salvage
from gazetta.operators import windows


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """An offline stand-in for an embedding provider: normalised counts of hashed words."""
    out = []
    for text in texts:
        v = [0.0] * size
        for w in (text or "").lower().split():
            v[zlib.crc32(w.encode()) % size] += 1.0
        norm = sum(x * x for x in v) ** 0.5
        out.append([x / norm for x in v] if norm else v)
    return out


def embed_missing(rows: DataFrame, text: str, vector: str, embedder: Callable[[list[str]], list[list[float]]] = hashed_embedding, batch: int = 64, give_up: int = 3) -> DataFrame:
    """Fill null vectors. After ``give_up`` failed batches in a row a task leaves its remaining rows null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for frame in frames:
            made: list = []
            for at in range(0, len(frame), batch):
                part = frame[text].iloc[at : at + batch].tolist()
                got: list = [None] * len(part)
                if failed < give_up:
                    try:
                        got, failed = embedder(part), 0
                    except Exception:
                        failed += 1
                made += got
            yield frame.assign(**{vector: made})

    known = rows.where(F.col(vector).isNotNull())
    return known.unionByName(rows.where(F.col(vector).isNull()).mapInPandas(run, rows.schema))


def in_batches(rows: DataFrame, order: list, size: int = 10, by: str = "queue") -> DataFrame:
    """``rows`` with batch_id and item_id: the queue ``by`` in order, ``size`` rows a batch. Queues of any length are numbered across tasks."""
    placed = windows.placed(rows, by, *order)
    n = F.floor((F.col("place") - 1) / size).cast("string")
    return placed.withColumn("batch_id", F.concat_ws("-", F.col(by).cast("string"), n)).withColumn("item_id", F.col("id").cast("long")).drop("place")


def ask(batches: DataFrame, prompt: Callable[[pd.DataFrame], str], model: Callable[[str], str]) -> DataFrame:
    """(batch_id, raw): one call per batch; a failed call leaves a null reply, for the retry pass."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            raw = model(prompt(frame))
        except Exception:
            raw = None
        return pd.DataFrame({"batch_id": [frame["batch_id"].iloc[0]], "raw": [raw]})

    return batches.groupBy("batch_id").applyInPandas(run, "batch_id string, raw string")


def asked(model: Callable[[str], str], prompt: Column) -> Column:
    """A model's reply to each prompt; null where the call fails."""

    @F.pandas_udf("string")
    def said(prompts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return model(text)
            except Exception:  # whatever a provider raises
                return None

        return prompts.map(one)

    return said(prompt)


def facts(rows: DataFrame, model: Callable[[str], str], label: str, text: str, kinds: list[str], chars: int = 1200, fact_chars: int = 120) -> DataFrame:
    """``rows`` that yield a fact, with delta_type, value, unit, short_fact, confidence. One call a row; a failed call yields none.

    A fact has a known type and a value that is not empty. Its ids are those
    of the row, which passes through, never what the model says.
    """
    prompt = F.concat(F.lit("Story: "), F.coalesce(label, F.lit("")), F.lit("\n\n"), F.substring(F.coalesce(text, F.lit("")), 1, chars))
    got = rows.withColumn("_x", F.from_json(salvage(asked(model, prompt)), "delta_type string, value string, unit string, short_fact string, confidence double"))
    got = got.where(F.col("_x.delta_type").isin(kinds) & (F.coalesce("_x.value", F.lit("")) != ""))
    unit = F.nullif(F.col("_x.unit"), F.lit(""))
    return got.select(*rows.columns, "_x.delta_type", "_x.value", unit.alias("unit"), F.substring(F.coalesce("_x.short_fact", F.lit("")), 1, fact_chars).alias("short_fact"), "_x.confidence")


def summaries(rows: DataFrame, model: Callable[[str], str], title: str, body: str, differentiator: str, reasoning: str, chars: int = 6000, short: int = 280, long: int = 1200) -> DataFrame:
    """``rows`` with short, long and fallback: a model's summary, or where it fails the score's own words, else the title."""
    prompt = F.concat(F.lit("title: "), F.coalesce(title, F.lit("")), F.lit("\ncontent:\n"), F.substring(F.coalesce(body, F.lit("")), 1, chars))
    got = rows.withColumn("_x", F.from_json(salvage(asked(model, prompt)), "short string, long string"))
    failed = F.col("_x").isNull()
    own = [F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names], F.lit("")) for names in ((differentiator, reasoning, title), (reasoning,))]
    made = [F.when(failed, F.substring(o, 1, n)).otherwise(F.substring(F.trim(F.coalesce(f"_x.{k}", F.lit(""))), 1, n)) for o, k, n in zip(own, ("short", "long"), (short, long), strict=True)]
    return got.select(*rows.columns, made[0].alias("short"), made[1].alias("long"), failed.alias("fallback"))


def confirmed(clusters: DataFrame, model: Callable[[str], str], titles: str = "titles") -> DataFrame:
    """``clusters`` with same: true only where the model's reply says ``same_event: true``; no reply, another shape or another value is false."""
    prompt = F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- "), t)), "\n")
    reply = F.get_json_object(salvage(asked(model, prompt)), "$.same_event")
    return clusters.withColumn("same", F.coalesce(reply == "true", F.lit(False)))
