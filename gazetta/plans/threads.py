"""Ongoing stories: every run's stories are matched to the week's threads, and what changed since a thread's last point is noted.

An account's threads of a week are one state: a thread has a label, the vector
of its last story and its last points. As weeks share nothing, an account's
week is one key, for the stream as for the table, and no group outgrows it:
a run adds 40 stories at most.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from gazetta.functions.deltas import CATEGORICAL, NUMERIC
from gazetta.functions.quantity import amount
from gazetta.streaming.ordered import InOrder, is_material, stateful

STORY = "at long, place long, story_id long, label string, vector binary, many boolean, kind string, value string, amount double, unit string, confidence double, ids array<long>"
POINT = "at long, place long, story_id long, thread_id long, delta string, since long, old string, new string, unit string, old_ids array<long>, new_ids array<long>, n_points int"
#: Relative and absolute bar of each kind of number.
BARS = {"magnitude": (0.15, 1.0), "tally": (0.0, 1.0), "price": (0.10, 0.0), "percentage": (0.10, 1.0)}


@dataclass(frozen=True)
class Rules:
    similarity: float = 0.83
    confidence: float = 0.5
    most_checked: int = 40
    most_noted: int = 5
    points: int = 3
    bars: dict = field(default_factory=lambda: dict(BARS))
    #: A replay lets threads be met as soon as a story has made them, takes stories of several articles only, and has no caps.
    replay: bool = False


@dataclass
class Thread:
    label: str
    vector: bytes | None
    points: list[dict]


def changed(old: dict, story: dict, rules: Rules) -> bool:
    """Whether two points differ by enough. Kinds of different families don't compare; a tally must climb."""
    if story["kind"] in NUMERIC and old["kind"] in NUMERIC:
        a, b = old["amount"], story["amount"]
        if a is None or b is None or (story["kind"] == "tally" and b <= a):
            return False
        return is_material(a, b, *rules.bars.get(story["kind"], (0.15, 1.0)))
    if story["kind"] in CATEGORICAL and old["kind"] in CATEGORICAL:
        return " ".join(old["value"].lower().split()) != " ".join(story["value"].lower().split())
    return False


def nearest(vector: bytes | None, threads: dict[int, Thread], least: float) -> int | None:
    """The thread of greatest cosine, the smallest id on ties; none below ``least`` or at 0."""
    return Near(threads).best(vector, threads, least)


class Near:
    """The vectors of threads as a matrix for each length, so that a story is compared with all threads at once.

    The product tells which few threads come near the greatest cosine; those are compared one by one, rounded to nine digits.
    """

    def __init__(self, threads: dict[int, Thread]):
        self.sizes: dict[int, tuple[np.ndarray, list[int]]] = {}
        self.places: dict[int, tuple[int, int]] = {}
        for i, t in threads.items():
            self.put(i, t.vector)

    def put(self, i: int, vector: bytes | None) -> None:
        """A thread's vector, in place of the one before."""
        y = np.frombuffer(vector or b"")
        norm = np.linalg.norm(y)
        size, at = self.places.get(i, (-1, -1))
        if size == len(y):
            self.sizes[size][0][at] = y / norm if norm > 0 else 0
            return
        if size >= 0:
            self.sizes[size][0][at] = 0
        rows, ids = self.sizes.get(len(y), (np.zeros((16, len(y))), []))
        if len(ids) == len(rows):
            rows = np.concatenate([rows, np.zeros_like(rows)])
        rows[len(ids)] = y / norm if norm > 0 else 0
        self.places[i] = (len(y), len(ids))
        ids.append(i)
        self.sizes[len(y)] = (rows, ids)

    def best(self, vector: bytes | None, threads: dict[int, Thread], least: float) -> int | None:
        x = np.frombuffer(vector or b"")
        length = np.linalg.norm(x)
        if not length > 0 or len(x) not in self.sizes:
            return None
        rows, ids = self.sizes[len(x)]
        rough = np.nan_to_num(rows[: len(ids)] @ (x / length))
        best, found = 0.0, None
        for i in sorted(ids[k] for k in np.flatnonzero(rough >= max(rough.max(), 0) - 1e-8) if self.places[ids[k]] == (len(x), k)):
            y = np.frombuffer(threads[i].vector or b"")
            norm = np.linalg.norm(x) * np.linalg.norm(y)
            near = round(float(x @ y / norm), 9) if norm > 0 else 0.0
            if near > best:
                best, found = near, i
        return found if best >= least else None


def one_run(threads: dict[int, Thread], at: int, stories: list[dict], rules: Rules, near: Near | None = None) -> list[tuple]:
    """A run's points, and ``threads`` as they are after it.

    A live run sees the threads that it began with: two stories may meet one
    thread, both compare with its point of before, and both points are kept.
    """
    seen = threads if rules.replay else {i: Thread(t.label, t.vector, list(t.points)) for i, t in threads.items()}
    near = near or Near(seen)
    out, checked, noted = [], 0, 0
    for s in stories:
        if not rules.replay and (checked >= rules.most_checked or noted >= rules.most_noted):
            break
        if rules.replay and not s["many"]:
            continue
        match = near.best(s["vector"], seen, rules.similarity)
        if match is None and not s["many"]:
            continue
        checked += 1
        if s["kind"] is None or not s["value"] or (s["confidence"] is not None and s["confidence"] < rules.confidence):
            continue
        old = seen[match].points[-1] if match is not None else None
        delta = s["kind"] if old is not None and changed(old, s, rules) else None
        noted += delta is not None
        point = {"at": at, "kind": s["kind"], "value": s["value"], "amount": s["amount"], "unit": s["unit"], "ids": s["ids"]}
        thread = s["story_id"] if match is None else match
        if match is None:
            threads[thread] = Thread(s["label"], s["vector"], [point])
        else:
            kept = threads[thread]
            kept.points = [*kept.points, point][-max(1, rules.points) :]
            kept.vector = s["vector"] or kept.vector
        if rules.replay:
            near.put(thread, threads[thread].vector)
        since, before = (old["at"], old) if delta else (None, None)
        out.append((at, s["place"], s["story_id"], thread, delta, since, before and before["value"], s["value"] if delta else None, (s["unit"] or before["unit"]) if delta else None, before and before["ids"], s["ids"] if delta else None, len(threads[thread].points)))
    return out


NAMES = [c.split()[0] for c in STORY.split(", ")]


class Tracker(InOrder):
    """The threads of an account's week."""

    fields = STORY
    out = f"account string, week string, {POINT}"
    order = 3

    def __init__(self, rules: Rules, idle: int = 8 * 86_400_000):
        super().__init__(idle)
        self.rules = rules

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.threads = handle.getMapState("threads", "thread_id long", "label string, vector binary, points string")

    def forget(self) -> None:
        self.threads.clear()

    def step(self, key: tuple, at: int, rows: list[tuple]) -> list[tuple]:
        threads = {k[0]: Thread(v[0], v[1] and bytes(v[1]), json.loads(v[2])) for k, v in self.threads.iterator()}
        before = {i: (t.vector, t.points) for i, t in threads.items()}
        stories = [dict(zip(NAMES, r, strict=True)) for r in rows]
        for s in stories:
            s["vector"], s["ids"] = s["vector"] and bytes(s["vector"]), list(s["ids"] or [])
        out = one_run(threads, at, stories, self.rules)
        for i, t in threads.items():
            if before.get(i) != (t.vector, t.points):
                self.threads.updateValue((i,), (t.label, t.vector, json.dumps(t.points)))
        return [(*key, *r) for r in out]


def _prepared(stories: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x, float).tobytes() for x in v], dtype=object)

    rows = stories.withColumn("amount", amount(F.col("value")))
    return rows.select("account", "week", "ts", F.col("place").cast("long").alias("place"), "story_id", "label", packed("vector").alias("vector"), "many", "kind", "value", "amount", "unit", "confidence", "ids")


def track(stories: DataFrame, rules: Rules | None = None, delay: str = "1 hour") -> DataFrame:
    """(account, week, at, place, story_id, thread_id, delta, since, old, new, unit, old_ids, new_ids, n_points); a table or a stream.

    stories: account, week, ts (of the run), place (in the run), story_id, label, vector, many
    (of several articles), kind, value, unit, confidence, ids. A row is a
    point that a story gave a thread, its own if it met none; ``delta`` and
    the fields after it are set where the point is worth a note.
    """
    rules = rules or Rules()
    rows = _prepared(stories)
    if rows.isStreaming:
        return stateful(rows, ["account", "week"], Tracker(rules), "ts", delay)

    def walk(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        out, threads = [], {}
        near = Near(threads) if rules.replay else None
        found = found.astype(object).where(found.notna(), None)
        for at, run in sorted(found.groupby("at"), key=lambda x: x[0]):
            stories = run.sort_values(["place", "story_id"]).to_dict("records")
            for s in stories:
                s["ids"] = [int(i) for i in s["ids"]] if s["ids"] is not None else []
            out += [(*key, *r) for r in one_run(threads, int(at), stories, rules, near)]
        return pd.DataFrame(out, columns=["account", "week", *[c.split()[0] for c in POINT.split(", ")]], dtype=object)

    return rows.withColumn("at", F.unix_millis("ts")).groupBy("account", "week").applyInPandas(walk, Tracker.out)


def replay(stories: DataFrame, runs: int, rules: Rules | None = None) -> DataFrame:
    """``track`` over each account's last ``runs`` runs, from no threads at all and over the weeks' ends."""
    from dataclasses import replace

    from pyspark.sql import Window

    times = stories.select("account", "ts").distinct()
    last = times.withColumn("n", F.row_number().over(Window.partitionBy("account").orderBy(F.desc("ts")))).where(F.col("n") <= runs).drop("n")
    rows = stories.join(last, ["account", "ts"]).withColumn("week", F.lit("all"))
    return track(rows, replace(rules or Rules(), replay=True))
