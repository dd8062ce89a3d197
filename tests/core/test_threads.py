"""Threads of ongoing stories against the rule read one story after the other, as a table and as a stream."""

import datetime as dt
import math
import random

import pytest

from gazetta.plans.threads import Rules, replay, track
from gazetta.streaming import jobs

SCHEMA = "account string, week string, ts timestamp, place int, story_id long, label string, vector array<double>, many boolean, kind string, value string, unit string, confidence double, ids array<long>, part int"
RULES = Rules(similarity=0.9, most_checked=5, most_noted=2, points=2)
START = dt.datetime(2026, 1, 5, 9)


def stories(seed, runs=12):
    """Vectors around a few themes, so that threads are met again; runs of two weeks."""
    rng = random.Random(seed)
    themes = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows, n = [], 0
    for run in range(runs):
        ts = START + dt.timedelta(hours=26 * run)
        week = (ts - dt.timedelta(days=ts.weekday())).date().isoformat()
        for account in ("x", "y"):
            for place in range(rng.randint(0, 9)):
                n += 1
                theme = rng.randrange(4)
                base = themes[theme]
                vector = rng.choice([None, [0.0] * 8, [1.0, 2.0]]) if rng.random() < 0.15 else [x + rng.gauss(0, 0.1) for x in base]
                kind = ("magnitude", "tally", "price", "status")[theme] if rng.random() < 0.8 else rng.choice(["magnitude", "date", None])
                odd = [None, "", "no number"] if rng.random() < 0.1 else []
                value = rng.choice(["Held", " held ", "moved  on", "moved on"]) if kind in ("status", "date") else rng.choice(odd or [f"{rng.randint(1, 9)} million", f"{rng.randint(1, 400)}", f"${rng.randint(1, 9)}k"])
                rows.append((account, week, ts, place, n, f"story {n}", vector, rng.random() < 0.6, kind, value, rng.choice([None, "dead"]), rng.choice([None, None, 0.2, 0.5, 0.9, 0.9]), [n, n + 1], rng.randint(0, 2)))
    rng.shuffle(rows)
    return rows


def number(value):
    text = (value or "").replace("$", "")
    digits = "".join(c for c in text if c.isdigit())
    return float(digits) * (1e6 if "million" in text else 1e3 if text.endswith("k") else 1) if digits else None


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return 0.0
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 9) if norm else 0.0


def is_delta(old, kind, value):
    num, cat = ("magnitude", "tally", "price"), ("status", "date")
    if kind in num and old["kind"] in num:
        a, b = number(old["value"]), number(value)
        if a is None or b is None or (kind == "tally" and b <= a):
            return False
        relative, absolute = {"magnitude": (0.15, 1.0), "tally": (0.0, 1.0), "price": (0.10, 0.0)}[kind]
        return (absolute > 0 and abs(b - a) >= absolute) or (a != 0 and abs(b - a) / abs(a) >= relative)
    return kind in cat and old["kind"] in cat and " ".join(old["value"].lower().split()) != " ".join(value.lower().split())


def plain(rows, live=True, last=None):
    out, state = [], {}
    for account in sorted({r[0] for r in rows}):
        times = sorted({r[2] for r in rows if r[0] == account})
        for ts in times[-last:] if last else times:
            run = sorted((r for r in rows if r[0] == account and r[2] == ts), key=lambda r: (r[3], r[4]))
            threads = state.setdefault((account, run[0][1] if live else "all"), {})
            frozen = {i: {"vector": t["vector"], "points": list(t["points"])} for i, t in threads.items()}
            checked = noted = 0
            for r in run:
                seen = frozen if live else threads
                if live and (checked >= 5 or noted >= 2):
                    break
                score, match = max(((cosine(r[6], t["vector"]), -i) for i, t in seen.items()), default=(0.0, None))
                match = -match if match is not None and score >= 0.9 else None
                if not r[7] and (match is None or not live):
                    continue
                checked += 1
                if r[8] is None or not r[9] or (r[11] is not None and r[11] < 0.5):
                    continue
                old = seen[match]["points"][-1] if match is not None else None
                delta = old is not None and is_delta(old, r[8], r[9])
                noted += delta
                point = {"at": int(ts.replace(tzinfo=dt.UTC).timestamp() * 1000), "kind": r[8], "value": r[9], "unit": r[10], "ids": r[12]}
                if match is None:
                    threads[r[4]] = {"vector": r[6], "points": [point]}
                else:
                    t = threads[match]
                    t["points"] = [*t["points"], point][-2:]
                    t["vector"] = r[6] or t["vector"]
                thread = threads[r[4] if match is None else match]
                note = (r[8], old["at"], old["value"], r[9], r[10] or old["unit"], old["ids"], r[12]) if delta else (None,) * 7
                out.append((account, r[1] if live else "all", point["at"], r[3], r[4], r[4] if match is None else match, *note, len(thread["points"])))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_track_is_the_sequential_rule(spark, seed):
    rows = stories(seed)
    got = sorted(map(tuple, track(spark.createDataFrame(rows, SCHEMA), RULES).collect()), key=str)
    assert got == plain(rows)
    assert sum(r[6] is not None for r in got) >= 5 and any(r[4] != r[5] for r in got)


def test_replay_is_the_sequential_rule(spark):
    rows = stories(3)
    got = sorted(map(tuple, replay(spark.createDataFrame(rows, SCHEMA), 7, RULES).collect()), key=str)
    assert got == plain(rows, live=False, last=7) and any(r[6] is not None for r in got)


def test_stream_is_the_table(spark, tmp_path):
    """Stories land in three parts that mix runs and weeks; a last run closes the ones before."""
    rows = stories(1)
    rows.append(("z", "2027-01-04", START + dt.timedelta(days=365), 0, 9999, "end", None, False, None, None, None, None, [], 2))
    df = spark.createDataFrame(rows, SCHEMA)
    for part in range(3):
        df.where(f"part = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_available(track(jobs.files(spark, f"{tmp_path}/in", df), RULES, delay="100 days"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == plain(rows)


def test_no_stories(spark):
    assert track(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_replay_meets_all_threads_at_once():
    """3,000 stories far apart, each a thread: compared one by one they took over ten seconds; the choices are the plain ones."""
    import time

    import numpy as np

    from gazetta.plans.threads import Near, Thread, nearest, one_run

    rng = np.random.default_rng(3)
    rules = Rules(similarity=0.99, replay=True)
    rows = [{"place": i, "story_id": i, "label": "", "vector": rng.normal(size=64).tobytes(), "many": True, "kind": "tally", "value": "1", "amount": 1.0, "unit": None, "confidence": None, "ids": []} for i in range(3000)]
    start, threads = time.perf_counter(), {}
    assert len(one_run(threads, 0, rows, rules)) == len(threads) == 3000 and time.perf_counter() - start < 5
    few = {i: Thread("", v.tobytes(), []) for i, v in enumerate(rng.integers(-2, 3, size=(200, 4)).astype(float))} | {900: Thread("", None, []), 901: Thread("", np.ones(3).tobytes(), [])}
    near = Near(few)
    for i in range(0, 200, 3):
        few[i].vector = rng.integers(-2, 3, size=3 + i % 2).astype(float).tobytes()
        near.put(i, few[i].vector)
    for x in rng.integers(-2, 3, size=(100, 4)).astype(float):
        scores = [(cosine(list(x), list(np.frombuffer(t.vector or b""))), -i) for i, t in few.items()]
        top = max(scores)
        want = -top[1] if top[0] >= 0.3 else None
        assert near.best(x.tobytes(), few, 0.3) == nearest(x.tobytes(), few, 0.3) == want
