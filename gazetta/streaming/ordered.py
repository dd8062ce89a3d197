"""State machines over a key's rows in the order of their event time, whatever the order they came in.

Rows wait in the state until the watermark has passed their time, and a timer
hands them over; so a row that comes late, but within the watermark's delay,
takes its place, and later ones are dropped by the watermark. A key that is
idle for longer than ``idle`` has its state dropped by the same timer. Each
machine has a batch twin that gives the same rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gazetta.functions.quantity import material

#: The state store that timers, lists and maps need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(rows: DataFrame, keys: list[str], machine: InOrder, ts: str, delay: str) -> DataFrame:
    """``rows`` through a machine. The stream's session needs the RocksDB state store, which is set here."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = rows.withWatermark(ts, delay).withColumn("at", F.unix_millis(ts))
    return timed.groupBy(*keys).transformWithStateInPandas(machine, machine.out, "Append", "EventTime")


class InOrder(StatefulProcessor):
    """``fields``: what is kept of a row, ``at`` (milliseconds) first, then what orders rows of one time; ``out``: the rows given."""

    fields = "at long"
    out = "at long"
    order = 1

    def __init__(self, idle: int = 7 * 86_400_000):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [f.split()[0] for f in self.fields.split(", ")]
        self.columns = [f.split()[0] for f in self.out.split(", ")]
        self.waiting = handle.getListState("waiting", self.fields)
        self.due = handle.getValueState("due", "at long")
        self.last = handle.getValueState("last", "at long")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        """Open the machine's own state."""

    def forget(self) -> None:
        """Drop the machine's own state."""

    def load(self) -> None:
        """Take over what ``step`` needs of the state, once for all rows of a call."""

    def save(self) -> None:
        """Hand back what ``load`` took."""

    def step(self, key: tuple, at: int, rows: list[tuple]) -> list[tuple]:
        """The rows given for a key's rows of one time."""
        raise NotImplementedError

    def _call_at(self, at: int, before: int | None = None) -> None:
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = [tuple(_plain(x) for x in r) for part in rows for r in part[self.names].itertuples(index=False)]
        if came:
            self.waiting.appendList(came)
            first = min(r[0] for r in came)
            # The next call is for the first row that waits, or for the end of an idle state.
            due = self.due.get()
            if due is None or first < due[0]:
                self._call_at(first, due and due[0])
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in rows if r[0] <= now), key=lambda r: r[: self.order])
        later = [r for r in rows if r[0] > now]
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        last = self.last.get()
        last = last and last[0]
        out = []
        self.load()
        for at, same in itertools.groupby(ready, key=lambda r: r[0]):
            if last is not None and at - last > self.idle:
                self.forget()
            out += self.step(key, at, list(same))
            last = at
        if last is not None:
            # Timers count whole milliseconds: one more, so that a row at the very end still finds the state.
            ends = last + self.idle + 1
            if ends <= now and (not later or min(r[0] for r in later) > ends):
                self.forget()
                self.last.clear()
                last = None
            else:
                self.last.update((last,))
        self.save()
        calls = [r[0] for r in later] + ([last + self.idle + 1] if last is not None else [])
        if calls:
            self._call_at(min(calls))
        else:
            self.due.clear()
        yield self._frame(out)


def _plain(x):
    """A value as the state store takes it."""
    if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "tolist") and not isinstance(x, bytes):
        return x.tolist()
    return x


class MovedFacts(InOrder):
    """A key's last value, and a row for each value that moved past the bar since."""

    fields = "at long, tie long, value double"
    out = "key string, at long, tie long, old double, value double"
    order = 2

    def __init__(self, relative: float, absolute: float, idle: int):
        super().__init__(idle)
        self.relative, self.absolute = relative, absolute

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.fact = handle.getValueState("fact", "value double")

    def forget(self) -> None:
        self.old = None

    def load(self) -> None:
        # Each call of the state store takes longer than many steps.
        found = self.fact.get()
        self.stored = self.old = found and found[0]

    def save(self) -> None:
        if self.old is None and self.stored is not None:
            self.fact.clear()
        elif self.old != self.stored:
            self.fact.update((self.old,))

    def step(self, key: tuple, at: int, rows: list[tuple]) -> list[tuple]:
        out = []
        for _, tie, value in rows:
            if value is None:
                continue
            if self.old is not None and is_material(self.old, value, self.relative, self.absolute):
                out.append((key[0], at, tie, self.old, value))
            self.old = value
        return out


def is_material(old: float, new: float, relative: float, absolute: float) -> bool:
    """The rule of ``quantity.material`` for two numbers."""
    change = abs(new - old)
    return (absolute > 0 and change >= absolute) or (old != 0 and change / abs(old) >= relative)


def moved_facts(facts: DataFrame, relative: float, absolute: float, idle: int = 7 * 86_400_000, delay: str = "1 hour") -> DataFrame:
    """(key, at, tie, old, value) of facts (key, ts, tie, value) that moved past the bar since the key's fact before; a table or a stream.

    Facts are in the order of time, then ``tie``; null values are no facts. After ``idle``
    milliseconds without one a key starts anew. A stream gives a fact once the
    watermark has passed it, and holds two numbers a key besides what waits.
    """
    rows = facts.select(F.col("key").cast("string").alias("key"), "ts", F.col("tie").cast("long").alias("tie"), F.col("value").cast("double").alias("value"))
    if rows.isStreaming:
        return stateful(rows, ["key"], MovedFacts(relative, absolute, idle), "ts", delay)
    w = Window.partitionBy("key").orderBy("at", "tie")
    rows = rows.where("value is not null").withColumn("at", F.unix_millis("ts"))
    rows = rows.withColumn("old", F.when(F.col("at") - F.lag("at").over(w) <= idle, F.lag("value").over(w)))
    moved = F.col("old").isNotNull() & material(F.col("old"), F.col("value"), relative, absolute)
    return rows.where(moved).select("key", "at", "tie", "old", "value")


class Gate(InOrder):
    """A chat's day: how many answers it has had, and the turns of each of its talks."""

    fields = "at long, conversation long, turn long, day long, said string, language string"
    out = "chat long, conversation long, turn long, decision string, language string"
    order = 3

    def __init__(self, per_talk: int, per_day: int, idle: int):
        super().__init__(idle)
        self.per_talk, self.per_day = per_talk, per_day

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.day = handle.getValueState("day", "day long, used long")
        self.talks = handle.getMapState("talks", "conversation long", "turns long, at long")

    def forget(self) -> None:
        self.day.clear()
        self.talks.clear()

    def step(self, key: tuple, at: int, rows: list[tuple]) -> list[tuple]:
        out = []
        for _, conversation, turn, day, said, language in rows:
            today, used = self.day.get() if self.day.exists() else (day, 0)
            if today != day:
                used = 0
                # With a new day go the talks that have been silent for as long as a whole state may be.
                for old in [k for k, v in self.talks.iterator() if at - v[1] > self.idle]:
                    self.talks.removeKey(old)
            if said == "guest":
                turns = (self.talks.getValue((conversation,))[0] if self.talks.containsKey((conversation,)) else 0) + 1
                self.talks.updateValue((conversation,), (turns, at))
                said = "turn cap" if turns > self.per_talk else "answer" if used < self.per_day else "daily cap"
                used += said == "answer"
            self.day.update((day, used))
            out.append((key[0], conversation, turn, said, language))
        return out


def decided(messages: DataFrame, *, read_only: Column, writes: list[str], markers: list[str], marked: str = "ur", default: Column | str = "en", per_talk: int = 8, per_day: int = 20, owner: str = "owner", idle: int = 2 * 86_400_000, delay: str = "1 hour") -> DataFrame:
    """(chat, conversation, turn, decision, language) of messages (chat, conversation, turn, sender, text, ts); a table or a stream.

    The owner is always answered (``owner``). Others: a chat that can only be
    read is ``ignored``; a request to change something needs ``approval``;
    then the cap of turns of the talk and of answers of the chat's day hold, else ``answer``.
    Only messages that reach the caps count for them. Markers and request
    words are substrings of the lower-cased text.
    """
    text = F.lower(F.coalesce("text", F.lit("")))

    def any_of(words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(text, F.lit(w.lower()))
        return found

    said = F.when(F.col("sender") == owner, "owner").when(read_only, "ignored").when(any_of(writes), "approval").otherwise("guest")
    language = F.when(any_of(markers), marked).otherwise(default)
    rows = messages.select(*[F.col(c).cast("long").alias(c) for c in ("chat", "conversation", "turn")], "ts", F.unix_date(F.to_date("ts")).cast("long").alias("day"), said.alias("said"), language.alias("language"))
    if rows.isStreaming:
        return stateful(rows, ["chat"], Gate(per_talk, per_day, idle), "ts", delay)
    guest = F.col("said") == "guest"
    order = [F.unix_millis("ts"), "conversation", "turn"]
    talk = F.sum(guest.cast("int")).over(Window.partitionBy("chat", "conversation").orderBy(*order))
    rows = rows.withColumn("_within", guest & (talk <= per_talk))
    used = F.sum(F.col("_within").cast("int")).over(Window.partitionBy("chat", "day").orderBy(*order))
    decision = F.when(~guest, F.col("said")).when(~F.col("_within"), "turn cap").when(used <= per_day, "answer").otherwise("daily cap")
    return rows.select("chat", "conversation", "turn", decision.alias("decision"), "language")
