"""Jobs, uploads and sessions as state machines with deadlines: one fold for tables and for streams.

A machine is a table of moves (state, event, next state) and of deadlines (state, seconds, next state). An event that the
state has no move for is ignored. Where a state's deadline comes at or before the next event, or before now, the deadline's
move happens first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Progress of a job's states; seconds that an upload may stay pending.
PROGRESS = {"pending": 0, "processing": 10, "completed": 100, "failed": 10, "expired": 0}
PENDING_SECONDS = 24 * 3600.0


@dataclass(frozen=True)
class Machine:
    moves: dict[tuple[str | None, str], str]
    deadlines: dict[str, tuple[float, str]] = field(default_factory=dict)

    def deadline(self, state: str | None, since: float) -> float | None:
        return since + self.deadlines[state][0] if state in self.deadlines else None


#: Pending jobs expire, those in processing that nobody ends count as interrupted.
JOBS = Machine(
    {(None, "submit"): "pending", ("pending", "claim"): "processing", ("processing", "complete"): "completed", ("processing", "fail"): "failed"},
    {"pending": (PENDING_SECONDS, "expired"), "processing": (PENDING_SECONDS / 2, "failed")},
)


@dataclass
class Progress:
    """What is known of one key: its state and since when, its first time, and the events taken and ignored."""

    state: str | None = None
    since: float | None = None
    created: float | None = None
    n_taken: int = 0
    n_ignored: int = 0

    def expire(self, machine: Machine, now: float) -> bool:
        """Moves on if the deadline is at or before now; deadlines may follow one another."""
        moved = False
        while (end := machine.deadline(self.state, self.since)) is not None and end <= now:
            self.state, self.since, moved = machine.deadlines[self.state][1], end, True
        return moved

    def take(self, machine: Machine, at: float, event: str) -> bool:
        to = machine.moves.get((self.state, event))
        if to is None:
            self.n_ignored += 1
            return False
        self.state, self.since, self.n_taken = to, at, self.n_taken + 1
        self.created = at if self.created is None else self.created
        return True


_OUT = ["key", "state", "since", "created", "n_taken", "n_ignored"]


def states(events: DataFrame, machine: Machine, now: float) -> DataFrame:
    """key, state, since, created, n_taken and n_ignored of each key of events (key, at in seconds, event_id, event), as of now.

    Events of a key come in order in a sorted stream of Arrow batches; nothing but one key's progress is held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, one, done = None, None, []

        def end() -> None:
            one.expire(machine, now)
            done.append((key, one.state, one.since, one.created, one.n_taken, one.n_ignored))

        for batch in batches:
            for k, at, event in zip(batch["key"].tolist(), batch["at"].tolist(), batch["event"], strict=True):
                if one is None or k != key:
                    if one is not None:
                        end()
                    key, one = k, Progress()
                one.expire(machine, at)
                one.take(machine, at, event)
            yield pd.DataFrame(done, columns=_OUT)
            done = []
        if one is not None:
            end()
            yield pd.DataFrame(done, columns=_OUT)

    ordered = events.filter("key is not null").select("key", "at", "event_id", "event").repartition("key").sortWithinPartitions("key", "at", "event_id")
    kind = events.schema["key"].dataType.simpleString()
    return ordered.mapInPandas(fold, f"key {kind}, state string, since double, created double, n_taken long, n_ignored long")


class Keeper(StatefulProcessor):
    """The same fold over a stream: a value state a key, and an event-time timer at its deadline."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("progress", "state string, since double, created double, n_taken long, n_ignored long, timer long")

    def _load(self) -> tuple[Progress, int | None]:
        if not self.held.exists():
            return Progress(), None
        *row, timer = self.held.get()
        return Progress(*row), timer

    def _save(self, one: Progress, timer: int | None) -> None:
        end = self.machine.deadline(one.state, one.since)
        wanted = None if end is None else int(end * 1000)
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.held.update((one.state, one.since, one.created, one.n_taken, one.n_ignored, wanted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        one, timer = self._load()
        out = []
        found = pd.concat(list(rows)).sort_values(["at", "event_id"])
        for at, event in zip(found["at"].tolist(), found["event"], strict=True):
            if one.expire(self.machine, at):
                out.append((key[0], one.state, one.since))
            if one.take(self.machine, at, event):
                out.append((key[0], one.state, one.since))
        self._save(one, timer)
        yield pd.DataFrame(out, columns=["key", "state", "since"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        one, _ = self._load()
        out = []
        if one.expire(self.machine, expiredTimerInfo.getExpiryTimeInMs() / 1000):
            out.append((key[0], one.state, one.since))
        self._save(one, None)
        yield pd.DataFrame(out, columns=["key", "state", "since"])

    def close(self) -> None:
        pass


def state_stream(events: DataFrame, machine: Machine, late: str = "1 hour") -> DataFrame:
    """key, state and since at every move of a stream of events (key, ts, event_id, event); needs the RocksDB state store."""
    kind = events.schema["key"].dataType.simpleString()
    timed = events.withWatermark("ts", late).withColumn("at", F.unix_micros("ts") / 1e6)
    return timed.groupBy("key").transformWithStateInPandas(Keeper(machine), f"key {kind}, state string, since double", "append", "eventTime")


def next_pending(jobs: DataFrame, by: str) -> DataFrame:
    """The job that each queue (by) takes next: of those pending the oldest, then the smallest key."""
    return jobs.filter("state = 'pending'").groupBy(by).agg(F.min_by("key", F.struct("created", "key")).alias("key"), F.count("*").alias("n_pending"))


def valid_sessions(sessions: DataFrame, users: DataFrame, now) -> DataFrame:
    """sessions (user_id, expires_at, ...) that end after now, with their users (user_id, email, secret); users without either cannot be signed in."""
    able = users.filter("email is not null and secret is not null").drop("secret")
    return sessions.filter(F.col("expires_at") > now).join(able, "user_id")
