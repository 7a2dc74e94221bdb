"""Monitors that need events in order, as stateful stream processors.

Both keep what has come too early in map state and let a timer on the watermark bring it out again, so their results do not
depend on how a stream is cut into files and triggers, as long as no event is later than the watermark allows. State is
dropped by the timers: what is held for a key is what the watermark still leaves open, and a few numbers while it is busy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quality import TRANSITIONS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000
# What the lifecycle keeps of a run, after its name.
NEXT, AT, LAST, ENDS, CLOSES, WAITING = range(6)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with several state variables need, for queries started inside."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def _packed(frame: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class Gauge(StatefulProcessor):
    """Requests outstanding after each arrival of a key, in time order over all triggers.

    A state holds all keys of a group. Moves wait in blocks of ``grain`` microseconds, a part for each time some come, until
    the watermark is past the block's end; then they are replayed in order of time, completions before arrivals, then
    request. The levels that are not zero go on as moves before all others.
    """

    def __init__(self, held_by: Sequence[str], keys: Sequence[str], cap: int, grain: int):
        self.held_by, self.keys, self.cap, self.grain = list(held_by), list(keys), cap, grain
        self.inner = [k for k in keys if k not in held_by]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "parts long, timer long, levels binary")
        self.waiting = handle.getMapState("waiting", "block long, part long", "moves binary")

    def _load(self) -> tuple[int, int | None, bytes | None]:
        return tuple(self.group.get()) if self.group.exists() else (0, None, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, timer, levels = self._load()
        first = None
        for pdf in rows:
            us = pdf["event_time"].astype("datetime64[us]").astype("int64")
            # a completion's name changes no result
            kept = pdf[[*self.inner, "request_id", "at", "step"]].assign(us=us, request_id=pdf["request_id"].where(pdf["step"] > 0, None))
            for block, part in kept.groupby(us // self.grain):
                self.waiting.updateValue((int(block), parts), (_packed(part),))
                first = int(block) if first is None else min(first, int(block))
            parts += 1
        if first is not None and (timer is None or self._due(first) < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = self._due(first)
            self.handle.registerTimer(timer)
        self.group.update((parts, timer, levels))
        yield from ()

    def _due(self, block: int) -> int:
        return -(-(block + 1) * self.grain // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        parts, timer, levels = self._load()
        places = sorted((int(block), int(part)) for block, part in self.waiting.keys())
        blocks = dict.fromkeys(block for block, _ in places if self._due(block) <= now)
        for block in blocks:
            moved = [_unpacked(self.waiting.getValue(place)[0]) for place in places if place[0] == block]
            out, levels = self._replay(dict(zip(self.held_by, key, strict=True)), [_unpacked(levels)] if levels else [], moved)
            if len(out):
                yield out
        for place in places:
            if place[0] in blocks:
                self.waiting.removeKey(place)
        left = [block for block, _ in places if block not in blocks]
        timer = self._due(left[0]) if left else None
        if left:
            self.handle.registerTimer(timer)
        if left or levels:
            self.group.update((parts, timer, levels))
        else:
            self.group.clear()

    def _replay(self, key: dict, levels: list[pd.DataFrame], moved: list[pd.DataFrame]) -> tuple[pd.DataFrame, bytes | None]:
        """Arrivals of one block, and the levels after it."""
        frame = pd.concat([*levels, pd.concat(moved).sort_values(["us", "step", "request_id", "at"])], ignore_index=True)
        runs = frame.groupby(self.inner, sort=False, dropna=False).ngroup() if self.inner else pd.Series(0, frame.index)
        frame["outstanding"] = frame["step"].groupby(runs).cumsum()
        after = frame[~runs.duplicated(keep="last") & (frame["outstanding"] != 0)]
        kept = after[self.inner].assign(request_id=None, at=0.0, step=after["outstanding"], us=0)
        arrived = frame[sum(map(len, levels)):]
        arrived = arrived[arrived["step"] > 0]
        out = arrived.assign(breach=(arrived["outstanding"] > self.cap).astype("int32"), **key)
        return out[[*self.keys, "request_id", "at", "outstanding", "breach"]], _packed(kept) if len(kept) else None

    def close(self) -> None:
        pass


def moves(requests: DataFrame, clock: str, keys: Sequence[str]) -> DataFrame:
    """+1 at each arrival and -1 at each completion of finished requests. ``clock``: SQL of the timestamp of a number of seconds ``at`` of the request's own time."""
    done = requests.where("actual_arrival is not null and completion_time is not null")
    steps = F.array(F.struct(F.col("actual_arrival").alias("at"), F.lit(1).alias("step")), F.struct(F.col("completion_time").alias("at"), F.lit(-1).alias("step")))
    return done.select(*keys, "request_id", F.explode(steps).alias("_e")).select(*keys, "request_id", "_e.at", "_e.step").withColumn("event_time", F.expr(clock))


def in_flight(events: DataFrame, keys: Sequence[str], cap: int, delay: str = "1 minute", grain_seconds: float = 10, held_by: Sequence[str] | None = None) -> DataFrame:
    """keys, request_id, at, outstanding, breach for each arrival the watermark has passed. ``events``: keys, request_id, at, step, event_time.

    ``held_by``: those of the keys whose values share a state (default: all). Reading and writing a state costs some ten
    milliseconds, so short keys are better held together; one group's block of ``grain_seconds`` must fit a task.
    """
    kinds = dict(events.dtypes)
    held = list(held_by or keys)
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", request_id string, at double, outstanding long, breach int"
    return events.withWatermark("event_time", delay).groupBy(*held).transformWithStateInPandas(Gauge(held, keys, cap, int(grain_seconds * MICROS)), out, "Append", "EventTime")


class Lifecycle(StatefulProcessor):
    """State machine of a run over its events in the order of their numbers, over all triggers.

    Numbers count on from ``first``. An event that comes before an earlier number waits; it is replayed when the gap is
    filled, or when the watermark is past it, which gives the missing numbers up. After a terminal state the run is kept for
    ``linger`` milliseconds of event time, so that a second one is found, and then dropped. A state holds all open runs of
    a group, with their waiting events, and is read and written whole; one timer wakes it for the first thing due.
    """

    def __init__(self, first: int, linger: int):
        self.first, self.linger = first, linger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "runs string, timer long")

    def _load(self) -> None:
        runs, self.timer = self.group.get() if self.group.exists() else ("[]", None)
        self.runs = {name: run for name, *run in json.loads(runs)}
        for run in self.runs.values():
            run[WAITING] = {seq: event for seq, *event in run[WAITING]}
        self.found: list[tuple[str, str, str]] = []

    def _save(self) -> None:
        due = [t for *_, closes, waiting in self.runs.values() for t in ([min(e[3] for e in waiting.values())] if waiting else [closes]) if t is not None]
        timer = min(due, default=None)
        if timer != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        if self.runs:
            rows = [[name, *run[:WAITING], [[seq, *event] for seq, event in run[WAITING].items()]] for name, run in self.runs.items()]
            self.group.update((json.dumps(rows), timer))
        else:
            self.group.clear()

    def _replay(self, name: str, run: list, seq: int, kind: str, state: str | None, time: float, ms: int) -> None:
        _, at, last, ends, _, _ = run
        run[NEXT] = seq + 1
        if last is not None and time < last:
            self.found.append((name, str(seq), "event_time_not_monotonic"))
        run[LAST] = time
        if kind != "state":
            return
        if state not in TRANSITIONS:
            self.found.append((name, state, "unknown_lifecycle_state"))
            return
        if at is None:
            if state != "PLANNED":
                self.found.append((name, state, "lifecycle_not_started_at_planned"))
        elif state not in TRANSITIONS[at]:
            self.found.append((name, f"{at}>{state}", "illegal_lifecycle_transition"))
        run[AT] = state
        if state in ("COMPLETE", "FAILED"):
            run[ENDS] = ends + 1
            if run[ENDS] > 1:
                self.found.append((name, name, "terminal_state_count"))
            run[CLOSES] = ms + self.linger

    def _drain(self, name: str, run: list, upto: int | None = None) -> None:
        """Replay what follows on; with ``upto``, all waiting events of up to that time, whatever is missing before them."""
        waiting = run[WAITING]
        while True:
            while run[NEXT] in waiting:
                self._replay(name, run, run[NEXT], *waiting.pop(run[NEXT]))
            if upto is None or not waiting or min(e[3] for e in waiting.values()) > upto:
                return
            run[NEXT] = min(waiting)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        frame = pd.concat([pdf for pdf in rows])  # one trigger's events of one group
        ms = -(-frame["event_time"].astype("datetime64[us]").astype("int64") // 1000)
        for row in frame.assign(ms=ms).sort_values("event_seq", kind="stable").itertuples():
            run = self.runs.setdefault(row.run_id, [self.first, None, None, 0, None, {}])
            event = (row.event_type, row.state, float(row.monotonic_time), int(row.ms))
            if row.event_seq == run[NEXT]:
                self._replay(row.run_id, run, int(row.event_seq), *event)
                self._drain(row.run_id, run)
            elif row.event_seq < run[NEXT]:
                self.found.append((row.run_id, str(row.event_seq), "event_out_of_turn"))
            else:
                run[WAITING][int(row.event_seq)] = event
        self._save()
        yield self._findings()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        now = timerValues.getCurrentWatermarkInMs()
        for name, run in list(self.runs.items()):
            self._drain(name, run, now)
            if run[CLOSES] is not None and run[CLOSES] <= now and not run[WAITING]:
                del self.runs[name]
        self.timer = None
        self._save()
        yield self._findings()

    def _findings(self) -> pd.DataFrame:
        return pd.DataFrame(self.found, columns=["run_id", "subject", "code"]).astype("str")

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, delay: str = "1 minute", first: int = 0, linger_seconds: float = 3600, held_by: Sequence[str] = ("run_id",)) -> DataFrame:
    """run_id, subject, code of what is wrong in each run's events (run_id, event_seq, event_type, state, monotonic_time, event_time).

    A missing terminal state cannot be told while the stream runs; the batch rule reports it. An event whose number was
    passed already (a copy, one later than the watermark, or one whose time is more than ``delay`` after that of the next
    number) is 'event_out_of_turn' and changes nothing. ``held_by``: columns whose values share a state, each with all
    events of a run; a state is read and written whole, so a group is to have some hundred open runs at most.
    """
    held = list(held_by)
    extra = [k for k in held if k != "run_id"]
    narrow = events.select(*extra, "run_id", F.col("event_seq").cast("long").alias("event_seq"), "event_type", "state", "monotonic_time", "event_time")
    return narrow.withWatermark("event_time", delay).groupBy(*held).transformWithStateInPandas(
        Lifecycle(first, int(linger_seconds * 1000)), "run_id string, subject string, code string", "Append", "EventTime")
