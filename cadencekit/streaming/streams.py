"""Structured Streaming forms of the operators.

``step_stream`` runs any step (a controller, a buffer, the cadence rules) per key over the state
store, so the batch and the stream form share one definition.  Rows are sorted inside a micro-batch, or, given an
``Arrival``, wait for those that come out of order; a row that comes after later ones were already processed is not
lost but emitted with ``late_row``.  States are typed (see ``streaming.state``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from cadencekit.operators.buffers import DRAIN_COLUMNS, PACKET_COLUMNS, DrainedBuffer
from cadencekit.session import checkpoint_base
from cadencekit.streaming.state import KeyedStates, TypedState, WaitingRows, parts_by_key
from cadencekit.streaming.steps import Cadence, Changes, Epochs, Increasing, PinnedEpoch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
# Deadlines and lifetimes in milliseconds.
STOP_DEADLINE_MS, FIRST_WAIT_MS, TTL_MS = 2_000, 3_000, 1_250
DUE, GROUP = "_due_us", "_key_group"
# Groups of keys whose rows wait together; a running stream cannot change it.
GROUPS = 1024


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@dataclass(frozen=True)
class Arrival:
    """Rows may come in any order within ``wait_s`` seconds of event time, and wait that long.

    Rows up to ``grace_s`` later still, and rows without a time, are emitted as late.  Beyond that Spark drops them, and its progress counts them.
    """

    time: str
    wait_s: int
    grace_s: int = 0


class _Keyed(StatefulProcessor):
    """What processors share: one timer per key, and the order of the newest row handled with a running count."""

    def init(self, handle) -> None:
        self.handle = handle

    def seen_state(self, by: Sequence[T.StructField], ttl_ms: int | None = None) -> None:
        fields = [T.StructField(f"by_{i}", f.dataType) for i, f in enumerate(by)]
        self.seen = TypedState(self.handle, "seen", T.StructType([*fields, T.StructField("n", T.LongType())]), ttl_ms)

    def load_seen(self) -> tuple[tuple | None, int]:
        held = self.seen.load()
        if held is None:
            return None, 0
        *last, n = held.values()
        return (None if any(v is None for v in last) else tuple(last)), n

    def save_seen(self, last: tuple | None, n: int) -> None:
        self.seen.save([*(last or [None] * (len(self.seen.schema) - 1)), n])

    def arm(self, at_ms: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_ms is not None:
            self.handle.registerTimer(max(at_ms, 1))

    def table(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self.names).astype(object)

    def close(self) -> None:
        pass


def _orders(pdf: pd.DataFrame, by: Sequence[str]) -> list[tuple]:
    return list(zip(*(pdf[c].tolist() for c in by), strict=True))


class StepProcessor(_Keyed):
    """Runs a step over each micro-batch of a key, sorted in memory."""

    def __init__(self, step, by: Sequence[T.StructField], columns: dict[str, str], names: Sequence[str], state: T.StructType,
                 idle_ms: int | None) -> None:
        self.step, self.fields, self.columns, self.names = step, list(by), columns, list(names)
        self.by, self.state_type, self.idle_ms = [f.name for f in by], state, idle_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.state = TypedState(handle, "step", self.state_type, self.idle_ms)
        self.seen_state(self.fields, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.by, kind="stable", ignore_index=True)
        last, n_late = self.load_seen()
        fresh, old = self.split(pdf, last)
        n_late += len(old)
        if len(fresh):
            state = self.state.load()
            yield self.stepped(fresh, state, n_late)
            self.state.save(self.after)
            last = _orders(fresh.tail(1), self.by)[0]
        self.save_seen(last, n_late)
        yield from self.late(old, n_late)

    def split(self, pdf: pd.DataFrame, last: tuple | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        late = pd.Series([last is not None and o <= last for o in _orders(pdf, self.by)], index=pdf.index, dtype=bool)
        return pdf[~late].reset_index(drop=True), pdf[late].copy()

    def stepped(self, fresh: pd.DataFrame, state, n_late: int) -> pd.DataFrame:
        out, self.after = self.step(fresh, state)
        fresh = fresh.assign(late_row=False, n_late_rows=n_late, **{n: pd.Series(out[n], dtype=object) for n in self.columns})
        return fresh[self.names].astype(object)

    def late(self, old: pd.DataFrame, n_late: int) -> Iterator[pd.DataFrame]:
        if len(old):
            old = old.assign(late_row=True, n_late_rows=n_late, **dict.fromkeys(self.columns))
            yield old[self.names].astype(object)


class WaitingStepProcessor(StepProcessor):
    """Runs a step over rows in order of time, whatever order they came in within the wait.

    It handles a group of keys at a time: their rows wait together, and every key has a state of its own.
    """

    def __init__(self, *args, arrival: Arrival, inputs: Sequence[str], keys: Sequence[T.StructField]) -> None:
        super().__init__(*args, None)
        self.arrival, self.inputs, self.keys = arrival, list(inputs), list(keys)

    def init(self, handle) -> None:
        self.handle = handle
        last = T.StructType([T.StructField(f"_{i}", f.dataType) for i, f in enumerate(self.fields, 1)])
        self.states = KeyedStates(handle, "states", self.keys, T.StructType(
            [T.StructField("step", self.state_type), T.StructField("last", last), T.StructField("n_late", T.LongType())]))
        self.handled = handle.getValueState("handled", "until_us bigint")
        self.waiting = WaitingRows(handle, "waiting", DUE, self.by)

    def held(self, key: tuple) -> dict:
        return self.states.load(key) or {"step": None, "last": None, "n_late": 0}

    def handleInputRows(self, key, rows, timerValues):
        handled = self.handled.get()
        for pdf in rows:
            # A column computed from the watermark's own column comes in without its name.
            pdf = pdf.set_axis(self.inputs, axis=1)
            timeless = pdf[DUE].isna()
            fresh, old = pdf[~timeless].astype({DUE: "int64"}), pdf[timeless]
            # Only a row before the time up to which rows were handled can be late.
            behind = fresh[DUE] < handled[0] if handled else None
            if behind is not None and behind.any():
                more, late = self.split_keys(fresh[behind])
                fresh = pd.concat([fresh[~behind], more])
                old = pd.concat([late, old]) if len(old) else late
            if len(old):
                yield self.late_keys(old)
            if len(fresh):
                self.waiting.add(fresh)
        self.arm_next()

    def split_keys(self, pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        pdf, parts = parts_by_key(pdf, self.keys)
        split = []
        for key, start, end in parts:
            last = self.held(key)["last"]
            split.append(self.split(pdf.iloc[start:end], None if last is None else tuple(last)))
        return tuple(pd.concat(side) for side in zip(*split, strict=True))

    def late_keys(self, old: pd.DataFrame) -> pd.DataFrame:
        old, parts = parts_by_key(old, self.keys)
        counts: list[int] = []
        for key, start, end in parts:
            held = self.held(key)
            held["n_late"] += end - start
            self.states.save(key, held)
            counts += [held["n_late"]] * (end - start)
        old = old.assign(late_row=True, n_late_rows=counts, **dict.fromkeys(self.columns))
        return old[self.names].astype(object)

    def arm_next(self) -> None:
        first = self.waiting.first()
        self.arm(None if first is None else first // 1000 + 1 - self.arrival.grace_s * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = (timerValues.getCurrentWatermarkInMs() + self.arrival.grace_s * 1000) * 1000
        touched: dict[tuple, dict] = {}
        for rows in self.waiting.due(now):
            yield self.stepped_keys(rows, touched)
        for one, state in touched.items():
            self.states.save(one, state)
        self.handled.update((now,))
        self.arm_next()

    def stepped_keys(self, rows: pd.DataFrame, touched: dict[tuple, dict]) -> pd.DataFrame:
        rows, parts = parts_by_key(rows, self.keys)
        out: dict[str, list] = {n: [] for n in self.columns}
        counts: list[int] = []
        for key, start, end in parts:
            state = touched[key] if key in touched else touched.setdefault(key, self.held(key))
            added, state["step"] = self.step(rows.iloc[start:end], state["step"])
            for name, values in out.items():
                values += added[name]
            counts += [state["n_late"]] * (end - start)
            state["last"] = [rows[c].iat[end - 1] for c in self.by]
        rows = rows.assign(late_row=False, n_late_rows=counts, **{n: pd.Series(v, dtype=object) for n, v in out.items()})
        return rows[self.names].astype(object)


def in_groups(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys dealt to ``GROUPS`` groups, because a call for each key would cost more than its rows."""
    return stream.withColumn(GROUP, F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int"))


def step_stream(stream: DataFrame, keys: Sequence[str], by: Sequence[str], step, columns: dict[str, str] | None = None,
                arrival: Arrival | None = None, idle_ms: int | None = None) -> DataFrame:
    """Run a step over a stream; adds its columns, ``late_row`` and the running ``n_late_rows``.

    Without ``arrival`` the rows of a micro-batch are sorted in memory and handled at once.  With it, ``by`` must follow
    event time.  ``idle_ms`` lets the state of a key go that got no row for so long (by the clock); its next row is a first one.
    """
    if arrival and idle_ms:
        raise ValueError("idle_ms goes by processing time, an arrival by event time: give one of them")
    columns = columns or step.columns
    added = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items())
                                 + ", late_row boolean, n_late_rows bigint")
    schema = T.StructType([*stream.schema.fields, *added.fields])
    state = T.StructType.fromDDL(step.held(lambda name: stream.schema[name].dataType.simpleString()))
    args = (step, [stream.schema[c] for c in by], columns, schema.names, state)
    use_state_store(stream.sparkSession)
    if arrival is None:
        return stream.groupBy(*keys).transformWithStateInPandas(
            StepProcessor(*args, idle_ms), schema, "append", "processingTime" if idle_ms else "none")
    processor = WaitingStepProcessor(*args, arrival=arrival, inputs=[*stream.columns, DUE, GROUP], keys=_fields(stream, keys))
    return (in_groups(stream.withColumn(DUE, F.unix_micros(arrival.time)), keys)
            .withWatermark(arrival.time, f"{arrival.wait_s + arrival.grace_s} seconds").groupBy(GROUP)
            .transformWithStateInPandas(processor, schema, "append", "eventTime"))


def tick_counters_stream(stream: DataFrame, keys: Sequence[str], time: str, kind: str, kinds: Sequence[str],
                         delay: str = "10 seconds", tick: str = "1 second") -> DataFrame:
    """Tumbling counts per kind, with the time that really passed between first and last row."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    elapsed = (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 1e6
    return (stream.withWatermark(time, delay).groupBy(*keys, F.window(time, tick).alias("tick"))
            .agg(*counts, elapsed.alias("elapsed_s")))


def cadence_stream(stream: DataFrame, keys: Sequence[str], by: Sequence[str], arrival: Arrival | None = None, **options) -> DataFrame:
    return step_stream(stream, keys, by, Cadence(**options), arrival=arrival)


def epochs_stream(stream: DataFrame, keys: Sequence[str], by: Sequence[str], arrival: Arrival | None = None, **options) -> DataFrame:
    """Exact epochs, with the size and short-interval rules that a session window lacks."""
    return step_stream(stream, keys, by, Epochs(**options), arrival=arrival)


def session_epochs_stream(stream: DataFrame, keys: Sequence[str], time: str, gap: str, delay: str) -> DataFrame:
    """Epochs by gaps alone, as session windows that merge while rows come in any order within ``delay``: one row for each
    epoch when the watermark has passed it.  A row exactly ``gap`` after the last one opens a new epoch.

    This is the approximate form of ``epochs_stream``: sizes and intervals that are too short don't count.  Its state is
    one window for each open epoch.
    """
    session = F.session_window(time, gap).alias("session")
    return (stream.withWatermark(time, delay).groupBy(*keys, session)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first"), F.max(time).alias("last")))


def change_stream(stream: DataFrame, keys: Sequence[str], by: Sequence[str], arrival: Arrival | None = None, **options) -> DataFrame:
    return step_stream(stream, keys, by, Changes(**options), arrival=arrival)


def pin_epoch(stream: DataFrame, keys: Sequence[str], by: Sequence[str], arrival: Arrival | None = None) -> DataFrame:
    """Rows with ``reset_to`` are resets; later rows of other epochs are refused."""
    return step_stream(stream, keys, by, PinnedEpoch(), arrival=arrival)


def count_late(stream: DataFrame, keys: Sequence[str], by: Sequence[str], time: str = "pts_ns",
               arrival: Arrival | None = None) -> DataFrame:
    """Drop nothing silently: rows not later than all before them are marked and counted."""
    return step_stream(stream, keys, by, Increasing(time), arrival=arrival)


def control_stream(stream: DataFrame, keys: Sequence[str], by: Sequence[str], step, arrival: Arrival | None = None) -> DataFrame:
    """Any controller of ``operators.control`` as a stream."""
    return step_stream(stream, keys, by, step, arrival=arrival)


def dedupe_stream(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First row per key within the watermark.  Times must not sit at the epoch itself (see README)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


class LatestProcessor(_Keyed):
    """Newest row per key and micro-batch; the rows it overtook are counted.  Holds one row of the micro-batch at a time."""

    def __init__(self, by: Sequence[T.StructField], names: Sequence[str], idle_ms: int | None) -> None:
        self.fields, self.by, self.names, self.idle_ms = list(by), [f.name for f in by], list(names), idle_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.seen_state(self.fields, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        last, dropped = self.load_seen()
        best, count = None, 0
        for pdf in rows:
            count += len(pdf)
            top = pdf.sort_values(self.by, kind="stable").tail(1)
            order = _orders(top, self.by)[0]
            if best is None or order > best[0]:
                best = (order, top)
        stale = last is not None and best[0] <= last
        dropped += count - (not stale)
        self.save_seen(last if stale else best[0], dropped)
        if not stale:
            yield best[1].assign(n_dropped=dropped)[self.names].astype(object)


def latest_stream(stream: DataFrame, keys: Sequence[str], by: Sequence[str], idle_ms: int | None = None) -> DataFrame:
    """Latest-only delivery: at most one pending row per key, with a running count of drops.  ``idle_ms`` as in ``step_stream``."""
    schema = T.StructType([*stream.schema.fields, T.StructField("n_dropped", T.LongType())])
    use_state_store(stream.sparkSession)
    return stream.groupBy(*keys).transformWithStateInPandas(
        LatestProcessor([stream.schema[c] for c in by], schema.names, idle_ms), schema, "append", "processingTime" if idle_ms else "none")


class BufferProcessor(_Keyed):
    """Bounded buffer with drains; what is still pending two seconds after a stop is dropped.

    It handles a group of keys at a time: the deadlines of their stops wait together, and every key has a buffer of its own.
    """

    STATE = "queue array<struct<_1: bigint, _2: bigint, _3: bigint>>, last bigint"

    def __init__(self, keys: Sequence[T.StructField], by: Sequence[str], step: DrainedBuffer, deadline_ms: int, by_clock: bool,
                 names: Sequence[str]) -> None:
        self.keys, self.by, self.step, self.names = list(keys), list(by), step, list(names)
        self.deadline_ms, self.by_clock = deadline_ms, by_clock
        self.state_type = T.StructType.fromDDL(self.STATE)

    def init(self, handle) -> None:
        super().init(handle)
        self.states = KeyedStates(handle, "buffers", self.keys, T.StructType([T.StructField("buffer", self.state_type)]))
        self.stops = WaitingRows(handle, "stops", DUE, [])

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(self.by, kind="stable", ignore_index=True)
        stops = pdf.loc[pdf["stop_ms"].notna(), [*(k.name for k in self.keys), "stop_ms"]]
        if len(stops):
            from_ms = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else stops["stop_ms"].astype("int64")
            due = stops.drop(columns="stop_ms").assign(**{DUE: (from_ms + self.deadline_ms) * 1000})
            self.stops.add(due.drop_duplicates())
            self.arm_next()
        pdf, parts = parts_by_key(pdf, self.keys)
        # A key has few rows, of which slices of arrays cost less than those of a frame.
        columns = {c: pdf[c].to_numpy() for c in PACKET_COLUMNS}
        known = self.states.any()
        out = []
        for one, start, end in parts:
            held = self.states.load(one) if known else None
            added, state = self.step({c: v[start:end] for c, v in columns.items()}, held and held["buffer"])
            self.states.save(one, {"buffer": state})
            changes = zip(*(added[n] for n in DRAIN_COLUMNS), strict=True)
            out += [(*one, "media", *change) for change in changes if change[0] or change[1]]
        yield from self.table(out)

    def arm_next(self) -> None:
        first = self.stops.first()
        self.arm(None if first is None else first // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()
        stopped: dict[tuple, None] = {}
        for rows in self.stops.due(max(now, expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000):
            stopped |= dict.fromkeys(one for one, *_ in parts_by_key(rows, self.keys)[1])
        out = []
        for one in stopped:
            state = self.states.load(one)["buffer"]
            if state["queue"]:
                out.append((*one, "deadline", [e[0] for e in state["queue"]], [], 0))
                self.states.save(one, {"buffer": {"queue": [], "last": state["last"]}})
        self.arm_next()
        yield from self.table(out)


def buffer_stream(stream: DataFrame, keys: Sequence[str], by: Sequence[str], time: str | None, delay: str = "0 seconds",
                  step: DrainedBuffer | None = None, deadline_ms: int = STOP_DEADLINE_MS) -> DataFrame:
    """Buffer events of a stream.  ``stop_ms`` (event time) on a row starts its deadline.  Without ``time`` the deadline goes by
    the clock, from when the stop is handled, and holds also when no more rows come."""
    fields = _fields(stream, keys)
    added = T.StructType.fromDDL("event string, " + ", ".join(f"{n} {t}" for n, t in DRAIN_COLUMNS.items()))
    schema = T.StructType([*fields, *added.fields])
    use_state_store(stream.sparkSession)
    # Each column of a row costs time on its way to the worker.
    stream = stream.select(*dict.fromkeys([*keys, *by, *([time] if time else []), *PACKET_COLUMNS, "stop_ms"]))
    timed = stream.withWatermark(time, delay) if time else stream
    return in_groups(timed, keys).groupBy(GROUP).transformWithStateInPandas(
        BufferProcessor(fields, by, step or DrainedBuffer(), deadline_ms, time is None, schema.names), schema,
        "append", "eventTime" if time else "processingTime")


class _InOrder(_Keyed):
    """Rows wait in the state until the watermark has passed them, so that they are handled in the order of
    ``(time, tie)`` whatever files and triggers they came in.  Times are microseconds.  Keys are handled in groups.

    Subclasses give ``STATE`` (its types), ``fresh`` (the state of a new key), ``one`` (a row), ``due`` (the time at which
    the state changes by itself, or None) and ``lapse`` (that change).  Both yield output rows as tuples.
    """

    def __init__(self, keys: Sequence[T.StructField], time: str, tie: str, value: str, names: Sequence[str]) -> None:
        self.keys, self.time, self.tie, self.value = list(keys), time, tie, value
        self.names = [*(k.name for k in keys), *names]
        self.inputs = list(dict.fromkeys([*(k.name for k in keys), time, tie, value]))
        self.state_type = T.StructType.fromDDL(self.STATE)

    def init(self, handle) -> None:
        super().init(handle)
        self.states = KeyedStates(handle, "states", self.keys, T.StructType([T.StructField("state", self.state_type)]))
        self.next_due = handle.getValueState("next_due", "due_us bigint")
        self.waiting = WaitingRows(handle, "waiting", self.time, [self.tie])

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            self.waiting.add(pdf[self.inputs])
        due = self.next_due.get()
        self.arm_next(due[0] if due else None)
        yield from ()

    def arm_next(self, due: int | None) -> None:
        times = [t for t in (self.waiting.first(), due) if t is not None]
        self.arm(min(times) // 1000 + 1 if times else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        states = {one: held["state"] for one, held in self.states.items()}
        touched = set()
        for rows in self.waiting.due(now):
            out = []
            rows, parts = parts_by_key(rows, self.keys)
            columns = [rows[c].tolist() for c in (self.time, self.tie, self.value)]
            for one, start, end in parts:
                touched.add(one)
                state = states.setdefault(one, self.fresh())
                for row in zip(*(c[start:end] for c in columns), strict=True):
                    out += [one + t for t in self.lapsed(state, row[0])]
                    out += [one + t for t in self.one(state, *row)]
            yield from self.table(out)
        out = []
        for one, state in states.items():
            if lapsed := self.lapsed(state, now):
                touched.add(one)
                out += [one + t for t in lapsed]
        yield from self.table(out)
        for one in touched:
            self.states.save(one, {"state": states[one]})
        due = min((t for t in map(self.due, states.values()) if t is not None), default=None)
        self.next_due.update((due,))
        self.arm_next(due)

    def lapsed(self, state, before: int) -> list[tuple]:
        out = []
        while (due := self.due(state)) is not None and due < before:
            out += self.lapse(state)
        return out


class ExpiryProcessor(_InOrder):
    """Announce values when they are stated and again when their lifetime has passed."""

    STATE = "at bigint, value double"

    def __init__(self, *columns, ttl_us: int) -> None:
        super().__init__(*columns, ("state", "at_us", "value"))
        self.ttl_us = ttl_us

    def fresh(self):
        return {"at": None, "value": None}

    def due(self, state):
        return None if state["at"] is None else state["at"] + self.ttl_us

    def lapse(self, state):
        yield "expired", self.due(state), state["value"]
        state |= self.fresh()

    def one(self, state, at, _, value):
        state |= {"at": at, "value": value}
        yield "active", at, value


def ttl_stream(stream: DataFrame, keys: Sequence[str], time: str, time_us: str, tie: str, value: str, delay: str,
               ttl_ms: int = TTL_MS) -> DataFrame:
    """Activity with a lifetime: one row when stated, one when it lapses; a value restated at the very end of its
    lifetime has not lapsed.  Rows of one time follow ``tie``."""
    return _in_order(stream, keys, time, delay, ExpiryProcessor(_fields(stream, keys), time_us, tie, value, ttl_us=ttl_ms * 1000),
                     "state string, at_us bigint, value double")


def _in_order(stream: DataFrame, keys: Sequence[str], time: str, delay: str, processor: _InOrder, added: str) -> DataFrame:
    schema = T.StructType([*[stream.schema[k] for k in keys], *T.StructType.fromDDL(added).fields])
    use_state_store(stream.sparkSession)
    return in_groups(stream, keys).withWatermark(time, delay).groupBy(GROUP).transformWithStateInPandas(
        processor, schema, "append", "eventTime")


def _fields(stream: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [stream.schema[n] for n in names]


class FirstEventProcessor(_InOrder):
    """Report a started stream whose first picture does not come in time, and when it comes."""

    STATE = "start bigint, state string"

    def __init__(self, *columns, wait_us: int) -> None:
        super().__init__(*columns, ("state", "at_us"))
        self.wait_us = wait_us

    def fresh(self):
        return {"start": None, "state": None}

    def due(self, state):
        return state["start"] + self.wait_us if state["state"] == "waiting" else None

    def lapse(self, state):
        yield "no_picture", self.due(state)
        state["state"] = "no_picture"

    def one(self, state, at, _, kind):
        if kind == "start" and state["start"] is None:
            state |= {"start": at, "state": "waiting"}
        elif kind == "picture" and state["start"] is not None and state["state"] != "running":
            state["state"] = "running"
            yield "running", at


def first_event_timeout(stream: DataFrame, keys: Sequence[str], time: str, time_us: str, tie: str, kind: str, delay: str,
                        wait_ms: int = FIRST_WAIT_MS) -> DataFrame:
    """Rows of kind ``start`` and ``picture`` in; ``no_picture`` and ``running`` states out."""
    return _in_order(stream, keys, time, delay, FirstEventProcessor(_fields(stream, keys), time_us, tie, kind, wait_us=wait_ms * 1000),
                     "state string, at_us bigint")


def wall_clock(pts_ns: Column, session_start: Column) -> Column:
    """Event time of a zero-based media time: anchored to the session's wall clock."""
    return F.timestamp_micros(F.unix_micros(session_start) + F.floor(pts_ns / 1000).cast("long"))


def drain(stream: DataFrame, mode: str = "append", partitions: int | None = None,
          flush: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over everything available and return its output as a table.

    ``partitions`` sets the number of state stores, which a stream fixes when it first starts.  ``flush`` is
    called when all is read; it should bring a row late enough to move the watermark past all others, and the
    stream then runs on.  Rows dropped behind the watermark are an error.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint_base(spark)}/drain-{uuid.uuid4().hex}"
    usual = spark.conf.get(SHUFFLE_PARTITIONS)
    try:
        spark.conf.set(SHUFFLE_PARTITIONS, str(partitions or usual))
        for last in ((None, flush) if flush else (None,)):
            if last:
                last()
            query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
                     .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
            query.awaitTermination()
            lost = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
            if lost:
                raise RuntimeError(f"{lost} rows were behind the watermark: its delay must cover their disorder")
    finally:
        spark.conf.set(SHUFFLE_PARTITIONS, usual)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
