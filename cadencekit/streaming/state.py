"""Typed state of stateful processors: a step's state as typed fields, and rows that wait for their turn.

Every part of a state is a column with a type of its own in the state store, so it can be read with Spark's state reader,
and an array is a list state, to which only new items are written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T

# Rows of a stored run, and rows that are handled at once if so many are due.
RUN_ROWS = 4096
DUE_ROWS = 32_768


def _stored(value, kind: T.DataType):
    """A value as the state store takes it: numbers of exactly its type, structs as tuples."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        items = [value[n] for n in kind.names] if isinstance(value, dict) else list(value)
        return tuple(_stored(v, f.dataType) for v, f in zip(items, kind.fields, strict=True))
    if isinstance(kind, T.ArrayType):
        return [_stored(v, kind.elementType) for v in value]
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return float(value)
    if value != value:
        return None
    if isinstance(kind, T.IntegralType):
        return int(value)
    return bool(value) if isinstance(kind, T.BooleanType) else value


def _plain(value, kind: T.DataType):
    """A stored value as the step gave it: structs whose fields are ``_1``, ``_2`` and so on are lists."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        items = [_plain(v, f.dataType) for v, f in zip(value, kind.fields, strict=True)]
        return items if kind.names[:1] == ["_1"] else dict(zip(kind.names, items, strict=True))
    if isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    return value


class TypedState:
    """One state per key, described by ``schema``.  Its top arrays are list states, all else is one value.

    Fields called ``_1``, ``_2`` and so on stand for a list, one field called ``value`` for the bare value.
    ``ttl_ms`` lets the state of a key go when nothing was written for that long (processing time only).
    """

    def __init__(self, handle, name: str, schema: T.StructType, ttl_ms: int | None = None) -> None:
        self.schema = schema
        self.flat = T.StructType([*[f for f in schema.fields if not isinstance(f.dataType, T.ArrayType)], T.StructField("_set", T.BooleanType())])
        self.value = handle.getValueState(name, self.flat, ttl_ms)
        self.lists = {f.name: (handle.getListState(f"{name}_{f.name}", T.StructType([T.StructField("item", f.dataType.elementType)]), ttl_ms),
                               f.dataType.elementType) for f in schema.fields if isinstance(f.dataType, T.ArrayType)}
        self.ttl_ms = ttl_ms

    def load(self):
        held = self.value.get()
        self.was = {name: [] for name in self.lists}
        if held is None:
            return None
        out = {f.name: _plain(v, f.dataType) for f, v in zip(self.flat.fields, held, strict=True)}
        for name, (items, kind) in self.lists.items():
            self.was[name] = [tuple(i) for i in items.get()]
            out[name] = [_plain(i[0], kind) for i in self.was[name]]
        if self.schema.names == ["value"]:
            return out["value"]
        return [out[n] for n in self.schema.names] if self.schema.names[0] == "_1" else {n: out[n] for n in self.schema.names}

    def save(self, state) -> None:
        """Writes the state of the key that was loaded last."""
        names = self.schema.names
        if names == ["value"]:
            state = {"value": state}
        elif not isinstance(state, dict):
            state = dict(zip(names, state, strict=True))
        for name, (items, kind) in self.lists.items():
            new = [(_stored(v, kind),) for v in state[name]]
            was = self.was[name]
            if self.ttl_ms is None and new[:len(was)] == was:
                if len(new) > len(was):
                    items.appendList(new[len(was):])
            elif new:
                items.put(new)
            else:
                items.clear()
        self.value.update((*[_stored(state[f.name], f.dataType) for f in self.flat.fields[:-1]], True))


def parts_by_key(rows: pd.DataFrame, keys: Sequence[T.StructField]) -> tuple[pd.DataFrame, list[tuple[tuple, int, int]]]:
    """Rows clustered by key, in their order within a key, and the key, start and end of each part."""
    codes = rows.groupby([k.name for k in keys], sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    rows, codes = rows.iloc[order].reset_index(drop=True), codes[order]
    edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(rows)]
    firsts = (rows[k.name].iloc[edges[:-1]].tolist() for k in keys)
    found = [tuple(None if v != v else _stored(v, k.dataType) for v, k in zip(key, keys, strict=True)) for key in zip(*firsts, strict=True)]
    return rows, [(key, *edge) for key, edge in zip(found, pairwise(edges), strict=True)]


class KeyedStates:
    """States of the keys of a group as rows of one map state; ``schema`` has a column for each part of a state.

    A part's fields follow the rules of ``TypedState``, but arrays lie in the row.
    """

    def __init__(self, handle, name: str, keys: Sequence[T.StructField], schema: T.StructType) -> None:
        self.schema = schema
        self.rows = handle.getMapState(name, T.StructType([T.StructField(f"key_{i}", k.dataType) for i, k in enumerate(keys)]), schema)

    def any(self) -> bool:
        """Whether the group holds a state at all."""
        return self.rows.exists()

    def load(self, key: tuple) -> dict | None:
        held = self.rows.getValue(key)
        return None if held is None else self._parts(held)

    def items(self) -> Iterator[tuple[tuple, dict]]:
        for key, held in self.rows.iterator():
            yield tuple(key), self._parts(held)

    def _parts(self, held) -> dict:
        return {f.name: _bare(_plain(v, f.dataType)) for f, v in zip(self.schema.fields, held, strict=True)}

    def save(self, key: tuple, state: dict) -> None:
        self.rows.updateValue(key, tuple(_stored(_boxed(state[f.name], f.dataType), f.dataType) for f in self.schema.fields))


def _bare(state):
    return state["value"] if isinstance(state, dict) and list(state) == ["value"] else state


def _boxed(state, kind: T.DataType):
    return {"value": state} if isinstance(kind, T.StructType) and kind.names == ["value"] else state


class WaitingRows:
    """Rows of a key or group of keys that wait until their time has passed, as sorted runs of at most ``RUN_ROWS`` rows.

    A batch's rows are written once as runs; runs whose time has come are merged in order, and only what is left of
    those that are due in part is written again.  Runs of one batch don't overlap, so memory holds at most one run of each batch
    that still waits, of one key or group, or ``DUE_ROWS`` rows.
    """

    def __init__(self, handle, name: str, time: str, tie: list[str]) -> None:
        self.time, self.by = time, [time, *tie]
        self.runs = handle.getMapState(f"{name}_runs", "run bigint", "first_us bigint, n_rows int")
        self.batches = handle.getMapState(f"{name}_batches", "run bigint", "batch binary")

    def _known(self) -> list[tuple[int, int]]:
        return sorted((value[0], key[0]) for key, value in self.runs.iterator())

    def add(self, pdf: pd.DataFrame, ordered: bool = False) -> None:
        rows = pdf if ordered else pdf.sort_values(self.by, kind="stable")
        number = max((run for _, run in self._known()), default=-1)
        for start in range(0, len(rows), RUN_ROWS):
            part, number = rows.iloc[start:start + RUN_ROWS], number + 1
            batch = pa.RecordBatch.from_pandas(part, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            self.batches.updateValue((number,), (sink.getvalue().to_pybytes(),))
            self.runs.updateValue((number,), (int(part[self.time].iloc[0]), len(part)))

    def first(self) -> int | None:
        """Time of the earliest row."""
        return min(self._known(), default=(None, 0))[0]

    def due(self, now: int) -> Iterator[pd.DataFrame]:
        """Takes out the rows before ``now``, in order."""
        runs = [(first, run) for first, run in self._known() if first < now]
        held: list[pd.DataFrame] = []
        for i, (_, run) in enumerate(runs):
            held.append(pa.ipc.open_stream(bytes(self.batches.getValue((run,))[0])).read_pandas())
            self.batches.removeKey((run,))
            self.runs.removeKey((run,))
            last = i + 1 == len(runs)
            if not last and sum(map(len, held)) < DUE_ROWS:
                continue
            rows = held[0] if len(held) == 1 else pd.concat(held).sort_values(self.by, kind="stable", ignore_index=True)
            n_ready = int((rows[self.time] < (now if last else runs[i + 1][0])).sum())
            held = [rows.iloc[n_ready:]]
            if n_ready:
                yield rows.iloc[:n_ready].reset_index(drop=True)
        if held and len(held[0]):
            self.add(held[0], ordered=True)
