"""Ordered folds: state machines whose next state needs the last one.

``fold`` runs a step function over each stream in order.  Spark partitions and sorts the rows; a
task then reads them in Arrow batches and keeps only the state of the current stream, so no stream
is ever held in memory.  A stream above the row limit is cut (see ``ordered``): every piece first
runs from the empty state at the same time, and only pieces whose true incoming state differs from
the one they used run again.  The result is exact once no incoming state changes, because the first
piece is always right.  States are compared exactly.  Most machines in this library forget (they reset, or keep a bounded
history), so this takes two or three rounds; one that does not has a way ``across`` pieces of its own (see ``scans``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cadencekit.operators.ordered import CUT, Ordered, join_on, ordered
from cadencekit.session import materialise, sized_partitions

# A step takes the next ordered rows of one stream and the state before them (None at its start)
# and returns one dict of lists (the new columns) and the state after them.
Step = Callable[[pd.DataFrame, object], tuple[dict[str, list], object]]

GROUP = "_group"


def fold(df: DataFrame, keys: Sequence[str], by: Sequence[str], step: Step,
         columns: dict[str, str], limit: int | None = None) -> DataFrame:
    """Add ``columns`` (name -> DDL type) computed by ``step`` in stream order."""
    stream = ordered(df, keys, by, limit)
    if not stream.cut:
        return emit(stream.df, list(keys), list(by), step, columns)
    pinned = replace(stream, df=materialise(stream.df))
    if hasattr(step, "across"):
        out = step.across(pinned)
    else:
        with_state = join_on(pinned.df, _settle(pinned, step), pinned.part)
        out = emit(with_state, pinned.part, list(by), step, columns).drop(CUT)
    return out.unionByName(emit(pinned.calm.df, list(keys), list(by), step, columns))


def in_order(df: DataFrame, group: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows clustered by group and sorted, with the group as one text column."""
    # An explicit number keeps small inputs on all cores: the work per row is in Python.
    number = sized_partitions(df)
    marked = df.repartition(*([number] if number else []), *group).withColumn(GROUP, F.to_json(F.struct(*group)))
    return marked.sortWithinPartitions(GROUP, *by)


def _segments(batches: Iterator[pa.RecordBatch], step: Step, has_state: bool):
    """Run the step over each group's rows in each batch: (batch, group, first, columns, state)."""
    group, state = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        pdf = batch.to_pandas(integer_object_nulls=True)
        ids = pdf[GROUP].to_numpy()
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for start, end in pairwise(edges):
            if ids[start] != group:
                group, raw = ids[start], pdf["_in"].iloc[start] if has_state else None
                state = json.loads(raw) if raw else None
            part, state = step(pdf.iloc[start:end], state)
            yield batch, group, start, end, part, state


def emit(df: DataFrame, group: list[str], by: list[str], step: Step,
          columns: dict[str, str]) -> DataFrame:
    has_state = "_in" in df.columns
    added = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items()))
    kept = [f for f in df.schema.fields if f.name != "_in"]
    schema = T.StructType([*kept, *added.fields])
    kinds = {f.name: to_arrow_type(f.dataType) for f in added.fields}
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, start, end, part, _ in _joined(_segments(batches, step, has_state)):
            whole = batch.slice(start, end - start)
            arrays = [whole.column(n) for n in names] + [pa.array(part[n], kinds[n]) for n in kinds]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *kinds])

    return in_order(df, group, by).mapInArrow(run, schema)


def _joined(segments):
    """Merge the segments of one batch, so that output batches are as large as input ones."""
    held = None
    for batch, group, start, end, part, state in segments:
        if held is not None and held[0] is batch:
            for name, values in part.items():
                held[4][name].extend(values)
            held = (batch, group, held[2], end, held[4], state)
        else:
            if held is not None:
                yield held
            held = (batch, group, start, end, {n: list(v) for n, v in part.items()}, state)
    if held is not None:
        yield held


def piece_states(stream: Ordered, step: Step, todo: DataFrame) -> DataFrame:
    """State after each piece of ``todo`` (its part, and the state before it as ``_in``), as JSON in ``_out``."""
    part, by = stream.part, list(stream.by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for _, group, _, _, _, state in _segments(batches, step, True):
            if last is not None and last[0] != group:
                yield _state_row(last)
            last = (group, state)
        if last is not None:
            yield _state_row(last)

    rows = join_on(stream.df, todo.select(*part, "_in"), part, "inner")
    states = in_order(rows, part, by).mapInArrow(run, f"{GROUP} string, _out string")
    keyed = todo.select(*part).withColumn(GROUP, F.to_json(F.struct(*part)))
    return keyed.join(states, GROUP).drop(GROUP)


def _settle(stream: Ordered, step: Step) -> DataFrame:
    """Incoming state of every piece, iterated until it no longer changes."""
    part = stream.part
    cell_order = Window.partitionBy(*stream.keys).orderBy(CUT)
    cells = stream.df.select(*part).distinct()
    empty = F.lit(None).cast("string")
    used = materialise(cells.withColumn("_in", empty))
    states, todo = None, used
    while True:
        fresh = piece_states(stream, step, todo)
        if states is not None:
            fresh = join_on(states, todo.select(*part), part, "left_anti").unionByName(fresh)
        states = materialise(fresh)
        incoming = states.select(*part, F.lag("_out").over(cell_order).alias("_in"))
        was = used.select(*part, F.col("_in").alias("_was"))
        changed = join_on(incoming, was, part).filter(~F.col("_in").eqNullSafe(F.col("_was")))
        todo = materialise(changed.drop("_was"))
        if todo.isEmpty():
            return used.select(*part, "_in")
        used = materialise(join_on(used, todo.select(*part), part, "left_anti").unionByName(todo))


def _state_row(last: tuple[str, object]) -> pa.RecordBatch:
    group, state = last
    return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (group, json.dumps(state))], names=[GROUP, "_out"])
