"""State machines over cut streams in a fixed number of passes.

``folds`` runs the pieces of a cut stream again until no incoming state changes, which takes as many rounds as pieces
where a state is never forgotten.  Two machines of that kind have a shape that allows better:

* a chain of publications goes from a time to the first one at least ``every`` later.  Each piece follows the chain from
  every row at which it may be entered, and pointer doubling over these entries finds the ones that the stream
  takes: rounds grow with the logarithm of the pieces;
* a smoothed value is an affine map of the value before.  Each piece runs once and gives the map from its start to every
  row; the pieces' maps, one row each, are composed in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadencekit.operators.asof import asof
from cadencekit.operators.folds import GROUP, emit, fold, in_order, piece_states
from cadencekit.operators.ordered import CUT, Ordered, join_on
from cadencekit.session import materialise

PIECE = "_piece"
#: Pieces of one stream whose maps, three numbers each, one task composes; by default that is 4 * 10^12 rows.
MAPS_A_TASK = 1_000_000


def piece_numbers(stream: Ordered) -> DataFrame:
    """The pieces of a cut stream with their place in it, from 1."""
    along = Window.partitionBy(*stream.keys).orderBy(CUT)
    return materialise(stream.df.select(*stream.part).distinct().withColumn(PIECE, F.row_number().over(along).cast("long")))


def chain_exits(times: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Times at which a chain can enter these sorted times, and for each the last time it takes among them.

    The time before is not after the first one, so a chain enters less than ``every`` after that or at the next time.
    """
    times = np.unique(times)
    after = np.searchsorted(times, times + every).tolist()
    exits = list(range(len(times)))
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            exits[i] = exits[after[i]]
    entries = int(np.searchsorted(times, times[0] + every)) + 1
    return times[:entries], times[exits[:entries]]


def _entries(stream: Ordered, pieces: DataFrame, time: str, every: int) -> DataFrame:
    """Per piece and time at which a chain can enter it: ``_t`` and ``_exit``."""
    schema = pa.schema([(GROUP, pa.string()), ("_t", pa.int64()), ("_exit", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            names, times = batch.column(GROUP).to_numpy(zero_copy_only=False), batch.column("_time").to_numpy()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start < end and names[start] != group:
                    yield from ended(group, held)
                    group, held = names[start], []
                held.append(times[start:end])
        yield from ended(group, held)

    def ended(group: str | None, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if group is not None:
            entries, exits = chain_exits(np.concatenate(held), every)
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(entries)), pa.array(entries), pa.array(exits)], schema=schema)

    rows = stream.df.select(*stream.part, *dict.fromkeys(stream.by), F.col(time).cast("long").alias("_time"))
    found = in_order(rows, stream.part, list(stream.by)).select(GROUP, "_time").mapInArrow(run, f"{GROUP} string, _t long, _exit long")
    keyed = pieces.withColumn(GROUP, F.to_json(F.struct(*stream.part)))
    return materialise(keyed.join(found, GROUP).select(*stream.keys, PIECE, "_t", "_exit"))


def _taken(entries: DataFrame, keys: list[str], every: int) -> DataFrame:
    """The entries that the chain from each stream's first row takes."""
    node = [*keys, PIECE, "_t"]
    wanted = entries.withColumn("_x", F.col("_exit") + every)
    others = entries.select(*keys, F.col(PIECE).alias("_to_piece"), F.col("_t").alias("_to"))
    nexts = asof(wanted, others, keys, "_x", "_to", ["_to_piece"], tie="_to_piece", forward=True, prefix="_next")
    jumps = materialise(nexts.filter("_nexttime is not null").select(*node, F.col("_next_to_piece").alias("_p2"), F.col("_nexttime").alias("_t2")))
    taken = materialise(entries.filter(F.col(PIECE) == 1).groupBy(*keys, PIECE).agg(F.min("_t").alias("_t")))
    while True:
        moved = materialise(join_on(taken, jumps, node, "inner").select(*keys, F.col("_p2").alias(PIECE), F.col("_t2").alias("_t")))
        if moved.isEmpty():
            return join_on(taken, entries, node)
        taken = materialise(taken.unionByName(moved))
        onward = jumps.select(*keys, F.col(PIECE).alias("_p2"), F.col("_t").alias("_t2"), F.col("_p2").alias("_p4"), F.col("_t2").alias("_t4"))
        jumps = materialise(join_on(jumps, onward, [*keys, "_p2", "_t2"], "inner").select(*node, F.col("_p4").alias("_p2"), F.col("_t4").alias("_t2")))


def across_publications(stream: Ordered, step, time: str, every: int) -> DataFrame:
    """A machine whose state is [time of the last publication, peak since then], over a cut stream: three passes."""
    keys = list(stream.keys)
    pieces = piece_numbers(stream)
    taken = _taken(_entries(stream, pieces, time, every), keys, every).select(*keys, PIECE, "_exit")
    along = Window.partitionBy(*keys).orderBy(PIECE)
    known = join_on(pieces, taken, [*keys, PIECE])
    known = materialise(known.withColumn("_last", F.last("_exit", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))))

    def state(peak) -> F.Column:
        return F.concat(F.lit("["), F.coalesce(F.col("_last").cast("string"), F.lit("null")), F.lit(","), peak, F.lit("]"))

    run = piece_states(stream, step, known.select(*stream.part, state(F.lit("0.0")).alias("_in")))
    tails = join_on(known, run.select(*stream.part, F.get_json_object("_out", "$[1]").cast("double").alias("_tail")), stream.part)
    # The peak goes on from the last piece with a publication; what lies before that one is out.
    tails = tails.withColumn("_since", F.count("_exit").over(along))
    highest = F.max("_tail").over(Window.partitionBy(*keys, "_since").orderBy(PIECE))
    tails = tails.withColumn("_high", highest).withColumn("_carry", F.lag("_high").over(along))
    states = materialise(tails.select(*stream.part, state(F.coalesce(F.col("_carry").cast("string"), F.lit("0.0"))).alias("_in")))
    return emit(join_on(stream.df, states, stream.part), stream.part, list(stream.by), step, step.columns).drop(CUT)


class AffineSteps:
    """For each row the map from the value before the piece: ``_a * value + _b``, and ``_u`` where there was none yet (0).

    ``amount`` gives a row's clipped number, or None where the row counts for nothing.
    """

    columns = {"_a": "double", "_b": "double", "_u": "double"}

    def __init__(self, amounts: Callable[[pd.DataFrame], list], weight: float) -> None:
        self.amounts, self.weight = amounts, weight

    def __call__(self, pdf: pd.DataFrame, state: object) -> tuple[dict[str, list], object]:
        a, b, u = state or (1.0, 0.0, 0.0)
        keep, out = 1 - self.weight, {name: [] for name in self.columns}
        for x in self.amounts(pdf):
            if x is not None:
                a, b, u = a * keep, b * keep + x * self.weight, x if u == 0 else u * keep + x * self.weight
            for name, value in zip(out, (a, b, u), strict=True):
                out[name].append(value)
        return out, [a, b, u]


class Compose:
    """Value before each piece, from the pieces' maps in order."""

    columns = {"_value": "double"}

    def __call__(self, pdf: pd.DataFrame, state: object) -> tuple[dict[str, list], object]:
        value, out = state or 0.0, []
        for a, b, u in zip(*(pdf[c].tolist() for c in AffineSteps.columns), strict=True):
            out.append(value)
            value = u if value == 0 else a * value + b
        return {"_value": out}, value


def across_affine(stream: Ordered, amounts: Callable[[pd.DataFrame], list], weight: float, name: str) -> DataFrame:
    """A smoothed value over a cut stream: one pass over the rows, one over a row for each piece."""
    step = AffineSteps(amounts, weight)
    rows = materialise(emit(stream.df, stream.part, list(stream.by), step, step.columns))
    last = F.max_by(F.struct(*step.columns), F.struct(*stream.by)).alias("_map")
    maps = join_on(rows.groupBy(*stream.part).agg(last), piece_numbers(stream), stream.part).select(*stream.part, PIECE, "_map.*")
    before = fold(maps, list(stream.keys), [PIECE], Compose(), Compose.columns, MAPS_A_TASK).select(*stream.part, "_value")
    found = join_on(rows, before, stream.part)
    value = F.when(F.col("_value") == 0, F.col("_u")).otherwise(F.col("_a") * F.col("_value") + F.col("_b"))
    return found.withColumn(name, value).drop(CUT, "_value", *step.columns)
