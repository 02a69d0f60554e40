"""Ordered work per stream that stays parallel when one stream is huge.

A plain ``Window.partitionBy(stream)`` puts a whole stream into one task.  ``Ordered`` keeps that
plan for streams of ordinary size, because it needs only one exchange.  Streams above the session's
row limit are set apart and cut into consecutive ranges of the ordering columns; the cut is a path
of cell numbers in the ``_cut`` column, refined until every cell is within the limit.  Running
values then cross the cuts through a small table with one row per cell, and trailing frames through
copies ("halo") of the rows just before each cell.  Only the cut streams pay for this: the others
(``calm``) go through the same operators beside them and join them again in ``done``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencekit.session import hot_rows, materialise, surely_small

CUT = "_cut"
HALO = "_halo"
MAX_LEVELS = 64


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``sum``, ``count``, ``max``, ``min``, ``last`` or ``first``.

    ``last`` and ``first`` skip nulls.  ``inclusive=False`` leaves the current row out.
    """

    kind: str
    expr: Column
    inclusive: bool = True


_WITHIN = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(before + here, before, here)
    if kind == "max":
        return F.greatest(before, here)
    if kind == "min":
        return F.least(before, here)
    return F.coalesce(here, before) if kind == "last" else F.coalesce(before, here)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join that treats null keys as equal and keeps the left copy of the keys."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_r_{key}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    keys: tuple[str, ...]
    by: tuple[str, ...]
    cut: bool = False
    calm: Ordered | None = None

    @property
    def part(self) -> list[str]:
        return [*self.keys, CUT] if self.cut else list(self.keys)

    def window(self, *extra: str, desc: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if desc else F.col(c).asc() for c in self.by]
        return Window.partitionBy(*self.part, *extra).orderBy(*order)

    def _with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def _both(self, step: Callable[[Ordered], Ordered]) -> Ordered:
        """Apply a step to the cut streams and to the calm ones."""
        return replace(step(self), calm=step(self.calm) if self.calm is not None else None)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """Change the rows without touching keys, ordering columns or the cut."""
        return self._both(lambda s: s._with_df(change(s.df)))

    def select(self, *columns: Column | str) -> Ordered:
        """Keep the keys and the given columns, which must include the ordering columns."""
        return self._both(lambda s: s._with_df(s.df.select(*s.part, *columns)))

    def withColumn(self, name: str, expr: Column) -> Ordered:
        return self.map(lambda df: df.withColumn(name, expr))

    def filter(self, condition: Column) -> Ordered:
        return self.map(lambda df: df.filter(condition))

    def drop(self, *names: str) -> Ordered:
        return self.map(lambda df: df.drop(*names))

    def done(self) -> DataFrame:
        """The rows of all streams as one frame."""
        df = self.df.drop(CUT)
        return df if self.calm is None else df.unionByName(self.calm.done())

    def _pinned(self) -> Ordered:
        """Fix the rows before they are read twice, so that lineage never doubles."""
        return self._with_df(materialise(self.df)) if self.cut else self

    def running(self, desc: bool = False, **specs: Running) -> Ordered:
        """Running aggregates over all rows of the stream up to the current one."""
        return self._both(lambda s: s._running(desc, specs))

    def _running(self, desc: bool, specs: dict[str, Running]) -> Ordered:
        base = self._pinned()
        window = self.window(desc=desc)
        frames = {
            True: window.rowsBetween(Window.unboundedPreceding, 0),
            False: window.rowsBetween(Window.unboundedPreceding, -1),
        }
        here = base.df.withColumns(
            {n: _WITHIN[s.kind](s.expr).over(frames[s.inclusive]) for n, s in specs.items()}
        )
        if not self.cut:
            return self._with_df(here)
        order_key = F.struct(*self.by)
        totals = {}
        for name, spec in specs.items():
            seen = F.when(spec.expr.isNotNull(), order_key)
            if spec.kind in ("last", "first"):
                pick = F.max_by if (spec.kind == "last") != desc else F.min_by
                totals[name] = pick(spec.expr, seen)
            else:
                totals[name] = _WITHIN[spec.kind](spec.expr)
        cells = base.df.groupBy(*self.part).agg(*[e.alias(f"_t_{n}") for n, e in totals.items()])
        before = (
            Window.partitionBy(*self.keys)
            .orderBy(F.col(CUT).desc() if desc else F.col(CUT))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = cells.select(
            *self.part,
            *[_WITHIN["sum" if s.kind == "count" else s.kind](F.col(f"_t_{n}")).over(before)
              .alias(f"_c_{n}") for n, s in specs.items()],
        )
        joined = join_on(here, carry, self.part)
        joined = joined.withColumns(
            {n: _combine(s.kind, F.col(f"_c_{n}"), F.col(n)) for n, s in specs.items()}
        )
        return self._with_df(joined.drop(*[f"_c_{n}" for n in specs]))

    def previous(self, desc: bool = False, **exprs: Column) -> Ordered:
        """Values of the row just before the current one; null on the first row of a stream."""
        row = F.struct(*[e.alias(n) for n, e in exprs.items()])

        def step(s: Ordered) -> Ordered:
            if s.cut:
                return s._running(desc, {"_prev": Running("last", row, inclusive=False)})
            return s._with_df(s.df.withColumn("_prev", F.lag(row).over(s.window(desc=desc))))

        unpack = {n: F.col("_prev")[n] for n in exprs}
        return self._both(step).map(lambda df: df.withColumns(unpack).drop("_prev"))

    def number(self, name: str, desc: bool = False) -> Ordered:
        """1-based position of each row in its stream."""
        def step(s: Ordered) -> Ordered:
            if s.cut:
                return s._running(desc, {name: Running("count", F.lit(1))})
            return s._with_df(s.df.withColumn(name, F.row_number().over(s.window(desc=desc)).cast("long")))

        return self._both(step)

    def trailing_rows(self, rows: int, within: Sequence[str] = (),
                      **exprs: Callable[[WindowSpec], Column]) -> Ordered:
        """Frame expressions over the last ``rows`` rows, the current one included."""
        def step(s: Ordered) -> Ordered:
            base = s._with_row_halo(rows - 1) if s.cut else s
            return base._apply(base.window(*within).rowsBetween(-(rows - 1), 0), exprs)

        return self._both(step)

    def trailing_span(self, column: str, width: int, within: Sequence[str] = (), peers: bool = True,
                      **exprs: Callable[[WindowSpec], Column]) -> Ordered:
        """Frame expressions over rows with ``column`` in ``(current - width, current]``.

        ``column`` is an integer and must be the leading ordering column of the stream (or rise
        with it inside each ``within`` group).  As in any range frame, later rows of equal
        ``column`` count too; ``peers=False`` says that none of them matters, which spares copies.
        """
        def step(s: Ordered) -> Ordered:
            base = s._with_span_halo(column, width, within, peers) if s.cut else s
            frame = Window.partitionBy(*base.part, *within).orderBy(column).rangeBetween(-(width - 1), 0)
            return base._apply(frame, exprs)

        return self._both(step)

    def _apply(self, frame: WindowSpec, exprs: dict) -> Ordered:
        df = self.df.withColumns({n: make(frame) for n, make in exprs.items()})
        if self.cut:
            df = df.filter(~F.col(HALO)).drop(HALO)
        return self._with_df(df)

    def _with_row_halo(self, rows: int) -> Ordered:
        base = self._pinned()
        plain = base.df.withColumn(HALO, F.lit(False))
        if rows <= 0:
            return self._with_df(plain)
        cell_order = Window.partitionBy(*self.keys).orderBy(CUT)
        cells = (
            base.df.groupBy(*self.part).agg(F.count("*").alias("_cut_n"))
            .withColumn("_cut_end", F.sum("_cut_n").over(
                cell_order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_cut_next", F.collect_list(
                F.struct(F.col(CUT), (F.col("_cut_end") - F.col("_cut_n")).alias("begin"))
            ).over(cell_order.rowsBetween(1, rows)))
            .withColumn("_cut_next", F.filter("_cut_next", lambda x: x["begin"] - F.col("_cut_end") < rows))
            .select(*self.part, "_cut_end", F.explode("_cut_next").alias("_cut_to"))
        )
        tails = (
            base.df.withColumn("_cut_back", F.row_number().over(self.window(desc=True)))
            .filter(F.col("_cut_back") <= rows)
        )
        copies = (
            join_on(tails, cells, self.part, "inner")
            .filter(F.col("_cut_back") <= rows - (F.col("_cut_to.begin") - F.col("_cut_end")))
            .withColumn(CUT, F.col(f"_cut_to.{CUT}"))
            .withColumn(HALO, F.lit(True))
            .drop("_cut_back", "_cut_end", "_cut_to")
        )
        return self._with_df(plain.unionByName(copies))

    def _with_span_halo(self, column: str, width: int, within: Sequence[str], peers: bool) -> Ordered:
        base = self._pinned()
        plain = base.df.withColumn(HALO, F.lit(False))
        group = [*self.part, *within]
        cells = base.df.filter(F.col(column).isNotNull()).groupBy(*group).agg(
            F.min(column).alias("_cut_lo"), F.max(column).alias("_cut_hi"))
        # Each cell asks, at its first time, which earlier cells end inside the trailing span.
        ends = cells.select(*group, F.col("_cut_hi").alias("_cut_x"), F.col(CUT).alias("_cut_from"))
        starts = cells.select(
            *group, F.col("_cut_lo").alias("_cut_x"),
            F.lit(None).cast(T.ArrayType(T.LongType())).alias("_cut_from"))
        reach = (Window.partitionBy(*self.keys, *within).orderBy("_cut_x")
                 .rangeBetween(-(width - 1), 0))
        links = (
            ends.unionByName(starts)
            .withColumn("_cut_cells", F.collect_list("_cut_from").over(reach))
            .filter(F.col("_cut_from").isNull())
            .select(*self.keys, *within, F.col(CUT).alias("_cut_to"), F.col("_cut_x").alias("_cut_first"),
                    F.explode("_cut_cells").alias(CUT))
            .filter(F.col(CUT) < F.col("_cut_to"))
            .withColumn("_cut_top", F.col("_cut_first"))
        )
        if peers:
            # A cell also needs the rows of later cells that share its last time.
            last = cells.select(*self.keys, *within, F.col(CUT).alias("_cut_to"), F.col("_cut_hi").alias("_cut_lo"))
            ahead = (
                join_on(cells, last, [*self.keys, *within, "_cut_lo"], "inner")
                .filter(F.col(CUT) > F.col("_cut_to"))
                .select(*self.keys, *within, "_cut_to", F.lit(None).cast("long").alias("_cut_first"), CUT,
                        F.col("_cut_lo").alias("_cut_top"))
            )
            links = links.unionByName(ahead)
        before = (F.col(column) > F.col("_cut_first") - width) & (F.col(column) <= F.col("_cut_first"))
        tied = F.col("_cut_first").isNull() & (F.col(column) == F.col("_cut_top"))
        copies = (
            join_on(base.df, links, group, "inner")
            .filter(before | tied)
            .withColumn(CUT, F.col("_cut_to"))
            .withColumn(HALO, F.lit(True))
            .drop("_cut_to", "_cut_first", "_cut_top")
        )
        return self._with_df(plain.unionByName(copies))


def ordered(df: DataFrame, keys: Sequence[str], by: Sequence[str],
            limit: int | None = None) -> Ordered:
    """Prepare ``df`` for ordered work, cutting any stream above the row limit.

    ``by`` are numeric, non-null columns that order a stream; together they should be unique in it.
    """
    keys, by = tuple(keys), tuple(by)
    if limit is None and surely_small(df):
        return Ordered(df, keys, by)
    limit = limit or hot_rows(df.sparkSession)
    large = materialise(_measure(df, keys, by).filter(F.col("_cut_n") > limit).select(*keys))
    if large.isEmpty():
        return Ordered(df, keys, by)
    # Each large key has more than `limit` rows, so there are at most rows/limit of them.
    calm = Ordered(join_on(df, large, keys, "left_anti"), keys, by)
    df = materialise(join_on(df, large, keys, "left_semi"))
    df = df.withColumn(CUT, F.array().cast(T.ArrayType(T.LongType())))
    path = [*keys, CUT]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for _ in range(MAX_LEVELS):
        # A hot cell holds more than `limit` rows, so this table has at most rows/limit entries.
        cells = materialise(_measure(df, path, by).filter(F.col("_cut_n") > limit)
                            .filter(_splittable(by)))
        if cells.isEmpty():
            break
        pieces = F.ceil(F.col("_cut_n") * 2 / F.lit(limit)) + 1
        cell = F.lit(None).cast("long")
        for i, column in reversed(list(enumerate(by))):
            lo, hi = F.col(f"_cut_lo{i}"), F.col(f"_cut_hi{i}")
            odd = F.col(f"_cut_odd{i}")
            if isinstance(kinds[column], (T.DoubleType, T.FloatType)):
                # Halves, because the whole width of two finite numbers may be infinite.
                inside = F.floor((F.col(column) / 2 - lo / 2) / ((hi / 2 - lo / 2) / pieces))
                index = (F.when(F.isnan(column), pieces + 2).when(F.col(column) == float("inf"), pieces + 1)
                         .when(F.col(column) == float("-inf"), -1).when(lo < hi, inside).otherwise(0))
            else:
                step = F.floor((hi - lo) / pieces) + 1
                index = F.floor((F.col(column).cast("long") - lo) / step)
            cell = F.when((lo < hi) | ((odd > 0) & (odd < F.col("_cut_n"))) | (F.col(f"_cut_odds{i}") > 1),
                          index.cast("long")).otherwise(cell)
        df = (
            join_on(df, cells, path)
            .withColumn(CUT, F.when(F.col("_cut_n").isNull(), F.col(CUT))
                        .otherwise(F.concat(CUT, F.array(cell))))
            .drop("_cut_n", *[f"_cut_{e}{i}" for i in range(len(by)) for e in ("lo", "hi", "odd", "odds")])
        )
    else:
        raise ValueError(f"a stream could not be cut to {limit} rows in {MAX_LEVELS} levels of {by}")
    return Ordered(df, keys, by, cut=True, calm=calm)


def _measure(df: DataFrame, group: Sequence[str], by: Sequence[str]) -> DataFrame:
    bounds = []
    for i, column in enumerate(by):
        finite, odd = F.col(column), F.lit(False)
        if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
            odd = F.isnan(column) | (F.abs(column) == float("inf"))
            finite = F.when(~odd, F.col(column))
        bounds += [F.min(finite).alias(f"_cut_lo{i}"), F.max(finite).alias(f"_cut_hi{i}"), F.count_if(odd).alias(f"_cut_odd{i}"),
                   F.count_distinct(F.when(odd, F.col(column).cast("string"))).alias(f"_cut_odds{i}")]
    return df.groupBy(*group).agg(F.count("*").alias("_cut_n"), *bounds)


def _splittable(by: Sequence[str]) -> Column:
    spread = F.lit(False)
    for i in range(len(by)):
        odd = F.col(f"_cut_odd{i}")
        spread = spread | F.coalesce(F.col(f"_cut_lo{i}") < F.col(f"_cut_hi{i}"), F.lit(False))
        spread = spread | ((odd > 0) & (odd < F.col("_cut_n"))) | (F.col(f"_cut_odds{i}") > 1)
    return spread
