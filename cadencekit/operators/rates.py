"""Rates measured over trailing frames: delivered, content and strict content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadencekit.functions.rates import SAMPLING_RANGE
from cadencekit.operators.ordered import Ordered

# Sample counts and tolerances of the estimators.
MIN_INTERVALS = 8
INTERVAL_ROWS = 12
INTERVAL_TOLERANCE = 0.05
MIN_UPDATES = 4
MAX_AGE_NS = 250_000_000
WINDOW_NS = 1_000_000_000
GAP_TOLERANCE = 0.12
MIN_REPEATS = 2
REPEAT_SHARE = 0.5


def median_mean(values: Column) -> Column:
    """Median; the mean of the two middle values for an even count."""
    ranked, size = F.array_sort(values), F.size(values)
    half = F.floor(size / 2).cast("int")
    upper, lower = F.get(ranked, half), F.get(ranked, half - 1)
    return F.when(size % 2 == 0, (lower + upper) / 2).otherwise(upper)


def median_upper(values: Column) -> Column:
    """Median; the upper middle value for an even count."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def nearest_rank(values: Column, share: float = 0.95) -> Column:
    """Element ``floor(n * share)`` of the sorted values, never past the end."""
    size = F.size(values)
    index = F.least(size - 1, F.floor(size * F.lit(share)).cast("int"))
    return F.get(F.array_sort(values), index)


def _close(values: Column, centre: Column, tolerance: float) -> Column:
    return F.size(F.filter(values, lambda v: F.abs(v - centre) <= centre * tolerance))


def delivered_rate(s: Ordered, interval_s: str = "interval_s", rows: int = INTERVAL_ROWS,
                   within: Sequence[str] = (), out: str = "delivered_fps") -> Ordered:
    """Delivered rate from the last intervals, null while they are few or mixed."""
    s = s.trailing_rows(rows, within, _list=lambda w: F.collect_list(interval_s).over(w))
    values = F.col("_list")
    s = s.withColumn("_mid", median_mean(values))
    mid, size = F.col("_mid"), F.size(values)
    recent = F.slice(values, F.greatest(size - 3, F.lit(1)), F.lit(4))
    sound = F.forall(values, lambda v: ~F.isnan(v) & (v > 0) & (v < float("inf")))
    ok = ((size >= MIN_INTERVALS) & sound
          & (_close(values, mid, INTERVAL_TOLERANCE) * 4 >= size * 3)
          & (_close(recent, mid, INTERVAL_TOLERANCE) >= 3)
          & (1 / mid).between(*SAMPLING_RANGE))
    return s.withColumn(out, F.when(ok, 1 / mid)).drop("_list", "_mid")


def change_frames(s: Ordered, pts: str = "pts_ns", changed: str = "changed",
                  changed_exact: str = "changed_exact", within: Sequence[str] = (),
                  window_ns: int = WINDOW_NS) -> Ordered:
    """Counts and times of changes in the trailing window, for both kinds of change."""
    loose = F.when(F.col(changed), F.col(pts))
    exact = F.when(F.col(changed_exact), F.col(pts))
    repeat = F.when(~F.col(changed_exact), F.lit(1))
    return s.trailing_span(
        pts, window_ns, within,
        updates=lambda w: F.count(loose).over(w),
        first_change=lambda w: F.min(loose).over(w),
        last_change=lambda w: F.max(loose).over(w),
        exact_times=lambda w: F.collect_list(exact).over(w),
        repeats=lambda w: F.count(repeat).over(w),
        comparisons=lambda w: F.count(changed_exact).over(w),
    )


def content_rate(pts: str = "pts_ns", max_age_ns: int = MAX_AGE_NS) -> Column:
    """Content rate from ``change_frames``: needs four changes and a recent last one."""
    span = F.col("last_change") - F.col("first_change")
    recent = F.col(pts) - F.col("last_change") <= max_age_ns
    ok = recent & (F.col("updates") >= MIN_UPDATES) & (span > 0)
    return F.when(ok, (F.col("updates") - 1) * 1e9 / span)


def _gaps(times: Column) -> Column:
    count = F.greatest(F.size(times) - 1, F.lit(0))
    return F.zip_with(F.slice(times, 1, count), F.slice(times, 2, count), lambda a, b: b - a)


def with_strict_rate(s: Ordered, pts: str = "pts_ns", max_age_ns: int = MAX_AGE_NS) -> Ordered:
    """``strict_fps`` and ``repeat_proof`` from ``change_frames``: exact changes, evenly spaced."""
    s = s.withColumn("_times", F.array_sort("exact_times"))
    s = s.withColumn("_gaps", _gaps(F.col("_times"))).withColumn("_mid", median_upper(F.col("_gaps")))
    times, gaps, mid = F.col("_times"), F.col("_gaps"), F.col("_mid")
    count = F.size(times)
    first, last = F.get(times, F.lit(0)), F.get(times, count - 1)
    even = F.size(F.filter(gaps, lambda g: F.abs(g - mid) <= mid * GAP_TOLERANCE)) * 4 >= F.size(gaps) * 3
    ok = ((count >= MIN_UPDATES) & (last > first) & (F.col(pts) - last <= max_age_ns)
          & (mid > 0) & even)
    proof = ((F.col("repeats") >= MIN_REPEATS)
             & (F.col("repeats") >= F.col("comparisons") * REPEAT_SHARE))
    return (s.withColumn("strict_fps", F.when(ok, (count - 1) * 1e9 / (last - first)))
            .withColumn("strict_start_ns", F.when(ok, first))
            .withColumn("strict_end_ns", F.when(ok, last))
            .withColumn("strict_updates", count)
            .withColumn("repeat_proof", F.coalesce(ok & proof, F.lit(False)))
            .drop("_times", "_gaps", "_mid"))


def recent_median(s: Ordered, value: str, rows: int = 8, within: Sequence[str] = (),
                  out: str = "recent_median") -> Ordered:
    """Upper median of the last non-null values among ``rows`` rows."""
    s = s.trailing_rows(rows, within, _list=lambda w: F.collect_list(value).over(w))
    return s.withColumn(out, median_upper(F.col("_list"))).drop("_list")


def trailing_p95(s: Ordered, value: str, rows: int, index: str = "floor_n",
                 within: Sequence[str] = (), out: str = "p95") -> Ordered:
    """95th percentile of trailing rows; ``index`` is ``floor_n`` or ``floor_n_minus_1``."""
    s = s.trailing_rows(rows, within, _list=lambda w: F.collect_list(value).over(w))
    values, size = F.col("_list"), F.size("_list")
    if index == "floor_n":
        picked = nearest_rank(values)
    else:
        picked = F.get(F.array_sort(values), F.floor((size - 1) * F.lit(0.95)).cast("int"))
    return s.withColumn(out, F.coalesce(picked, F.lit(0.0))).drop("_list")
