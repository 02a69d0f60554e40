"""Column helpers for rates: guards, ranges, snapping and step choice.

An invalid input gives null (or false for a predicate), never an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard content rates, in natural order.
STANDARD_RATES = (20.0, 23.976, 24.0, 25.0, 29.97, 30.0, 40.0, 45.0, 48.0, 50.0, 59.94, 60.0)
# Points at which an advertised rate range is sampled.
ADVERTISED_POINTS = (20.0, 24.0, 25.0, 29.97, 30.0, 40.0, 45.0, 48.0, 50.0, 59.94, 60.0, 90.0,
                     100.0, 120.0, 144.0)
# Bounds and tolerances.
SAMPLING_RANGE = (10.0, 240.0)
CONTENT_RANGE = (19.5, 60.25)
CONTENT_MAX = 60.0
RATE_TOLERANCE = 0.01
HIGH_SAMPLING = 60.25
LOW_RATE = 25.0
MAX_STEP = 3


def _col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def finite(c: Column | str) -> Column:
    """The value, or null for NaN and both infinities (NaN sorts above infinity)."""
    c = _col(c).cast("double")
    return F.when(F.abs(c) < float("inf"), c)


def finite_pos(c: Column | str) -> Column:
    """The value when it is finite and above zero, else null."""
    c = _col(c).cast("double")
    return F.when((c > 0) & (c < float("inf")), c)


def finite_nonneg(c: Column | str) -> Column:
    c = _col(c).cast("double")
    return F.when((c >= 0) & (c < float("inf")), c)


def sampling_rate(c: Column | str) -> Column:
    """A delivered rate inside the accepted sampling range, else null."""
    c = _col(c).cast("double")
    return F.when((c >= SAMPLING_RANGE[0]) & (c <= SAMPLING_RANGE[1]), c)


def nominal_rate(c: Column | str) -> Column:
    """A content rate inside the accepted range, capped at 60, else null."""
    c = _col(c).cast("double")
    return F.when((c >= CONTENT_RANGE[0]) & (c <= CONTENT_RANGE[1]), F.least(c, F.lit(CONTENT_MAX)))


def bounded_rate(rate: Column | str, signal: Column | str) -> Column:
    """Content cannot change faster than it is delivered; an unknown signal leaves the rate."""
    rate = finite_pos(rate)
    return F.when(rate.isNotNull(), F.least(rate, finite_pos(signal)))


def snap_rate(rate: Column | str, standards: Sequence[float] = STANDARD_RATES) -> Column:
    """Nearest standard rate within ``max(0.15, 1.5 %)``, else the rate itself."""
    rate = finite_pos(rate)
    points = sorted(standards)
    nearest = F.lit(points[-1])
    for low, high in reversed(list(pairwise(points))):
        nearest = F.when(rate <= (low + high) / 2, low).otherwise(nearest)
    near = F.abs(nearest - rate) <= F.greatest(F.lit(0.15), rate * 0.015)
    return F.when(near, nearest).otherwise(rate)


def clamp_refresh(c: Column | str) -> Column:
    """Display refresh in [30, 240]; a missing or non-positive one counts as 60."""
    c = _col(c)
    return F.least(F.lit(240), F.greatest(F.lit(30), F.when(c > 0, c).otherwise(F.lit(60))))


def follow_ok(content: Column | str, target: Column | str) -> Column:
    """A follow target must not lie below the content rate (tolerance 0.01)."""
    content, target = finite_pos(content), finite_pos(target)
    return F.coalesce(target >= content - RATE_TOLERANCE, F.lit(False))


def prefer_adjacent(rate: Column | str, signal: Column | str, fresh: Column | str,
                    differs: Column | str) -> Column:
    """Content runs at the delivered rate: pair neighbouring samples directly."""
    rate, signal = finite_pos(rate), finite_pos(signal)
    close = F.abs(rate - signal) <= F.greatest(F.lit(1.5), signal * 0.05)
    return F.coalesce(_col(fresh) & _col(differs) & close, F.lit(False))


def choose_step(content: Column | str, target: Column | str, display: Column | str) -> Column:
    """Temporal multiplier (1, 2 or 3) that lifts content to the target on this display."""
    content, display = finite_pos(content), finite_pos(display)
    goal = F.least(F.coalesce(finite_pos(target), F.lit(60.0)), display) - 0.5
    room = display + 0.5
    double, triple = content * 2, content * 3
    return (
        F.when(content.isNull() | display.isNull(), 1)
        .when((double >= goal) & (double <= room), 2)
        .when((triple >= goal) & (triple <= room) & (content < LOW_RATE), 3)
        .when(double <= room, 2)
        .otherwise(1)
    )


def fit_step(step: Column | str, period: Column | str, display: Column | str) -> Column:
    """Largest step not above ``step`` whose presentations fit in one pair period."""
    step, period, display = finite(step), finite_pos(period), finite_pos(display)
    stated = F.when(step >= 1, F.round(step))
    capacity = display * period + 0.02
    fits = F.least(stated, F.lit(float(MAX_STEP)), F.floor(capacity).cast("double"))
    valid = stated.isNotNull() & capacity.isNotNull()
    return F.when(valid & (fits >= 2), fits.cast("int")).otherwise(1)


def phases(step: Column | str) -> Column:
    """Inner phases ``i / step`` of a pair, in order; empty unless the step is 2 or 3."""
    step = finite(step)
    lists = {n: F.array(*[F.lit(i / n) for i in range(1, n)]) for n in range(2, MAX_STEP + 1)}
    found = F.array().cast("array<double>")
    for n, inner in lists.items():
        # A step above the maximum counts for nothing, not even by rounding.
        found = F.when((F.abs(step - n) < 0.001) & step.between(2, MAX_STEP), inner).otherwise(found)
    return found


def eligible(rate: Column | str, display: Column | str, valid: Column | str,
             step: Column | str = 2, supported: Column | bool = True) -> Column:
    """``step`` presentations of the nominal rate fit the display, and the input is valid."""
    nominal, display, step = nominal_rate(rate), finite_pos(display), finite(step)
    supported = supported if isinstance(supported, Column) else F.lit(supported)
    fits = step.between(1, MAX_STEP) & (step * nominal <= display + 0.5)
    return F.coalesce(supported & _col(valid) & fits, F.lit(False))


def admitted_rate(period: Column | str, sampling: Column | str, unique: Column | str,
                  measured: Column | str) -> Column:
    """Content rate of a real pair: its own timing when unique, else the sampling signal."""
    period, sampling = finite_pos(period), sampling_rate(sampling)
    rate = F.when(_col(unique), F.coalesce(_col(measured), 1 / period)).otherwise(sampling)
    return F.when(period.isNotNull() & sampling.isNotNull(), nominal_rate(rate))


def rate_label(c: Column | str) -> Column:
    """A whole rate without decimals, any other with two."""
    c = _col(c)
    return F.when(c == F.round(c), F.format_string("%.0f", c)).otherwise(F.format_string("%.2f", c))


def bitrate(width: Column | str, height: Column | str, fps: Column | str) -> Column:
    """Encoder bit rate estimate in bit/s."""
    area = _col(width).cast("double") * _col(height)
    return F.greatest(F.lit(8e6), area * F.greatest(F.lit(30.0), _col(fps).cast("double")) * 0.15)


def advertised_points(lo: Column | str, hi: Column | str) -> Column:
    """Rates offered for one range: standard points inside it and both ends, to two decimals."""
    lo, hi = _col(lo).cast("double"), _col(hi).cast("double")
    inside = F.filter(F.array(*[F.lit(p) for p in ADVERTISED_POINTS]),
                      lambda p: (p >= lo) & (p <= hi))
    wide = F.concat(inside, F.array(lo, hi))
    points = F.when(F.abs(lo - hi) < 0.01, F.array(hi)).otherwise(wide)
    return F.array_distinct(F.transform(points, lambda p: F.round(p * 100) / 100))


def partial_phases(planned: Column | str, made: Column | str) -> Column:
    """What is left of a pair when only the first ``made`` phases were produced, and its step."""
    planned, made = _col(planned), _col(made)
    kept = F.slice(planned, F.lit(1), F.greatest(F.least(made, F.size(planned)), F.lit(0)))
    return F.struct(kept.alias("phases"), (F.size(kept) + 1).alias("step"))
