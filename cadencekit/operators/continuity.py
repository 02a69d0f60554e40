"""Continuity of a stream: intervals, changes, epochs, breaks and coverage (all on ``Ordered``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadencekit.functions.sizes import supported_layout
from cadencekit.operators.ordered import Ordered, Running

# Fixed values, in nanoseconds.
SHORTEST_NS = 1_000_000_000 // 240
LONGEST_NS = 100_000_000
MAX_GAP_NS = 250_000_000
WINDOW_NS = 1_000_000_000
# Reasons, in order of precedence.
REASONS = ("invalid_timestamp", "warming_up", "epoch_changed", "sequence_gap",
           "unsupported_format", "layout_changed", "timestamp_discontinuity")


def with_interval(s: Ordered, pts: str = "pts_ns", out: str = "interval_ns") -> Ordered:
    """Time since the previous row; null on the first."""
    return (s.previous(_pts=F.col(pts)).withColumn(out, F.col(pts) - F.col("_pts")).drop("_pts"))


def with_change(s: Ordered, content: str = "content", near: str | None = None) -> Ordered:
    """``changed_exact`` and ``changed`` against the previous row; null on the first row.

    ``near`` names a coarser content column for the tolerant flag; exact equality implies it.
    """
    coarse = near or content
    s = s.previous(_row=F.lit(True), _exact=F.col(content), _near=F.col(coarse))
    differs = ~F.col(content).eqNullSafe(F.col("_exact"))
    loosely = differs & ~F.col(coarse).eqNullSafe(F.col("_near"))
    seen = F.col("_row").isNotNull()
    return (s.withColumn("changed_exact", F.when(seen, differs))
            .withColumn("changed", F.when(seen, loosely))
            .drop("_row", "_exact", "_near"))


def collapse_runs(s: Ordered, content: str = "content") -> Ordered:
    """Only the first copy of each run of equal content."""
    s = with_change(s, content)
    return s.filter(F.coalesce(F.col("changed_exact"), F.lit(True))).drop("changed", "changed_exact")


def with_epoch(s: Ordered, pts: str = "pts_ns", width: str = "width", height: str = "height",
               lo_ns: int = SHORTEST_NS, hi_ns: int = LONGEST_NS, out: str = "epoch") -> Ordered:
    """Running epoch number: a size change or an interval outside [lo, hi] starts a new one."""
    s = s.previous(_row=F.lit(True), _pts=F.col(pts), _w=F.col(width), _h=F.col(height))
    steady = ((F.col(width) == F.col("_w")) & (F.col(height) == F.col("_h"))
              & (F.col(pts) - F.col("_pts")).between(lo_ns, hi_ns))
    fresh = F.col("_row").isNotNull() & ~F.coalesce(steady, F.lit(False))
    s = s.withColumn("_new", fresh.cast("long"))
    return s.running(**{out: Running("sum", F.col("_new"))}).drop(
        "_row", "_pts", "_w", "_h", "_new")


def with_break_reason(s: Ordered, max_gap_ns: int = MAX_GAP_NS) -> Ordered:
    """Why a row starts afresh, null while the stream simply continues.

    Needs ``pts_ns`` (null = invalid), ``epoch``, ``seq``, ``width``, ``height``, ``pixel_format``
    and ``plane_count``.  The reason depends on the row and the one before it only: after an
    invalid or unsupported row there is no earlier content to compare with.
    """
    ok = supported_layout("pixel_format", "plane_count")
    layout = F.when(ok, F.struct("width", "height", "pixel_format", "plane_count"))
    s = s.withColumn("_layout", layout)
    usable = F.col("_layout").isNotNull() & F.col("pts_ns").isNotNull()
    s = s.previous(_row=F.lit(True), _epoch=F.col("epoch"), _seq=F.col("seq"),
                   _old=F.col("_layout"), _pts=F.when(usable, F.col("pts_ns")))
    step = F.col("pts_ns") - F.col("_pts")
    unsupported = F.col("_layout").isNull()

    def unless_unsupported(reason: str) -> Column:
        return F.when(unsupported, "unsupported_format").otherwise(reason)

    reason = (
        F.when(F.col("pts_ns").isNull(), "invalid_timestamp")
        .when(F.col("_row").isNull(), unless_unsupported("warming_up"))
        .when(F.col("_epoch") != F.col("epoch"), unless_unsupported("epoch_changed"))
        .when(F.col("seq") != F.col("_seq") + 1, unless_unsupported("sequence_gap"))
        .when(unsupported, "unsupported_format")
        .when(F.col("_old") != F.col("_layout"), "layout_changed")
        .when((step <= 0) | (step > max_gap_ns), "timestamp_discontinuity")
        .when(F.col("_pts").isNull(), "warming_up")
    )
    return s.withColumn("reason", reason).drop("_layout", "_row", "_epoch", "_seq", "_old", "_pts")


def with_coverage(s: Ordered, pts: str = "pts_ns") -> Ordered:
    """Number of the unbroken group (``run``) and time covered since it began.

    Rows whose own reason leaves nothing to measure (invalid or unsupported) cover nothing.
    """
    begins = F.col("reason").isNotNull()
    void = F.col("reason").isin("invalid_timestamp", "unsupported_format")
    s = s.running(
        run=Running("count", F.when(begins, F.lit(1))),
        _from=Running("last", F.when(begins, F.struct(F.col(pts).alias("t")))))
    covered = F.when(~F.coalesce(void, F.lit(False)), F.col(pts) - F.col("_from.t"))
    return s.withColumn("covered_ns", covered).drop("_from")


def strictly_increasing(s: Ordered, pts: str = "pts_ns") -> Ordered:
    """Rows later than everything before them in arrival order."""
    s = s.running(_top=Running("max", F.col(pts), inclusive=False))
    keep = F.col("_top").isNull() | (F.col(pts) > F.col("_top"))
    return s.filter(F.col(pts).isNotNull() & keep).drop("_top")
