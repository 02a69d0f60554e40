"""Cadence state of every sample: breaks, coverage and both content rates in one ordered pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadencekit.operators.continuity import (MAX_GAP_NS, with_break_reason, with_change,
                                             with_coverage)
from cadencekit.operators.ordered import Ordered
from cadencekit.operators.rates import (MAX_AGE_NS, MIN_UPDATES, WINDOW_NS, change_frames,
                                        content_rate, with_strict_rate)


def cadence(s: Ordered, content: str = "content", near: str | None = None,
            window_ns: int = WINDOW_NS, max_gap_ns: int = MAX_GAP_NS,
            max_age_ns: int = MAX_AGE_NS) -> Ordered:
    """Add ``state`` (``estimated`` or ``unknown``), ``state_reason``, ``fps`` and the evidence.

    Input as for ``with_break_reason``, plus the content columns.  ``with_staleness`` ages it.
    """
    s = with_coverage(with_break_reason(s, max_gap_ns))
    s = with_change(s, content, near)
    carries_on = F.col("reason").isNull()
    s = (s.withColumn("changed", F.when(carries_on, F.col("changed")))
         .withColumn("changed_exact", F.when(carries_on, F.col("changed_exact"))))
    s = change_frames(s, within=["run"], window_ns=window_ns)
    s = with_strict_rate(s, max_age_ns=max_age_ns)
    warm = carries_on & (F.col("covered_ns") >= window_ns)
    rate = content_rate(max_age_ns=max_age_ns)
    span = F.col("last_change") - F.col("first_change")
    old = F.col("pts_ns") - F.col("last_change") > max_age_ns
    why = (
        F.when(~carries_on, F.col("reason"))
        .when(~warm, "warming_up")
        .when((F.col("updates") == 0) | old, "static_content")
        .when((F.col("updates") < MIN_UPDATES) | (span <= 0), "insufficient_changes")
    )
    blank = {c: F.when(warm, F.col(c)) for c in ("strict_fps", "strict_start_ns", "strict_end_ns")}
    counts = {c: F.when(warm, F.col(c)).otherwise(0) for c in ("updates", "strict_updates", "repeats")}
    measured = warm & (F.col("updates") >= 2)
    s = s.withColumn("state_reason", why).withColumn("fps", F.when(warm, rate))
    final = {
        "state": F.when(F.col("state_reason").isNull(), "estimated").otherwise("unknown"),
        "start_ns": F.when(measured, F.col("first_change")),
        "end_ns": F.when(measured, F.col("last_change")),
        "repeat_proof": warm & F.col("repeat_proof"),
        **blank, **counts,
    }
    spent = ("first_change", "last_change", "exact_times", "comparisons")
    return s.map(lambda df: df.withColumns(final).drop(*spent))
