"""Pairs of samples: adjacent, unique, with a proven period, and the timeline between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadencekit.functions.rates import (HIGH_SAMPLING, admitted_rate, choose_step, finite, fit_step,
                                        nominal_rate, phases, sampling_rate)
from cadencekit.operators.ordered import Ordered, Running
from cadencekit.operators.rates import median_upper

# Limits of a pair's period.
MAX_PERIOD_S = 0.1
TICK_TOLERANCE = 0.12
FREE_TICKS = 3
PERIOD_SLACK_S = 0.010
PERIOD_SLACK_SHARE = 0.25
RECENT_PAIRS = 8


def adjacent_pairs(s: Ordered) -> Ordered:
    """Rows whose immediate predecessor (sequence one lower) has the same epoch and size."""
    s = s.previous(prev_seq=F.col("seq"), prev_pts_ns=F.col("pts_ns"), prev_content=F.col("content"),
                   _epoch=F.col("epoch"), _w=F.col("width"), _h=F.col("height"))
    same = ((F.col("prev_seq") == F.col("seq") - 1) & (F.col("_epoch") == F.col("epoch"))
            & (F.col("_w") == F.col("width")) & (F.col("_h") == F.col("height")))
    return s.filter(same).drop("_epoch", "_w", "_h")


def unique_pairs(s: Ordered) -> Ordered:
    """Attach to each row the newest two consecutive distinct samples of its unbroken run.

    Needs ``run``, ``reason`` and ``changed_exact`` (as left by ``cadence``).  Both ends carry the
    sequence and time of the *first* copy of their content.
    """
    void = F.coalesce(F.col("reason").isin("invalid_timestamp", "unsupported_format"), F.lit(False))
    fresh = (F.col("reason").isNotNull() & ~void) | F.coalesce(F.col("changed_exact"), F.lit(False))
    end = F.struct("run", "seq", "pts_ns")
    s = s.withColumn("fresh", fresh)
    s = s.running(_before=Running("last", F.when(F.col("fresh"), end), inclusive=False))
    linked = F.col("_before.run") == F.col("run")
    pair = F.struct(
        F.col("run"), F.when(linked, F.col("_before.seq")).alias("prev_seq"),
        F.when(linked, F.col("_before.pts_ns")).alias("prev_pts_ns"),
        F.col("seq").alias("cur_seq"), F.col("pts_ns").alias("cur_pts_ns"))
    s = s.withColumn("_own", F.when(F.col("fresh"), pair))
    s = s.running(_pair=Running("last", F.col("_own")))
    known = ~void & (F.col("_pair.run") == F.col("run")) & F.col("_pair.prev_seq").isNotNull()
    names = ("prev_seq", "prev_pts_ns", "cur_seq", "cur_pts_ns")
    ends = {n: F.when(known, F.col("_pair")[n]) for n in names}
    return s.map(lambda df: df.withColumns(ends).drop("_before", "_own", "_pair"))


def pair_period(prev_s: Column, cur_s: Column, sampling: Column, evidence_fps: Column,
                evidence_end_s: Column, evidence_fresh: Column, strictly_unique: Column) -> Column:
    """Period of a pair in seconds, or null when its timing is not proven.

    Up to three ticks at up to 60.25 Hz the timestamps speak for themselves.  Anything longer or
    faster needs fresh evidence of the content rate, agreeing with the period, and unique ends.
    """
    prev_s, cur_s, sampling = finite(prev_s), finite(cur_s), sampling_rate(sampling)
    period = F.when(cur_s > prev_s, cur_s - prev_s)
    ticks = period / (1 / sampling)
    whole = F.round(ticks)
    on_tick = ((period <= MAX_PERIOD_S) & (whole >= 1)
               & (F.abs(ticks - whole) <= F.greatest(F.lit(TICK_TOLERANCE), whole * TICK_TOLERANCE)))
    free = (whole <= FREE_TICKS) & (sampling <= HIGH_SAMPLING)
    rate = nominal_rate(evidence_fps)
    expected = 1 / rate
    agrees = (F.coalesce(evidence_fresh, F.lit(False)) & (finite(evidence_end_s) <= cur_s)
              & (rate <= sampling + 0.5)
              & (F.abs(period - expected)
                 <= F.greatest(F.lit(PERIOD_SLACK_S), expected * PERIOD_SLACK_SHARE)))
    proven = F.coalesce(agrees & strictly_unique, F.lit(False))
    return F.when(F.coalesce(on_tick, F.lit(False)) & (free | proven), period)


def with_own_evidence(s: Ordered) -> Ordered:
    """Evidence from a row's own cadence: the tolerant rate, else a strict one with repeat proof."""
    tolerant = F.col("fps").isNotNull() & F.col("end_ns").isNotNull()
    strict = (F.col("state") == "unknown") & F.col("repeat_proof") & F.col("strict_fps").isNotNull()
    return (s.withColumn("evidence_fps", F.when(tolerant, F.col("fps")).when(strict, F.col("strict_fps")))
            .withColumn("evidence_end_ns",
                        F.when(tolerant, F.col("end_ns")).when(strict, F.col("strict_end_ns"))))


def admitted_pairs(s: Ordered, sampling: str = "delivered_fps") -> Ordered:
    """Rows that complete a unique pair with a proven period and an accepted content rate."""
    known = F.col("fresh") & F.col("prev_seq").isNotNull()
    s = s.filter(known).withColumn("period_s", pair_period(
        F.col("prev_pts_ns") / 1e9, F.col("cur_pts_ns") / 1e9, F.col(sampling), F.col("evidence_fps"),
        F.col("evidence_end_ns") / 1e9, F.col("evidence_fps").isNotNull(), F.lit(True)))
    rate = admitted_rate("period_s", sampling, F.lit(True), "evidence_fps")
    # A generated column is a fence: the filter below it is not pushed into the period expression,
    # which would copy that expression once per reference.
    kept = F.explode_outer(F.array(F.when(rate.isNotNull(), F.col("period_s"))))
    return s.withColumn("period_s", kept).filter(F.col("period_s").isNotNull())


def with_steps(s: Ordered, display: Column, target: Column) -> Ordered:
    """Step of each admitted pair from the recent median rate, cut to what its period holds."""
    s = s.trailing_rows(RECENT_PAIRS, _periods=lambda w: F.collect_list("period_s").over(w))
    # The last eight measured rates: pairs without one do not push older rates out.
    s = s.running(_nth=Running("count", F.col("evidence_fps")))
    s = s.trailing_span("_nth", RECENT_PAIRS, peers=False, _rates=lambda w: F.collect_list("evidence_fps").over(w))
    content = F.coalesce(median_upper(F.col("_rates")), 1 / median_upper(F.col("_periods")))
    s = s.withColumn("step_rate", content)
    step = fit_step(choose_step("step_rate", target, display), "period_s", display)
    return s.withColumn("step", step).drop("_periods", "_nth", "_rates")


def with_slots(s: Ordered) -> Ordered:
    """Phases of a pair and the length of one presentation slot."""
    s = s.withColumn("phases", phases("step"))
    return s.withColumn("slot_s", F.col("period_s") / (F.size("phases") + 1))
