"""As-of joins as one ordered pass over the union of both sides: no theta join, no pair blow-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadencekit.operators.ordered import Running, ordered

EVIDENCE_MAX_AGE_NS = 500_000_000
ACTIVITY_TTL_NS = 1_250_000_000


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
         values: Sequence[str], tie: str | None = None, forward: bool = False,
         prefix: str = "asof_") -> DataFrame:
    """Each left row with the newest right row at or before its time (or the next one after).

    ``tie`` orders right rows of equal time: backward keeps the highest, forward the lowest.
    Times are numeric; right rows without a time never match, left rows without one match nothing.
    """
    payload = F.struct(F.lit(True).alias("_hit"), *[F.col(v).alias(f"{prefix}{v}") for v in values],
                       F.col(right_time).alias(f"{prefix}time"))
    rank = F.col(tie).cast("double") if tie else F.lit(0.0)
    kind = "double" if "double" in (dict(left.dtypes)[left_time], dict(right.dtypes)[right_time]) else "long"
    # Right rows stand before a left row of the same time; in forward order, after it.
    right_side = right.filter(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).cast(kind).alias("_t"),
        F.lit(1 if forward else 0).alias("_side"), rank.alias("_tie"), payload.alias("_right"))
    held = [c for c in left.columns if c not in keys]
    left_side = left.filter(F.col(left_time).isNotNull()).select(
        *keys, F.col(left_time).cast(kind).alias("_t"), F.lit(0 if forward else 1).alias("_side"),
        F.lit(0.0).alias("_tie"), F.struct(*held).alias("_left"))
    both = left_side.unionByName(right_side, allowMissingColumns=True)
    # Many left rows may share one instant, so a spread value lets a hot instant be cut.
    spread = F.shiftrightunsigned(F.xxhash64("_left"), 2)
    both = both.withColumn("_spread", F.when(F.col("_left").isNotNull(), spread).otherwise(0))
    s = ordered(both, keys, ["_t", "_side", "_tie", "_spread"])
    s = s.running(desc=forward, _found=Running("last", F.col("_right")))
    found = s.done().filter(F.col("_left").isNotNull())
    names = [*[f"{prefix}{v}" for v in values], f"{prefix}time"]
    out = found.select(*keys, "_left.*", *[F.col("_found")[n].alias(n) for n in names])
    blank = left.filter(F.col(left_time).isNull())
    out = out.unionByName(blank, allowMissingColumns=True)
    return out.select(*left.columns, *names)


def asof_evidence(df: DataFrame, evidence: DataFrame, max_age_ns: int = EVIDENCE_MAX_AGE_NS,
                  keys: Sequence[str] = ("stream_id", "epoch")) -> DataFrame:
    """Newest cadence evidence whose measurement ended at or before each sample.

    Evidence counts only when it is not from a later sample and not older than ``max_age_ns``.
    """
    out = asof(df, evidence, keys, "pts_ns", "end_ns", ["seq", "content_fps", "strict"], tie="seq",
               prefix="ev_")
    fresh = (F.col("ev_seq") <= F.col("seq")) & (F.col("pts_ns") - F.col("ev_time") <= max_age_ns)
    return (out.withColumn("evidence_fps", F.when(fresh, F.col("ev_content_fps")))
            .withColumn("evidence_strict", F.when(fresh, F.col("ev_strict")))
            .withColumn("evidence_end_ns", F.when(fresh, F.col("ev_time")))
            .drop("ev_seq", "ev_content_fps", "ev_strict", "ev_time"))


def active_at(df: DataFrame, activity: DataFrame, at: str, keys: Sequence[str], value: str,
              activity_time: str, ttl: int = ACTIVITY_TTL_NS, tie: str | None = None) -> DataFrame:
    """Activity value still in force at ``at``: last stated, not cleared, at most ``ttl`` old."""
    out = asof(df, activity, keys, at, activity_time, [value], tie=tie)
    live = F.col(at) - F.col("asof_time") <= ttl
    return (out.withColumn("active", F.when(live, F.col(f"asof_{value}")))
            .drop(f"asof_{value}", "asof_time"))


def running_claim(claims: DataFrame, reasons: DataFrame, keys: Sequence[str], said_at: str,
                  evidence_at: str, reason_at: str) -> DataFrame:
    """A claim holds unless a reason was stated after its evidence and before it was made."""
    out = asof(claims, reasons, keys, said_at, reason_at, [])
    holds = F.col(evidence_at).isNotNull() & (
        F.col("asof_time").isNull() | (F.col("asof_time") <= F.col(evidence_at)))
    return out.withColumn("running", holds).drop("asof_time")
