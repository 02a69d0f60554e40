"""From samples to a timeline with synthesised rows between distinct samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadencekit.operators.continuity import with_interval
from cadencekit.operators.ordered import Ordered
from cadencekit.operators.pairing import (admitted_pairs, unique_pairs, with_own_evidence, with_slots,
                                          with_steps)
from cadencekit.operators.rates import delivered_rate
from cadencekit.plans.cadence import cadence

# Fixed value: wanted presentation rate.
TARGET_FPS = 60.0


def admitted(s: Ordered, content: str = "content", near: str | None = None) -> Ordered:
    """Cadence, unique pairs and delivered rate; then the pairs whose period is proven."""
    s = cadence(s, content, near)
    s = unique_pairs(s)
    s = with_interval(s)
    s = s.withColumn("interval_s", F.when(F.col("reason").isNull(), F.col("interval_ns") / 1e9))
    s = delivered_rate(s, within=["run"])
    return admitted_pairs(with_own_evidence(s))


def synthesise(s: Ordered, display: Column, target: Column | None = None, content: str = "content",
               near: str | None = None) -> DataFrame:
    """One row per presentation of each admitted pair: its phases, then its endpoint (phase 1)."""
    target = F.lit(TARGET_FPS) if target is None else target
    s = with_slots(with_steps(admitted(s, content, near), display, target))
    df = s.done()
    df = df.withColumn("phase", F.explode(F.concat("phases", F.array(F.lit(1.0)))))
    due = F.col("prev_pts_ns") + F.round(F.col("phase") * (F.col("cur_pts_ns") - F.col("prev_pts_ns")))
    return df.withColumn("generated", F.col("phase") < 1).withColumn("due_ns", due.cast("long"))


def interleave(source: DataFrame, generated: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Source and synthesised rows as one table, sorted by key and time inside each partition."""
    both = source.withColumn("generated", F.lit(False)).unionByName(generated.withColumn("generated", F.lit(True)))
    return both.repartitionByRange(*keys, time).sortWithinPartitions(*keys, time)
