"""Buffers bounded by media time, and admission of recorded samples, with every loss counted."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadencekit.functions.rates import finite_pos
from cadencekit.operators.asof import asof
from cadencekit.operators.folds import fold
from cadencekit.operators.ordered import Ordered, Running, join_on, ordered

# Buffer bounds and recording limits.
MAX_HELD_NS = 2_000_000_000
MAX_HELD_ROWS = 2048
IDLE_GAP_NS = 250_000_000
SLACK_NS = 1


def with_packet_duration(df: DataFrame, duration: str = "duration_s", n_samples: str = "n_samples",
                         sample_rate: str = "sample_rate") -> DataFrame:
    """Duration of a packet; a missing or non-positive one follows from its sample count."""
    derived = finite_pos(F.col(n_samples) / F.col(sample_rate))
    return df.withColumn(duration, F.coalesce(finite_pos(duration), derived))


def _bounded_valid(s: Ordered, pts: str, duration: str) -> Ordered:
    shaped = F.col(pts).isNotNull() & F.coalesce(F.col(duration) > 0, F.lit(False))
    s = s.running(_top=Running("max", F.when(shaped, F.col(pts)), inclusive=False))
    valid = shaped & (F.col("_top").isNull() | (F.col(pts) >= F.col("_top")))
    return s.withColumn("_valid", valid).drop("_top")


def bounded_buffer(s: Ordered, pts: str = "pts_ns", duration: str = "duration_ns",
                   max_ns: int = MAX_HELD_NS, max_rows: int = MAX_HELD_ROWS) -> Ordered:
    """Outcome of each put into a buffer nobody drains: ``kept``, ``evicted`` or ``rejected``.

    Eviction only removes a prefix and every limit grows towards the past, so a row survives
    exactly when the rows from it to the end respect all limits: frames run backwards.
    """
    s = _bounded_valid(s, pts, duration)
    when_valid = lambda c: F.when(F.col("_valid"), c)
    s = s.running(
        desc=True,
        _held=Running("sum", when_valid(F.col(duration))),
        _end=Running("max", when_valid(F.col(pts) + F.col(duration))),
        _count=Running("count", when_valid(F.lit(1))))
    fits = ((F.col("_held") <= max_ns + SLACK_NS) & (F.col("_end") - F.col(pts) <= max_ns + SLACK_NS)
            & (F.col("_count") <= max_rows))
    outcome = F.when(~F.col("_valid"), "rejected").when(fits, "kept").otherwise("evicted")
    return s.withColumn("outcome", outcome).drop("_valid", "_held", "_end", "_count")


def _missing(x: object) -> bool:
    return x is None or x != x


PACKET_COLUMNS = ("packet_no", "pts_ns", "duration_ns", "pull")


class DrainedBuffer:
    """Step of a bounded buffer; state is the queue and the last time.

    A row with ``pull`` takes that many packets, one with ``packet_no`` puts a packet, and any other
    row leaves the buffer as it is.  A packet shorter than ``least_ns`` is rejected; with zero, instants are held.
    The rows are a frame or arrays by name.
    """

    def __init__(self, max_ns: int = MAX_HELD_NS, max_rows: int = MAX_HELD_ROWS, least_ns: int = 1) -> None:
        self.max_ns, self.max_rows, self.least_ns = max_ns, max_rows, least_ns

    def __call__(self, pdf: pd.DataFrame | dict[str, np.ndarray], state: object) -> tuple[dict[str, list], object]:
        queue = deque(tuple(e) for e in state["queue"]) if state else deque()
        last = state["last"] if state else None
        held = sum(e[2] for e in queue)
        evicted, drained, pending = [], [], []
        columns = (pdf[c].tolist() for c in PACKET_COLUMNS)
        for number, pts, duration, pull in zip(*columns, strict=True):
            gone, taken = [], []
            if not _missing(pull):
                for _ in range(min(int(pull), len(queue))):
                    entry = queue.popleft()
                    held -= entry[2]
                    taken.append(entry[0])
            elif not _missing(number):
                bad = _missing(pts) or _missing(duration) or duration < self.least_ns
                if bad or (last is not None and pts < last):
                    gone.append(int(number))
                else:
                    last = int(pts)
                    queue.append((int(number), last, int(duration)))
                    held += int(duration)
                    end = last + int(duration)
                    while queue and (held > self.max_ns + SLACK_NS or len(queue) > self.max_rows
                                     or end - queue[0][1] > self.max_ns + SLACK_NS):
                        entry = queue.popleft()
                        held -= entry[2]
                        gone.append(entry[0])
            evicted.append(gone)
            drained.append(taken)
            pending.append(len(queue))
        out = {"evicted": evicted, "drained": drained, "pending": pending}
        return out, {"queue": [list(e) for e in queue], "last": last}


DRAIN_COLUMNS = {"evicted": "array<bigint>", "drained": "array<bigint>", "pending": "int"}


def buffer_with_drain(events: DataFrame, keys: Sequence[str], by: Sequence[str],
                      max_ns: int = MAX_HELD_NS, max_rows: int = MAX_HELD_ROWS, least_ns: int = 1) -> DataFrame:
    """Puts (``packet_no``, ``pts_ns``, ``duration_ns``) and pulls (``pull`` = how many).

    Each event row gets the packets it evicted (a rejected put names itself), those it drained, and
    how many stay pending.
    """
    return fold(events, keys, by, DrainedBuffer(max_ns, max_rows, least_ns), DRAIN_COLUMNS)


def admit_video(s: Ordered, ready: str | None = None) -> Ordered:
    """Reason why a video row is not recorded, null when it is.

    Needs ``pts_ns``, ``width``, ``height``, ``session_width`` and ``session_height``.  The first
    valid row sets the session start even if it is then dropped for its size.
    """
    valid = F.coalesce(F.col("pts_ns") >= 0, F.lit(False))
    s = s.running(start_ns=Running("first", F.when(valid, F.col("pts_ns"))))
    sized = F.coalesce((F.col("width") == F.col("session_width"))
                       & (F.col("height") == F.col("session_height")), F.lit(False))
    is_ready = F.col(ready) if ready else F.lit(True)
    candidate = valid & (F.col("pts_ns") >= F.col("start_ns")) & sized & is_ready
    s = s.running(_last=Running("max", F.when(candidate, F.col("pts_ns")), inclusive=False))
    why = (F.when(~valid, "invalid").when(F.col("pts_ns") <= F.col("_last"), "not_increasing")
           .when(F.col("pts_ns") < F.col("start_ns"), "before_start").when(~sized, "size")
           .when(~is_ready, "not_ready"))
    return s.withColumn("drop_reason", why).drop("_last")


def session_starts(video: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """First valid video time of each session, in arrival order."""
    order = F.when(F.col("pts_ns") >= 0, F.struct(*arrival))
    return video.groupBy(*keys).agg(F.min_by("pts_ns", order).alias("start_ns"))


def align_audio(packets: DataFrame, starts: DataFrame, keys: Sequence[str],
                by: Sequence[str]) -> DataFrame:
    """Outcome of each packet: ``preroll``, ``accepted``, ``dropped``, or ``pending`` without video."""
    s = ordered(join_on(packets, starts, keys), keys, by)
    inside = F.col("pts_ns") >= F.col("start_ns")
    s = s.running(_last=Running("max", F.when(inside, F.col("pts_ns")), inclusive=False))
    outcome = (F.when(F.col("start_ns").isNull(), "pending").when(~inside, "preroll")
               .when(F.col("pts_ns") <= F.col("_last"), "dropped").otherwise("accepted"))
    return s.withColumn("outcome", outcome).drop("_last", "start_ns").done()


def fill_idle_tail(df: DataFrame, stops: DataFrame, keys: Sequence[str], pts: str = "pts_ns",
                   gap_ns: int = IDLE_GAP_NS) -> DataFrame:
    """Repeat a primed session's last row at its stop time when it ended earlier than that."""
    rest = [c for c in df.columns if c not in (*keys, pts)]
    last = df.groupBy(*keys).agg(
        F.max(pts).alias("_last"), F.max_by(F.struct(*rest), F.col(pts)).alias("_row"))
    tails = (
        join_on(last, stops, keys, "inner")
        .filter(F.col("idle_primed") & (F.col("stop_ns") - F.col("_last") > gap_ns))
        .select(*keys, F.col("stop_ns").alias(pts), "_row.*", F.lit(True).alias("repeated"))
    )
    return df.withColumn("repeated", F.lit(False)).unionByName(tails)


def anchor_start(df: DataFrame, starts: DataFrame, keys: Sequence[str], pts: str = "pts_ns") -> DataFrame:
    """Open each session at its start clock with the newest row before it, as picture only."""
    rest = [c for c in df.columns if c not in (*keys, pts)]
    held = df.withColumn("_row", F.struct(*rest)).select(*keys, pts, "_row")
    found = asof(starts, held, keys, "start_ns", pts, ["_row"], prefix="c_")
    anchors = (
        found.filter(F.col("c__row").isNotNull() & (F.col("c_time") < F.col("start_ns")))
        .select(*keys, F.col("start_ns").alias(pts), "c__row.*", F.lit(True).alias("anchored"))
    )
    inside = join_on(df, starts, keys, "inner").filter(F.col(pts) >= F.col("start_ns"))
    return inside.select(*df.columns, F.lit(False).alias("anchored")).unionByName(anchors)
