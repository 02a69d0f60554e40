"""Checks of the ordered operators: intervals, changes, epochs, breaks, rates and cadence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadencekit.checks.base import EVENTS_SQL, SAMPLES_SQL, Check, event_stream, r6, samples
from cadencekit.operators import continuity as C
from cadencekit.operators import rates as R
from cadencekit.operators.payload import compared_attrs
from cadencekit.plans.cadence import cadence

W = "PARTITION BY stream_id ORDER BY us, event_id"


def content_rate_per_stream(spark, sf_dir):
    """Flagship: changes of content per stream, and their rate per day."""
    s = event_stream(spark, sf_dir)
    runs = C.collapse_runs(s, "event_type").done()
    span = F.max("us") - F.min("us")
    return runs.groupBy("stream_id").agg(
        F.count("*").alias("changes"),
        r6((F.count("*") - 1) * 86_400_000_000.0 / span).alias("changes_per_day"))


def sample_interval(spark, sf_dir):
    s = C.with_interval(event_stream(spark, sf_dir), "us", "interval_us")
    return s.done().select("event_id", "interval_us")


def change_flags(spark, sf_dir):
    s = C.with_change(samples(spark, sf_dir), "content", "near")
    return s.done().select("event_id", "changed", "changed_exact")


def run_collapse(spark, sf_dir):
    s = C.collapse_runs(samples(spark, sf_dir), "content")
    return s.done().select("stream_id", "event_id", "seq", "content")


def epoch_numbers(spark, sf_dir):
    s = C.with_epoch(samples(spark, sf_dir), out="cut_epoch")
    return s.done().select("event_id", "cut_epoch")


def break_reasons(spark, sf_dir):
    s = C.with_break_reason(samples(spark, sf_dir))
    return s.done().select("event_id", "reason")


def coverage(spark, sf_dir):
    s = C.with_coverage(C.with_break_reason(samples(spark, sf_dir)))
    return s.done().select("event_id", "run", "covered_ns",
                           F.coalesce(F.col("covered_ns") >= C.WINDOW_NS, F.lit(False)).alias("warm"))


REASON_SQL = SAMPLES_SQL + """,
laid AS (
  SELECT *, (pixel_format = '420v' OR pixel_format = '420f') AND plane_count = 2
            OR pixel_format = 'BGRA' AND plane_count = 0 AS ok
  FROM samples),
before AS (
  SELECT *, lag(epoch) OVER w AS p_epoch, lag(seq) OVER w AS p_seq,
         lag(CASE WHEN ok THEN width || 'x' || height || pixel_format END) OVER w AS p_layout,
         lag(CASE WHEN ok THEN pts_ns END) OVER w AS p_pts, row_number() OVER w = 1 AS first_row
  FROM laid WINDOW w AS (PARTITION BY stream_id ORDER BY us, event_id)),
reasoned AS (
  SELECT *, CASE
    WHEN pts_ns IS NULL THEN 'invalid_timestamp'
    WHEN NOT ok THEN 'unsupported_format'
    WHEN first_row THEN 'warming_up'
    WHEN epoch <> p_epoch THEN 'epoch_changed'
    WHEN seq <> p_seq + 1 THEN 'sequence_gap'
    WHEN p_layout <> width || 'x' || height || pixel_format THEN 'layout_changed'
    WHEN pts_ns - p_pts <= 0 OR pts_ns - p_pts > 250000000 THEN 'timestamp_discontinuity'
    WHEN p_pts IS NULL THEN 'warming_up' END AS reason
  FROM before),
covered AS (
  SELECT *, CASE WHEN reason IS NULL OR reason NOT IN ('invalid_timestamp', 'unsupported_format')
                 THEN pts_ns - first_value(pts_ns) OVER (PARTITION BY stream_id, run ORDER BY us, event_id)
            END AS covered_ns
  FROM (SELECT *, count(reason) OVER (PARTITION BY stream_id ORDER BY us, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM reasoned))
"""

CADENCE_SQL = REASON_SQL + """,
compared AS (
  SELECT *, CASE WHEN reason IS NULL THEN near <> lag(near) OVER w END AS changed,
         CASE WHEN reason IS NULL THEN content <> lag(content) OVER w END AS changed_exact
  FROM covered WINDOW w AS (PARTITION BY stream_id ORDER BY us, event_id)),
framed AS (
  SELECT *, count(*) FILTER (WHERE changed) OVER f AS updates,
         min(pts_ns) FILTER (WHERE changed) OVER f AS first_change,
         max(pts_ns) FILTER (WHERE changed) OVER f AS last_change,
         list_sort(list(pts_ns) FILTER (WHERE changed_exact) OVER f) AS times,
         count(*) FILTER (WHERE NOT changed_exact) OVER f AS repeats,
         count(changed_exact) OVER f AS comparisons
  FROM compared
  WINDOW f AS (PARTITION BY stream_id, run ORDER BY pts_ns
               RANGE BETWEEN 999999999 PRECEDING AND CURRENT ROW)),
gapped AS (
  SELECT *, [times[i + 1] - times[i] FOR i IN range(1, len(times))] AS gaps FROM framed),
middle AS (SELECT *, list_sort(gaps)[len(gaps) // 2 + 1] AS mid FROM gapped),
judged AS (
  SELECT *, coalesce(len(times) >= 4 AND times[-1] > times[1] AND pts_ns - times[-1] <= 250000000
              AND mid > 0 AND len([g FOR g IN gaps IF abs(g - mid) <= mid * 0.12]) * 4 >= len(gaps) * 3,
              FALSE) AS strict_ok,
         coalesce(reason IS NULL AND covered_ns >= 1000000000, FALSE) AS warm
  FROM middle),
states AS (
  SELECT *, CASE
    WHEN reason IS NOT NULL THEN reason
    WHEN NOT warm THEN 'warming_up'
    WHEN updates = 0 OR pts_ns - last_change > 250000000 THEN 'static_content'
    WHEN updates < 4 OR last_change <= first_change THEN 'insufficient_changes' END AS state_reason
  FROM judged)
"""


def content_rate_window(spark, sf_dir):
    s = C.with_change(samples(spark, sf_dir), "content", "near")
    s = s.withColumn("pts_ns", F.col("raw_ns"))
    s = R.change_frames(s)
    return s.done().select("event_id", "updates", "first_change", "last_change",
                           r6(R.content_rate()).alias("content_fps"))


def strict_rate_window(spark, sf_dir):
    s = C.with_change(samples(spark, sf_dir), "content", "near")
    s = s.withColumn("pts_ns", F.col("raw_ns"))
    s = R.with_strict_rate(R.change_frames(s))
    return s.done().select("event_id", r6("strict_fps").alias("strict_fps"), "strict_start_ns",
                           "strict_end_ns", F.col("strict_updates").cast("long").alias("strict_updates"),
                           "repeat_proof")


FLAT_SQL = SAMPLES_SQL + """,
covered AS (SELECT * REPLACE (raw_ns AS pts_ns), CAST(NULL AS VARCHAR) AS reason, 0 AS run,
            1000000000 AS covered_ns FROM samples)
"""
FLAT_FRAMES_SQL = FLAT_SQL + CADENCE_SQL[len(REASON_SQL):]


def delivered_rates(spark, sf_dir):
    s = C.with_epoch(samples(spark, sf_dir), "raw_ns", out="cut_epoch")
    s = s.withColumn("pts_ns", F.col("raw_ns"))
    s = C.with_interval(s)
    s = s.previous(_e=F.col("cut_epoch"))
    same = F.col("_e") == F.col("cut_epoch")
    s = s.withColumn("interval_s", F.when(same, F.col("interval_ns") / 1e9))
    s = R.delivered_rate(s, within=["cut_epoch"])
    return s.done().select("event_id", r6("delivered_fps").alias("delivered_fps"))


EPOCH_SQL = SAMPLES_SQL + """,
stepped AS (
  SELECT *, lag(width) OVER w = width AND raw_ns - lag(raw_ns) OVER w BETWEEN 4166666 AND 100000000 AS steady,
         row_number() OVER w > 1 AS later, raw_ns - lag(raw_ns) OVER w AS raw_step
  FROM samples WINDOW w AS (PARTITION BY stream_id ORDER BY us, event_id)),
epoched AS (
  SELECT *, CAST(sum(CASE WHEN later AND NOT coalesce(steady, FALSE) THEN 1 ELSE 0 END) OVER (
           PARTITION BY stream_id ORDER BY us, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cut_epoch FROM stepped)
"""


def cadence_state(spark, sf_dir):
    s = cadence(samples(spark, sf_dir), "content", "near")
    return s.done().select(
        "event_id", "state", "state_reason", r6("fps").alias("fps"), "start_ns", "end_ns", "updates",
        r6("strict_fps").alias("strict_fps"), "repeat_proof", F.col("repeats"))


def trailing_counts(spark, sf_dir):
    """Time frame of one second and row frames of 4, 8, 12, 32 and 120 rows."""
    s = samples(spark, sf_dir)
    s = s.trailing_span("raw_ns", C.WINDOW_NS, n_second=lambda w: F.count("*").over(w))
    for rows in (4, 8, 12, 32, 120):
        s = s.trailing_rows(rows, **{f"max_{rows}": lambda w: F.max("value").over(w)})
    return s.done().select("event_id", "n_second", *[f"max_{r}" for r in (4, 8, 12, 32, 120)])


def recent_rate_median(spark, sf_dir):
    s = R.recent_median(event_stream(spark, sf_dir), "value", 8)
    return s.done().select("event_id", "recent_median")


def increasing_rows(spark, sf_dir):
    s = event_stream(spark, sf_dir).withColumn("stamp", (F.col("us") / 1000000 + F.col("k") * 3600).cast("long"))
    return C.strictly_increasing(s, "stamp").done().select("stream_id", "event_id", "stamp")


def reason_histogram(spark, sf_dir):
    s = cadence(samples(spark, sf_dir), "content", "near").done()
    return s.groupBy(F.coalesce("state_reason", F.lit("estimated")).alias("reason")).count()


def attribute_changes(spark, d):
    """Attributes of each event against those of the one before: one that matters may be missing or null, others don't count."""
    known = F.create_map(F.lit("matrix"), F.when(F.col("k") % 5 != 1, F.col("event_type")), F.lit("orientation"), (F.col("k") % 2).cast("string"),
                         F.lit("comment"), F.col("event_id").cast("string"))
    attrs = F.when(F.col("k") % 5 == 0, F.map_filter(known, lambda name, _: name != "matrix")).otherwise(known)
    s = event_stream(spark, d).withColumn("now", compared_attrs(attrs)).previous(before=F.col("now"))
    return s.done().select("event_id", (F.col("now") == F.col("before")).alias("same"))


CHECKS = {
    "f5_attribute_equality": Check(attribute_changes, f"""
WITH {EVENTS_SQL}, a AS (SELECT *, CASE WHEN k % 5 > 1 THEN event_type END AS matrix, k % 2 AS turned FROM ev)
SELECT event_id, CASE WHEN row_number() OVER ({W}) > 1 THEN matrix IS NOT DISTINCT FROM lag(matrix) OVER ({W}) AND turned = lag(turned) OVER ({W}) END AS same FROM a"""),
    "content_rate_per_stream": Check(content_rate_per_stream, f"""
WITH {EVENTS_SQL}, flagged AS (
  SELECT *, lag(event_type) OVER ({W}) AS p FROM ev)
SELECT stream_id, count(*) AS changes,
       round((count(*) - 1) * 86400000000.0::DOUBLE / nullif(max(us) - min(us), 0), 6) AS changes_per_day
FROM flagged WHERE p IS NULL OR p <> event_type GROUP BY stream_id"""),
    "a1_sample_source": Check(
        lambda spark, d: samples(spark, d).done().select(
            "stream_id", "event_id", "pts_ns", "epoch", "seq", "width", "height", "pixel_format",
            "plane_count", "content"),
        f"""WITH {SAMPLES_SQL} SELECT stream_id, event_id, pts_ns, epoch, seq, width, height,
pixel_format, plane_count, content FROM samples"""),
    "w1_interval": Check(sample_interval, f"""
WITH {EVENTS_SQL} SELECT event_id, us - lag(us) OVER ({W}) AS interval_us FROM ev"""),
    "w2_change_flags": Check(change_flags, f"""
WITH {SAMPLES_SQL} SELECT event_id, near <> lag(near) OVER ({W}) AS changed,
content <> lag(content) OVER ({W}) AS changed_exact FROM samples"""),
    "w3_collapse_runs": Check(run_collapse, f"""
WITH {SAMPLES_SQL}, p AS (SELECT *, lag(content) OVER ({W}) AS was FROM samples)
SELECT stream_id, event_id, seq, content FROM p WHERE was IS NULL OR was <> content"""),
    "w4_epochs": Check(epoch_numbers, f"""
WITH {EPOCH_SQL.replace('raw_ns', 'pts_ns')} SELECT event_id, cut_epoch FROM epoched"""
                       .replace("AS pts_ns,\n         CASE WHEN NOT", "AS raw_ns,\n         CASE WHEN NOT")),
    "w5_break_reasons": Check(break_reasons, f"WITH {REASON_SQL} SELECT event_id, reason FROM covered"),
    "w6_coverage": Check(coverage, f"""
WITH {REASON_SQL} SELECT event_id, run, covered_ns, coalesce(covered_ns >= 1000000000, FALSE) AS warm FROM covered"""),
    "w7_trailing_frames": Check(trailing_counts, f"""
WITH {SAMPLES_SQL} SELECT event_id, count(*) OVER (PARTITION BY stream_id ORDER BY raw_ns
  RANGE BETWEEN 999999999 PRECEDING AND CURRENT ROW) AS n_second,
""" + ",\n".join(f"max(value) OVER ({W} ROWS BETWEEN {r - 1} PRECEDING AND CURRENT ROW) AS max_{r}"
                 for r in (4, 8, 12, 32, 120)) + " FROM samples"),
    "w8_cadence_state": Check(cadence_state, f"""
WITH {CADENCE_SQL}
SELECT event_id, CASE WHEN state_reason IS NULL THEN 'estimated' ELSE 'unknown' END AS state, state_reason,
  round(CASE WHEN state_reason IS NULL THEN (updates - 1) * 1e9 / (last_change - first_change) END, 6) AS fps,
  CASE WHEN warm AND updates >= 2 THEN first_change END AS start_ns,
  CASE WHEN warm AND updates >= 2 THEN last_change END AS end_ns,
  CASE WHEN warm THEN updates ELSE 0 END AS updates,
  round(CASE WHEN warm AND strict_ok THEN (len(times) - 1) * 1e9 / (times[-1] - times[1]) END, 6) AS strict_fps,
  warm AND strict_ok AND repeats >= 2 AND repeats >= comparisons * 0.5 AS repeat_proof,
  CASE WHEN warm THEN repeats ELSE 0 END AS repeats
FROM states"""),
    "w9_recent_median": Check(recent_rate_median, f"""
WITH {EVENTS_SQL}, l AS (SELECT event_id, list_sort(list(value) OVER ({W}
  ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) AS v FROM ev)
SELECT event_id, v[len(v) // 2 + 1] AS recent_median FROM l"""),
    "w13_strictly_increasing": Check(increasing_rows, f"""
WITH {EVENTS_SQL}, s AS (SELECT stream_id, event_id, us, us // 1000000 + k * 3600 AS stamp FROM ev),
t AS (SELECT *, max(stamp) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s)
SELECT stream_id, event_id, stamp FROM t WHERE top IS NULL OR stamp > top"""),
    "d5_delivered_rate": Check(delivered_rates, f"""
WITH {EPOCH_SQL}, iv AS (
  SELECT *, CASE WHEN lag(cut_epoch) OVER ({W}) = cut_epoch THEN raw_step / 1e9 END AS iv FROM epoched),
l AS (SELECT event_id, list(iv) FILTER (WHERE iv IS NOT NULL) OVER (
  PARTITION BY stream_id, cut_epoch ORDER BY us, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS v FROM iv),
m AS (SELECT *, list_median(v) AS mid FROM l)
SELECT event_id, round(CASE WHEN len(v) >= 8
    AND len([i FOR i IN v IF abs(i - mid) <= mid * 0.05]) * 4 >= len(v) * 3
    AND len([i FOR i IN v[-4:] IF abs(i - mid) <= mid * 0.05]) >= 3
    AND 1 / mid BETWEEN 10 AND 240 THEN 1 / mid END, 6) AS delivered_fps FROM m"""),
    "d6_content_rate": Check(content_rate_window, f"""
WITH {FLAT_FRAMES_SQL} SELECT event_id, updates, first_change, last_change,
  round(CASE WHEN updates >= 4 AND last_change > first_change AND pts_ns - last_change <= 250000000
        THEN (updates - 1) * 1e9 / (last_change - first_change) END, 6) AS content_fps FROM states"""),
    "d7_strict_rate": Check(strict_rate_window, f"""
WITH {FLAT_FRAMES_SQL} SELECT event_id,
  round(CASE WHEN strict_ok THEN (len(times) - 1) * 1e9 / (times[-1] - times[1]) END, 6) AS strict_fps,
  CASE WHEN strict_ok THEN times[1] END AS strict_start_ns,
  CASE WHEN strict_ok THEN times[-1] END AS strict_end_ns,
  coalesce(len(times), 0) AS strict_updates,
  strict_ok AND repeats >= 2 AND repeats >= comparisons * 0.5 AS repeat_proof FROM states"""),
    "d16_reason_histogram": Check(reason_histogram, f"""
WITH {CADENCE_SQL} SELECT coalesce(state_reason, 'estimated') AS reason, count(*) AS count FROM states GROUP BY 1"""),
}
