"""Checks of joins, pairing, timelines, buffers and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadencekit.checks.base import EVENTS_SQL, SAMPLES_SQL, Check, event_stream, events, r6, samples, table
from cadencekit.checks.scalars import KEYS, LINES, lines
from cadencekit.checks.streams import CADENCE_SQL, W
from cadencekit.operators import asof as A
from cadencekit.operators import buffers as B
from cadencekit.operators import catalog as K
from cadencekit.operators import pairing as P
from cadencekit.operators import quality as Q
from cadencekit.operators.control import first_picture, with_staleness
from cadencekit.plans.cadence import cadence
from cadencekit.plans.timeline import admitted, synthesise

DAY_US = 86_400_000_000


def adjacent(spark, d):
    s = P.adjacent_pairs(samples(spark, d))
    return s.done().select("event_id", "prev_seq", "prev_pts_ns", "prev_content")


def unique(spark, d):
    s = P.unique_pairs(cadence(samples(spark, d), "content", "near"))
    return s.done().select("event_id", "prev_seq", "prev_pts_ns", "cur_seq", "cur_pts_ns")


UNIQUE_SQL = CADENCE_SQL + f""",
fresh AS (
  SELECT *, reason IS NOT NULL AND reason NOT IN ('invalid_timestamp', 'unsupported_format')
            OR coalesce(changed_exact, FALSE) AS fresh,
         reason IS NULL OR reason NOT IN ('invalid_timestamp', 'unsupported_format') AS usable
  FROM states),
ends AS (
  SELECT *, lag(seq) OVER u AS u_seq, lag(pts_ns) OVER u AS u_pts
  FROM fresh WHERE fresh WINDOW u AS (PARTITION BY stream_id, run ORDER BY us, event_id)),
paired AS (
  SELECT f.*, CASE WHEN usable THEN e.u_seq END AS prev_seq, CASE WHEN usable THEN e.u_pts END AS prev_pts_ns,
    CASE WHEN usable AND e.u_seq IS NOT NULL THEN e.seq END AS cur_seq,
    CASE WHEN usable AND e.u_seq IS NOT NULL THEN e.pts_ns END AS cur_pts_ns
  FROM fresh f ASOF LEFT JOIN (SELECT stream_id, run, event_id, seq, pts_ns, u_seq, u_pts FROM ends) e
    ON f.stream_id = e.stream_id AND f.run = e.run AND f.event_id >= e.event_id)
"""
ADMITTED_SQL = UNIQUE_SQL + f""",
stepped AS (
  SELECT *, CASE WHEN reason IS NULL THEN (pts_ns - lag(pts_ns) OVER ({W})) / 1e9 END AS iv FROM paired),
lists AS (
  SELECT *, list(iv) FILTER (WHERE iv IS NOT NULL) OVER (PARTITION BY stream_id, run ORDER BY us, event_id
    ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS v FROM stepped),
medians AS (SELECT *, list_median(v) AS dm FROM lists),
rated AS (
  SELECT *, CASE WHEN len(v) >= 8 AND len([i FOR i IN v IF abs(i - dm) <= dm * 0.05]) * 4 >= len(v) * 3
      AND len([i FOR i IN v[-4:] IF abs(i - dm) <= dm * 0.05]) >= 3 AND 1 / dm BETWEEN 10 AND 240
    THEN 1 / dm END AS sampling,
    CASE WHEN state_reason IS NULL THEN (updates - 1) * 1e9 / (last_change - first_change) END AS fps,
    warm AND strict_ok AND repeats >= 2 AND repeats >= comparisons * 0.5 AS proof
  FROM medians),
evidence AS (
  SELECT *, CASE WHEN fps IS NOT NULL THEN fps
                 WHEN proof THEN (len(times) - 1) * 1e9 / (times[-1] - times[1]) END AS ev_fps,
    CASE WHEN fps IS NOT NULL THEN last_change WHEN proof THEN times[-1] END AS ev_end,
    CASE WHEN cur_pts_ns > prev_pts_ns THEN cur_pts_ns / 1e9 - prev_pts_ns / 1e9 END AS period
  FROM rated WHERE fresh AND prev_seq IS NOT NULL),
ticked AS (SELECT *, period / (1 / sampling) AS ticks FROM evidence),
proven AS (
  SELECT * FROM ticked
  WHERE sampling IS NOT NULL AND period <= 0.1 AND round(ticks) >= 1
    AND abs(ticks - round(ticks)) <= greatest(0.12, round(ticks) * 0.12)
    AND (round(ticks) <= 3 AND sampling <= 60.25
      OR coalesce(ev_end / 1e9 <= cur_pts_ns / 1e9 AND ev_fps BETWEEN 19.5 AND 60.25
        AND least(ev_fps, 60) <= sampling + 0.5
        AND abs(period - 1 / least(ev_fps, 60)) <= greatest(0.010, 1 / least(ev_fps, 60) * 0.25), FALSE))
    AND coalesce(ev_fps, 1 / period) BETWEEN 19.5 AND 60.25)
"""
STEP_SQL = ADMITTED_SQL + f""",
counted AS (SELECT *, count(ev_fps) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth,
    list_sort(list(period) OVER ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) AS ps FROM proven),
recent AS (SELECT *, list_sort(list(ev_fps) FILTER (WHERE ev_fps IS NOT NULL) OVER (
    PARTITION BY stream_id ORDER BY nth RANGE BETWEEN 7 PRECEDING AND CURRENT ROW)) AS es FROM counted),
content AS (SELECT *, coalesce(es[len(es) // 2 + 1], 1 / ps[len(ps) // 2 + 1]) AS c FROM recent),
chosen AS (SELECT *, CASE WHEN c * 2 >= 59.5 AND c * 2 <= 120.5 THEN 2
    WHEN c * 3 >= 59.5 AND c * 3 <= 120.5 AND c < 25 THEN 3 WHEN c * 2 <= 120.5 THEN 2 ELSE 1 END AS want FROM content),
fitted AS (SELECT *, CASE WHEN least(want, floor(120 * period + 0.02)) >= 2
    THEN CAST(least(want, floor(120 * period + 0.02)) AS BIGINT) ELSE 1 END AS step FROM chosen)
"""


def evidence_join(spark, d):
    ev = events(spark, d).withColumn("epoch", F.floor(F.col("us") / (15 * DAY_US)).cast("long"))
    ev = ev.withColumn("pts_ns", F.col("us") * 1000).withColumn("seq", F.col("event_id"))
    is_evidence = F.col("event_type") == "signup"
    evidence = ev.filter(is_evidence).select(
        "stream_id", "epoch", "seq", F.col("pts_ns").alias("end_ns"), F.col("value").alias("content_fps"),
        (F.col("k") > 50).alias("strict"))
    left = ev.filter(~is_evidence).select("stream_id", "epoch", "seq", "pts_ns")
    out = A.asof_evidence(left, evidence, 2 * DAY_US * 1000)
    return out.select(F.col("seq").alias("event_id"), "evidence_fps", "evidence_strict", "evidence_end_ns")


def pair_periods(spark, d):
    """Pairs of known spacing under 60 and 120 Hz sampling, with and without evidence."""
    df = lines(spark, d)
    prev = F.col("l_discount")
    cur = prev + F.col("l_linenumber") / 60.0 + F.col("l_tax") / 20
    fps = F.when(F.col("l_returnflag") == "A", 20.0).when(F.col("l_returnflag") == "N", 30.0)
    period = P.pair_period(prev, cur, F.col("display"), fps, cur - 0.01, F.col("l_quantity") > 10, F.col("l_quantity") < 40)
    return df.select(*KEYS, r6(period).alias("period_s"))


PERIOD_SQL = LINES + """, p AS (
  SELECT *, l_discount + l_linenumber / 60.0::DOUBLE + l_tax / 20 AS cur,
    CASE l_returnflag WHEN 'A' THEN 20.0::DOUBLE WHEN 'N' THEN 30.0 END AS fps FROM lines),
q AS (SELECT *, cur - l_discount AS period, (cur - l_discount) / (1 / display) AS ticks FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN period <= 0.1 AND round(ticks) >= 1
    AND abs(ticks - round(ticks)) <= greatest(0.12, round(ticks) * 0.12)
    AND (round(ticks) <= 3 AND display <= 60.25 OR coalesce(l_quantity > 10 AND l_quantity < 40
      AND abs(period - 1 / fps) <= greatest(0.010, 1 / fps * 0.25), FALSE)) THEN period END, 6) AS period_s FROM q
"""


def formats(spark, d):
    wide = F.col("p_type").isin("STANDARD", "ECONOMY", "MEDIUM")
    return table(spark, d, "part").select(
        F.col("p_brand").alias("device_id"), F.col("p_partkey").alias("format_idx"),
        F.when(wide, 1920).otherwise(1280).alias("width"), F.when(wide, 1080).otherwise(720).alias("height"),
        F.when(F.col("p_name").startswith("small"), "420v").otherwise("2vuy").alias("pixel_format"),
        F.col("p_size").cast("double").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 7).cast("double").alias("hi"))


FORMATS = """formats AS (
  SELECT p_brand AS device_id, p_partkey AS format_idx,
    CASE WHEN p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM') THEN 1920 ELSE 1280 END AS width,
    CASE WHEN p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM') THEN 1080 ELSE 720 END AS height,
    CASE WHEN p_name LIKE 'small%' THEN '420v' ELSE '2vuy' END AS pixel_format,
    p_size::DOUBLE AS lo, (p_size + p_partkey % 7)::DOUBLE AS hi FROM part)"""


def requests(spark, d):
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("format_idx"), F.col("p_brand").alias("device_id"))
    asked = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("format_idx"),
        F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity")).alias("rate"))
    return asked.join(brand, "format_idx")


REQUESTS = FORMATS + """, requests AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS format_idx, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END AS rate,
    p_brand AS device_id FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def ranges(spark, d):
    """Every third format has a second range, which overlaps or follows the first."""
    first = formats(spark, d).withColumn("pos", F.lit(1))
    second = first.filter(F.col("format_idx") % 3 == 0).withColumns({
        "pos": F.col("format_idx") % 2 * 2, "lo": F.col("hi") + F.col("format_idx") % 4 - 1.505, "hi": F.col("hi") + F.col("format_idx") % 7 + 1.509})
    return first.unionByName(second)


RANGES = FORMATS + """, ranges AS (
  SELECT *, 1 AS pos FROM formats UNION ALL
  SELECT device_id, format_idx, width, height, pixel_format, hi + format_idx % 4 - 1.505, hi + format_idx % 7 + 1.509, format_idx % 2 * 2
  FROM formats WHERE format_idx % 3 = 0)"""


def matched_formats(spark, d):
    return K.match_format(requests(spark, d), ranges(spark, d)).drop("device_id")


def next_rates(spark, d):
    asked = requests(spark, d).withColumn("content_fps", F.col("rate") * 1.1)
    rates = formats(spark, d).select("device_id", F.col("lo").alias("rate"))
    out = K.next_rate(asked.drop("rate"), rates, ["device_id"])
    return out.select("l_orderkey", "l_linenumber", "format_idx", "target_rate")


def overlaps(spark, d):
    windows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("window_id"), F.col("c_nationkey").alias("host"),
        (F.col("c_custkey") * 37 % 6000).cast("double").alias("x"), (F.col("c_custkey") * 53 % 2000).cast("double").alias("y"),
        (F.col("c_acctbal") / 5).alias("w"), (F.col("c_custkey") % 900 + 10).cast("double").alias("h"))
    displays = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("display_id"), F.col("s_nationkey").alias("host"),
        (F.col("s_suppkey") * 700 % 7000).cast("double").alias("x"), (F.col("s_suppkey") * 90 % 1000).cast("double").alias("y"),
        F.lit(1920.0).alias("w"), F.lit(1080.0).alias("h"))
    return K.largest_overlap(windows, displays, ["host"]).select("window_id", "display_id")


def paired_devices(spark, d):
    video = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("host_id"), F.col("s_suppkey").alias("video_id"),
        F.concat(F.lit("Cam "), (F.col("s_suppkey") % 10).cast("string")).alias("name"),
        F.when(F.col("s_suppkey") % 9 == 0, "off").when(F.col("s_suppkey") % 9 == 1, F.col("s_suppkey").cast("string")).alias("saved"))
    audio = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("host_id"), F.col("c_custkey").cast("string").alias("audio_id"),
        F.concat(F.when(F.col("c_custkey") % 3 == 0, "CAM ").otherwise("Mic "), (F.col("c_custkey") % 30).cast("string"))
        .alias("name"), F.when(F.col("c_mktsegment") == "FURNITURE", "usb").otherwise("built_in").alias("transport"),
        F.col("c_custkey").alias("rank"))
    return K.pair_devices(video, audio).select("video_id", "paired_audio", "paired_by")


PAIR_SQL = """
WITH video AS (SELECT s_nationkey AS host, s_suppkey AS video_id, 'Cam ' || s_suppkey % 10 AS name,
    CASE s_suppkey % 9 WHEN 0 THEN 'off' WHEN 1 THEN CAST(s_suppkey AS VARCHAR) END AS saved FROM supplier),
audio AS (SELECT c_nationkey AS host, CAST(c_custkey AS VARCHAR) AS audio_id, c_custkey AS rank,
    CASE WHEN c_custkey % 3 = 0 THEN 'CAM ' ELSE 'Mic ' END || c_custkey % 30 AS name,
    c_mktsegment = 'FURNITURE' AS usb FROM customer),
found AS (SELECT v.*, min(CASE WHEN a.name = v.name THEN a.rank END) AS eq,
    min(CASE WHEN usb AND (contains(lower(a.name), lower(v.name)) OR contains(lower(v.name), lower(a.name))) THEN a.rank END) AS near,
    bool_or(a.audio_id = v.saved) AS present
  FROM video v LEFT JOIN audio a ON a.host = v.host GROUP BY ALL)
SELECT video_id, CASE WHEN saved IS NULL THEN CAST(coalesce(eq, near) AS VARCHAR) WHEN present THEN saved END AS paired_audio,
  CASE WHEN saved = 'off' THEN 'off' WHEN present AND saved IS NOT NULL THEN 'saved' WHEN saved IS NOT NULL THEN 'saved_missing'
    WHEN eq IS NOT NULL THEN 'equal_name' WHEN near IS NOT NULL THEN 'contained_name' ELSE 'none' END AS paired_by FROM found
"""


def current_generation(spark, d):
    rows = samples(spark, d).done()
    owners = rows.groupBy("stream_id").agg(F.max("epoch").alias("epoch"))
    return K.current_only(rows, owners).select("stream_id", "event_id", "epoch")


def owned_rows(spark, d):
    """Events that fall between a sign-up and two days after it."""
    ev = events(spark, d)
    spans = ev.filter(F.col("event_type") == "signup").select(
        "stream_id", F.col("us").alias("since"), (F.col("us") + 2 * DAY_US).alias("until"))
    return K.owned_at(ev, spans, ["stream_id"], "us", "since", "until").select("stream_id", "event_id")


STAMP = lambda: (F.floor(F.col("us") / 1_000_000) + F.col("k") * 3600).cast("long")


def aligned_audio(spark, d):
    ev = events(spark, d).withColumn("pts_ns", STAMP())
    is_video = F.col("event_type").isin("view", "click")
    starts = B.session_starts(ev.filter(is_video), ["stream_id"], ["us", "event_id"])
    out = B.align_audio(ev.filter(~is_video).select("stream_id", "us", "event_id", "pts_ns"), starts,
                        ["stream_id"], ["us", "event_id"])
    return out.select("event_id", "outcome")


def admitted_video(spark, d):
    s = event_stream(spark, d)
    low = F.col("value") < 25
    s = s.select(
        "us", "event_id", F.when(~((F.col("k") == 13) & low), STAMP()).alias("pts_ns"),
        F.when((F.col("k") == 21) & low, 640).otherwise(1280).alias("width"), F.lit(720).alias("height"),
        F.lit(1280).alias("session_width"), F.lit(720).alias("session_height"), (F.col("k") != 5).alias("ready"))
    return B.admit_video(s, "ready").done().select("event_id", "drop_reason")


def preset_labels(spark, d):
    part = table(spark, d, "part")
    presets = part.filter(F.col("p_size") <= 10).select("p_type", "p_size", F.col("p_name").alias("preset"))
    out = K.label_preset(part, presets, ["p_type", "p_size"])
    has = F.array_compact(F.array(
        F.when(F.col("p_size") % 2 == 0, "balanced"), F.when(F.col("p_size") % 3 == 0, "quality"),
        F.when(F.col("p_size") % 5 == 0, "flow")))
    mode = F.when(F.col("p_type") == "SMALL", "off").otherwise("quality")
    return out.select("p_partkey", "preset", K.available_mode(mode, has).alias("mode"))


def ledgers(spark, d):
    li = table(spark, d, "lineitem")
    received = li.select(F.col("l_suppkey").alias("session_id"), F.col("l_orderkey").alias("pts_ns"))
    status = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "dropped")
    noted = li.filter((F.col("l_returnflag") != "N") | (F.col("l_linestatus") == "O"))
    ledger = noted.select(F.col("l_suppkey").alias("session_id"), F.col("l_orderkey").alias("pts_ns"),
                          F.coalesce(status, F.lit("failed")).alias("status"),
                          F.when(F.col("l_linenumber") < 4, "video").otherwise("audio").alias("media"))
    return received, ledger


LEDGER_SQL = """received AS (SELECT l_suppkey AS session_id, l_orderkey AS pts_ns FROM lineitem),
ledger AS (SELECT l_suppkey AS session_id, l_orderkey AS pts_ns,
    CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'dropped' ELSE 'failed' END AS status,
    CASE WHEN l_linenumber < 4 THEN 'video' ELSE 'audio' END AS media
  FROM lineitem WHERE l_returnflag <> 'N' OR l_linestatus = 'O')"""


def reconciled(spark, d):
    received, ledger = ledgers(spark, d)
    return Q.reconcile(received, ledger, ["session_id"])


def losses(spark, d):
    return Q.loss_summary(ledgers(spark, d)[1], ["session_id"])


def ledger_difference(spark, d):
    received, ledger = ledgers(spark, d)
    return Q.ledger_diff(received, ledger, ["session_id", "pts_ns"])


def ledger_overlap(spark, d):
    _, ledger = ledgers(spark, d)
    return Q.ledger_common(ledger.filter("status = 'accepted'"), ledger.filter("status = 'dropped'"), ["session_id", "pts_ns"])


def buffer_outcomes(spark, d):
    """Each user's log as puts of about an hour into a buffer of four days and eight rows."""
    s = event_stream(spark, d)
    s = s.withColumn("pts_ns", F.when(F.col("k") != 13, F.col("us") + F.when(F.col("k") == 17, -DAY_US).otherwise(0)))
    s = s.withColumn("duration_ns", F.when(F.col("k") != 29, (F.col("value") * 100_000_000).cast("long")))
    return B.bounded_buffer(s, max_ns=4 * DAY_US, max_rows=8).done().select("event_id", "outcome")


BUFFER_SQL = f"""
WITH {EVENTS_SQL}, p AS (
  SELECT *, CASE WHEN k <> 13 THEN us + CASE WHEN k = 17 THEN -{DAY_US} ELSE 0 END END AS pts,
    CASE WHEN k <> 29 THEN CAST(trunc(value * 100000000) AS BIGINT) END AS dur FROM ev),
s AS (SELECT *, pts IS NOT NULL AND coalesce(dur > 0, FALSE) AS shaped FROM p),
v AS (SELECT *, shaped AND pts >= coalesce(max(pts) FILTER (WHERE shaped) OVER (
    {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), pts) AS valid FROM s),
f AS (SELECT *, sum(dur) FILTER (WHERE valid) OVER r AS held, max(pts + dur) FILTER (WHERE valid) OVER r AS last_end,
    count(*) FILTER (WHERE valid) OVER r AS n
  FROM v WINDOW r AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN NOT valid THEN 'rejected' WHEN held <= {4 * DAY_US + 1} AND last_end - pts <= {4 * DAY_US + 1}
  AND n <= 8 THEN 'kept' ELSE 'evicted' END AS outcome FROM f"""


def evicted_first(spark, d):
    return buffer_outcomes(spark, d).filter("outcome = 'evicted'").select("event_id")


def latest_rows(spark, d):
    return K.latest_per_key(events(spark, d), ["stream_id"], ["us", "event_id"]).select(
        "stream_id", "event_id", "event_type", "dropped")


def idle_tails(spark, d):
    ev = events(spark, d).select("stream_id", F.col("us").alias("pts_ns"), "event_type")
    stops = ev.select("stream_id").distinct().select(
        "stream_id", F.lit(30 * DAY_US).alias("stop_ns"), (F.col("stream_id") % 3 != 0).alias("idle_primed"))
    return B.fill_idle_tail(ev, stops, ["stream_id"], gap_ns=DAY_US // 4)


def anchored(spark, d):
    ev = events(spark, d).select("stream_id", F.col("us").alias("pts_ns"), "event_id", "event_type")
    starts = ev.select("stream_id").distinct().withColumn("start_ns", F.lit(10 * DAY_US) + F.col("stream_id"))
    return B.anchor_start(ev, starts, ["stream_id"])


def activity(spark, d):
    ev = events(spark, d)
    stated = F.when(F.col("event_type") == "purchase", F.col("value"))
    said = ev.filter(F.col("event_type").isin("purchase", "error")).select(
        "stream_id", F.col("us").alias("at"), stated.alias("rate"))
    asked = ev.filter(F.col("event_type") == "view").select("stream_id", "event_id", "us")
    return A.active_at(asked, said, "us", ["stream_id"], "rate", "at", ttl=DAY_US).select("event_id", "active")


def claims(spark, d):
    ev = events(spark, d)
    claim = ev.filter(F.col("event_type") == "click").withColumn("evidence_us", F.col("us") - F.col("k") * 1_000_000_000)
    reasons = ev.filter(F.col("event_type") == "error").select("stream_id", F.col("us").alias("reason_us"))
    out = A.running_claim(claim, reasons, ["stream_id"], "us", "evidence_us", "reason_us")
    return out.select("event_id", "running")


def stale_states(spark, d):
    s = cadence(samples(spark, d), "content", "near")
    out = with_staleness(s.done(), F.col("pts_ns") + F.col("k") * 20_000_000)
    return out.select("event_id", "state", "state_reason", r6("fps").alias("fps"), r6("last_fps").alias("last_fps"),
                      "repeat_proof")


def first_pictures(spark, d):
    ev = events(spark, d)
    starts = ev.filter(F.col("event_type") == "signup").select("stream_id", "event_id", F.col("us").alias("start_us"))
    pictures = ev.filter(F.col("event_type") == "view").select("stream_id", "us")
    out = first_picture(starts, pictures, ["stream_id"], "start_us", "us", DAY_US)
    return out.select("event_id", "first_time", "first_state")


def timeline(spark, d):
    out = synthesise(samples(spark, d), F.lit(120.0), content="content", near="near")
    return out.select("event_id", "step", r6("phase").alias("phase"), "generated", "due_ns", r6("slot_s").alias("slot_s"))


def admitted_timing(spark, d):
    s = admitted(samples(spark, d), "content", "near")
    return s.done().select("event_id", "prev_seq", "cur_seq", r6("period_s").alias("period_s"),
                           r6("evidence_fps").alias("evidence_fps"))


def slots(spark, d):
    from cadencekit.functions.rates import phases
    df = lines(spark, d).withColumn("period", 1 / F.col("l_quantity")).withColumn(
        "phases", phases(F.when(F.col("l_linenumber") < 4, F.col("l_linenumber")).otherwise(2)))
    slot = F.col("period") / (F.size("phases") + 1)
    return df.select(*KEYS, r6(slot).alias("slot_s"), r6(F.col("l_tax") + slot * F.size("phases")).alias("endpoint_s"))


def partial_pairs(spark, d):
    """Pairs of which only some phases were produced keep that prefix."""
    from cadencekit.functions.rates import partial_phases, phases
    df = lines(spark, d).withColumn("planned", phases(F.when(F.col("l_linenumber") % 2 == 0, 2).otherwise(3)))
    made = (F.col("l_quantity") % 4).cast("int")
    out = partial_phases("planned", made)
    return df.select(*KEYS, F.transform(out["phases"], r6).alias("phases"), out["step"].alias("step"))


def interleaved(spark, d):
    """Source rows and one synthesised row half-way to the next, in time order per stream."""
    from cadencekit.plans.timeline import interleave
    s = event_stream(spark, d).previous(desc=True, next_us=F.col("us"))
    src = s.done().select("stream_id", "event_id", "us")
    half = F.floor((F.col("us") + F.col("next_us")) / 2).cast("long")
    made = s.done().filter("next_us is not null").select("stream_id", "event_id", half.alias("us"))
    return interleave(src, made, ["stream_id"], "us")


CHECKS = {
    "c1_adjacent_pairs": Check(adjacent, f"""
WITH {SAMPLES_SQL}, p AS (SELECT *, lag(seq) OVER w AS prev_seq, lag(pts_ns) OVER w AS prev_pts_ns, lag(content) OVER w AS prev_content,
  lag(epoch) OVER w AS e, lag(width) OVER w AS pw FROM samples WINDOW w AS ({W}))
SELECT event_id, prev_seq, prev_pts_ns, prev_content FROM p WHERE prev_seq = seq - 1 AND e = epoch AND pw = width"""),
    "c2_unique_pairs": Check(unique, f"WITH {UNIQUE_SQL} SELECT event_id, prev_seq, prev_pts_ns, cur_seq, cur_pts_ns FROM paired"),
    "c3_evidence_asof": Check(evidence_join, f"""
WITH {EVENTS_SQL}, l AS (SELECT *, us // {15 * DAY_US} AS epoch FROM ev WHERE event_type <> 'signup'),
e AS (SELECT stream_id, us AS e_us, us // {15 * DAY_US} AS epoch, value, k > 50 AS strict, event_id AS e_seq FROM ev WHERE event_type = 'signup'),
j AS (SELECT l.*, e.value AS ev_value, e.strict, e.e_us, e_seq FROM l ASOF LEFT JOIN e
  ON l.stream_id = e.stream_id AND l.epoch = e.epoch AND l.us >= e.e_us),
o AS (SELECT *, e_seq <= event_id AND us - e_us <= {2 * DAY_US} AS ok FROM j)
SELECT event_id, CASE WHEN ok THEN ev_value END AS evidence_fps, CASE WHEN ok THEN strict END AS evidence_strict,
  CASE WHEN ok THEN e_us * 1000 END AS evidence_end_ns FROM o"""),
    "c4_pair_period": Check(pair_periods, PERIOD_SQL),
    "c4_admitted_pairs": Check(admitted_timing, f"""WITH {ADMITTED_SQL} SELECT event_id, prev_seq, cur_seq,
  round(period, 6) AS period_s, round(ev_fps, 6) AS evidence_fps FROM proven"""),
    "c5_match_format": Check(matched_formats, f"""
WITH {REQUESTS.replace(FORMATS, RANGES)}, asked AS (SELECT *, row_number() OVER () AS row FROM requests),
t AS (SELECT format_idx, device_id, any_value(width) AS width, any_value(height) AS height, max(hi) AS top FROM ranges GROUP BY ALL),
s AS (SELECT a.*, t.width, t.height, CASE WHEN rate = 0 THEN top ELSE rate END AS aim FROM asked a JOIN t USING (device_id, format_idx)),
-- The selected format's ranges come before those of the others of its size.
h AS (SELECT s.*, f.format_idx AS idx, f.lo, f.hi,
    row_number() OVER (PARTITION BY s.row ORDER BY f.format_idx <> s.format_idx, f.format_idx, f.pos) AS turn
  FROM s LEFT JOIN ranges f ON f.device_id = s.device_id AND f.width = s.width AND f.height = s.height AND s.aim BETWEEN f.lo - 0.01 AND f.hi + 0.01)
SELECT l_orderkey, l_linenumber, format_idx, rate, coalesce(idx, format_idx) AS chosen_idx, idx IS NOT NULL AS supported,
  lo AS chosen_lo, hi AS chosen_hi, CASE WHEN abs(hi - aim) < 0.01 THEN hi WHEN abs(lo - aim) < 0.01 THEN lo WHEN idx IS NOT NULL THEN aim END AS target_rate
FROM h WHERE turn = 1"""),
    "c6_next_rate": Check(next_rates, f"""
WITH {REQUESTS} SELECT l_orderkey, l_linenumber, format_idx, CASE WHEN rate > 0 THEN coalesce(
  (SELECT min(lo) FROM formats f WHERE f.device_id = r.device_id AND lo >= r.rate * 1.1 - 0.01),
  (SELECT max(lo) FROM formats f WHERE f.device_id = r.device_id)) END AS target_rate FROM requests r"""),
    "c7_largest_overlap": Check(overlaps, """
WITH win AS (SELECT c_custkey AS window_id, c_nationkey AS host, (c_custkey * 37 % 6000)::DOUBLE AS x, (c_custkey * 53 % 2000)::DOUBLE AS y,
    c_acctbal / 5 AS w, (c_custkey % 900 + 10)::DOUBLE AS h FROM customer),
dis AS (SELECT s_suppkey AS display_id, s_nationkey AS host, (s_suppkey * 700 % 7000)::DOUBLE AS dx, (s_suppkey * 90 % 1000)::DOUBLE AS dy FROM supplier),
p AS (SELECT window_id, display_id, least(x + w, dx + 1920) - greatest(x, dx) AS ow, least(y + h, dy + 1080) - greatest(y, dy) AS oh,
    x + w / 2 >= dx AND x + w / 2 < dx + 1920 AND y + h / 2 >= dy AND y + h / 2 < dy + 1080 AS central
  FROM win JOIN dis USING (host) WHERE w > 0)
SELECT w.window_id, b.display_id FROM win w LEFT JOIN (
  SELECT window_id, display_id FROM p WHERE ow > 0 AND oh > 0
  QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY ow * oh DESC, central DESC, display_id) = 1) b USING (window_id)"""),
    "c8_pair_devices": Check(paired_devices, PAIR_SQL),
    "c9_current_only": Check(current_generation, f"""
WITH {SAMPLES_SQL} SELECT stream_id, event_id, epoch FROM samples s
WHERE epoch = (SELECT max(epoch) FROM samples t WHERE t.stream_id = s.stream_id)"""),
    "c9_owned_at": Check(owned_rows, f"""
WITH {EVENTS_SQL} SELECT stream_id, event_id FROM ev e WHERE EXISTS (
  SELECT 1 FROM ev s WHERE s.event_type = 'signup' AND s.stream_id = e.stream_id AND s.us <= e.us AND e.us < s.us + {2 * DAY_US})"""),
    "c10_align_audio": Check(aligned_audio, f"""
WITH {EVENTS_SQL}, s AS (SELECT *, us // 1000000 + k * 3600 AS pts, event_type IN ('view', 'click') AS video FROM ev),
b AS (SELECT stream_id, arg_min(pts, us) AS start FROM s WHERE video GROUP BY 1),
a AS (SELECT s.*, start, max(CASE WHEN pts >= start THEN pts END) OVER ({W.replace('stream_id', 's.stream_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
  FROM s LEFT JOIN b USING (stream_id) WHERE NOT video)
SELECT event_id, CASE WHEN start IS NULL THEN 'pending' WHEN pts < start THEN 'preroll' WHEN pts <= last THEN 'dropped' ELSE 'accepted' END AS outcome FROM a"""),
    "c11_admit_video": Check(admitted_video, f"""
WITH {EVENTS_SQL}, s AS (SELECT *, CASE WHEN NOT (k = 13 AND value < 25) THEN us // 1000000 + k * 3600 END AS pts,
    NOT (k = 21 AND value < 25) AS sized, k <> 5 AS ready FROM ev),
b AS (SELECT *, first_value(pts IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start FROM s),
l AS (SELECT *, max(CASE WHEN pts >= start AND sized AND ready THEN pts END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM b)
SELECT event_id, CASE WHEN pts IS NULL THEN 'invalid' WHEN pts <= last THEN 'not_increasing' WHEN pts < start THEN 'before_start'
  WHEN NOT sized THEN 'size' WHEN NOT ready THEN 'not_ready' END AS drop_reason FROM l"""),
    "c13_label_preset": Check(preset_labels, """
WITH pre AS (SELECT p_type, p_size, min(p_name) AS preset FROM part WHERE p_size <= 10 GROUP BY ALL)
SELECT p_partkey, coalesce(preset, 'custom') AS preset, CASE WHEN p_type <> 'SMALL' AND p_size % 3 = 0 THEN 'quality'
  WHEN p_size % 5 = 0 THEN 'flow' WHEN p_size % 2 = 0 THEN 'balanced' WHEN p_size % 3 = 0 THEN 'quality' ELSE 'off' END AS mode
FROM part LEFT JOIN pre USING (p_type, p_size)"""),
    "c14_reconcile": Check(reconciled, f"""
WITH {LEDGER_SQL}, r AS (SELECT session_id, pts_ns, count(*) AS n_received FROM received GROUP BY ALL),
n AS (SELECT session_id, pts_ns, count(*) AS n_noted, min(status) AS status, max(status) AS other FROM ledger GROUP BY ALL)
SELECT session_id, pts_ns, coalesce(n_received, 0) AS n_received, coalesce(n_noted, 0) AS n_noted, status,
  coalesce(n_received, 0) = coalesce(n_noted, 0) AND status IS NOT DISTINCT FROM other AS balanced,
  n_noted IS NULL AS missing, n_received IS NULL AS unknown FROM r FULL JOIN n USING (session_id, pts_ns)"""),
    "d15_loss_summary": Check(losses, f"""
WITH {LEDGER_SQL}, l AS (SELECT session_id, count(*) FILTER (WHERE status IN ('dropped', 'failed') AND media = 'video') AS video_drops,
  count(*) FILTER (WHERE status IN ('dropped', 'failed') AND media = 'audio') AS audio_drops FROM ledger GROUP BY 1)
SELECT *, video_drops > 5 OR audio_drops > 0 AS alert FROM l"""),
    "u3_ledger_diff": Check(ledger_difference, f"""
WITH {LEDGER_SQL} SELECT *, 'only_a' AS side FROM (FROM received EXCEPT ALL SELECT session_id, pts_ns FROM ledger)
UNION ALL SELECT *, 'only_b' AS side FROM (SELECT session_id, pts_ns FROM ledger EXCEPT ALL FROM received)"""),
    "u3_ledger_common": Check(ledger_overlap, f"""
WITH {LEDGER_SQL} SELECT session_id, pts_ns FROM ledger WHERE status = 'accepted'
INTERSECT ALL SELECT session_id, pts_ns FROM ledger WHERE status = 'dropped'"""),
    "w11_bounded_buffer": Check(buffer_outcomes, BUFFER_SQL),
    "k4_evicted_rows": Check(evicted_first, f"SELECT event_id FROM ({BUFFER_SQL}) WHERE outcome = 'evicted'"),
    "k3_latest_per_key": Check(latest_rows, f"""
WITH {EVENTS_SQL} SELECT stream_id, arg_max(event_id, us) AS event_id, arg_max(event_type, us) AS event_type, count(*) - 1 AS dropped
FROM ev GROUP BY 1"""),
    "w14_active_at": Check(activity, f"""
WITH {EVENTS_SQL}, a AS (SELECT stream_id, us AS said, CASE WHEN event_type = 'purchase' THEN value END AS rate FROM ev WHERE event_type IN ('purchase', 'error'))
SELECT event_id, CASE WHEN us - said <= {DAY_US} THEN rate END AS active
FROM (FROM ev WHERE event_type = 'view') v ASOF LEFT JOIN a ON v.stream_id = a.stream_id AND v.us >= a.said"""),
    "w15_staleness": Check(stale_states, f"""
WITH {CADENCE_SQL}, j AS (SELECT *, coalesce(pts_ns IS NOT NULL AND k * 20000000 >= 1000000000, FALSE) AS old,
  CASE WHEN state_reason IS NULL THEN (updates - 1) * 1e9 / (last_change - first_change) END AS fps FROM states)
SELECT event_id, CASE WHEN old THEN 'stale' WHEN state_reason IS NULL THEN 'estimated' ELSE 'unknown' END AS state, state_reason,
  round(CASE WHEN NOT old THEN fps END, 6) AS fps, round(CASE WHEN old THEN fps END, 6) AS last_fps,
  NOT old AND warm AND strict_ok AND repeats >= 2 AND repeats >= comparisons * 0.5 AS repeat_proof FROM j"""),
    "w16_running_claim": Check(claims, f"""
WITH {EVENTS_SQL}, c AS (SELECT *, us - k * 1000000000 AS evidence FROM ev WHERE event_type = 'click'),
r AS (SELECT stream_id, us AS reason_us FROM ev WHERE event_type = 'error')
SELECT event_id, reason_us IS NULL OR reason_us <= evidence AS running
FROM c ASOF LEFT JOIN r ON c.stream_id = r.stream_id AND c.us >= r.reason_us"""),
    "w21_idle_tail": Check(idle_tails, f"""
WITH {EVENTS_SQL}, l AS (SELECT stream_id, max(us) AS last, arg_max(event_type, us) AS event_type FROM ev GROUP BY 1)
SELECT stream_id, us AS pts_ns, event_type, FALSE AS repeated FROM ev UNION ALL
SELECT stream_id, {30 * DAY_US}, event_type, TRUE FROM l WHERE stream_id % 3 <> 0 AND {30 * DAY_US} - last > {DAY_US // 4}"""),
    "w22_start_anchor": Check(anchored, f"""
WITH {EVENTS_SQL}, b AS (SELECT stream_id, max(us) AS last, arg_max(event_id, us) AS event_id, arg_max(event_type, us) AS event_type
  FROM ev WHERE us <= {10 * DAY_US} + stream_id GROUP BY 1)
SELECT stream_id, us AS pts_ns, event_id, event_type, FALSE AS anchored FROM ev WHERE us >= {10 * DAY_US} + stream_id UNION ALL
SELECT stream_id, {10 * DAY_US} + stream_id, event_id, event_type, TRUE FROM b WHERE last < {10 * DAY_US} + stream_id"""),
    "w25_first_picture": Check(first_pictures, f"""
WITH {EVENTS_SQL}, s AS (SELECT *, (SELECT min(us) FROM ev p WHERE p.event_type = 'view' AND p.stream_id = e.stream_id AND p.us >= e.us) AS first_time
  FROM ev e WHERE event_type = 'signup')
SELECT event_id, first_time, CASE WHEN first_time IS NULL THEN 'no_picture' WHEN first_time - us > {DAY_US} THEN 'running_late'
  ELSE 'running' END AS first_state FROM s"""),
    "g1_timeline": Check(timeline, f"""
WITH {STEP_SQL}, ph AS (SELECT *, unnest(range(1, step + 1)) AS i FROM fitted)
SELECT event_id, step, round(i / step::DOUBLE, 6) AS phase, i < step AS generated,
  prev_pts_ns + CAST(round(i / step::DOUBLE * (cur_pts_ns - prev_pts_ns)) AS BIGINT) AS due_ns, round(period / step, 6) AS slot_s FROM ph"""),
    "g3_slots": Check(slots, f"""{LINES}, p AS (SELECT *, CASE WHEN l_linenumber = 3 THEN 2 WHEN l_linenumber = 1 THEN 0 ELSE 1 END AS n FROM lines)
SELECT l_orderkey, l_linenumber, l_partkey, round(1 / l_quantity / (n + 1), 6) AS slot_s, round(l_tax + 1 / l_quantity / (n + 1) * n, 6) AS endpoint_s FROM p"""),
    "g5_partial_pair": Check(partial_pairs, f"""{LINES}, p AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN [0.5::DOUBLE] ELSE [0.333333::DOUBLE, 0.666667] END AS ph,
  CAST(l_quantity % 4 AS INT) AS made FROM lines)
SELECT l_orderkey, l_linenumber, l_partkey, ph[1:made] AS phases, CAST(least(made, len(ph)) + 1 AS INT) AS step FROM p"""),
    "u4_interleave": Check(interleaved, f"""
WITH {EVENTS_SQL}, n AS (SELECT *, lead(us) OVER ({W}) AS next_us FROM ev)
SELECT stream_id, event_id, us, FALSE AS generated FROM ev UNION ALL
SELECT stream_id, event_id, (us + next_us) // 2, TRUE FROM n WHERE next_us IS NOT NULL"""),
}
