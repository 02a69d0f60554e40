"""Checks of reports, catalogues and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadencekit.checks.base import EVENTS_SQL, SAMPLES_SQL, Check, event_stream, events, r6, samples, table
from cadencekit.checks.joins import DAY_US, FORMATS, formats
from cadencekit.checks.streams import W
from cadencekit.operators import buffers as B
from cadencekit.operators import catalog as K
from cadencekit.operators import quality as Q
from cadencekit.operators.ordered import join_on, ordered
from cadencekit.sources import sinks, tables
from cadencekit.sources.schema import SETTING_DEFAULTS

KINDS = ("click", "view", "error", "purchase", "signup")


def packet_durations(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") < 3, F.col("l_discount") - 0.02).alias("duration_s"),
        F.col("l_quantity").cast("long").alias("n_samples"), F.when(F.col("l_tax") > 0, 48000.0).alias("sample_rate"))
    return B.with_packet_duration(df).select("l_orderkey", "l_linenumber", "l_partkey", F.round("duration_s", 9).alias("duration_s"))


def fragments(spark, d):
    df = sinks.with_fragment(events(spark, d).withColumn("pts_ns", F.col("us") * 1000), seconds=86400)
    return df.groupBy("stream_id", "fragment").agg(F.count("*").alias("n_rows"), F.max("event_id").alias("last_id"))


def settings_log(spark, d):
    """Stored settings written from ``events``: some records lack the newer fields."""
    mode = F.when(F.col("event_type") == "click", "off").when(F.col("event_type") != "view", F.col("event_type"))
    record = F.to_json(F.struct(
        F.col("value").alias("strength"), mode.alias("mode"),
        F.when(F.col("k") > 50, F.col("k") % 2 == 0).alias("force"),
        F.when(F.col("k") > 80, F.lit(False)).alias("skip_duplicates")))
    df = events(spark, d).select("event_id", record.alias("json"))
    return tables.read_settings(df).select("event_id", "strength", "mode", "force", "skip_duplicates", "target", "contrast")


def diagnostics_records(spark, d):
    """Five-tick records; odd values become zero."""
    tick = F.floor(F.col("us") / (DAY_US // 4)).cast("long")
    df = (events(spark, d).withColumn("tick", tick).groupBy("stream_id", "tick")
          .agg(F.max("value").alias("peak"), F.count("*").alias("n"))
          .withColumn("ratio", F.when(F.col("n") > 1, F.col("peak")).otherwise(F.lit(float("nan"))))
          .withColumn("active", F.col("n") > 0))
    out = sinks.diagnostics(df)
    return out.select(F.get_json_object("value", "$.stream_id").cast("long").alias("stream_id"),
                      F.get_json_object("value", "$.tick").cast("long").alias("tick"),
                      F.get_json_object("value", "$.ratio").cast("double").alias("ratio"))


def sketched(spark, d):
    """The sketch of each stream, and of all rows as one stream, held against its stated error."""
    df = events(spark, d).withColumn("epoch", F.floor(F.col("us") / (5 * DAY_US))).withColumn("seq", F.col("us"))
    df = df.withColumn("stream_id", F.explode(F.array("stream_id", F.lit(-1).cast("long"))))
    exact = df.groupBy("stream_id").agg(F.count_distinct("epoch", "seq").alias("presented"))
    found = join_on(exact, Q.presented_sketch(df, ["stream_id"], "epoch"), ["stream_id"])
    error = F.abs(F.col("estimate") - F.col("presented"))
    return found.select("stream_id", "presented", (error <= 4 * 0.0163 * F.col("presented")).alias("within"))


def delivery(spark, d):
    df = events(spark, d).select(
        "stream_id", F.when(F.col("event_type").isin("click", "view"), "complete").when(F.col("event_type") == "error", "idle")
        .otherwise("blank").alias("status"), (F.col("k") > 10).alias("has_picture"))
    return tables.delivered(df).groupBy("stream_id", "delivery").count()


def windows(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("window_id"), F.when(F.col("c_nationkey") == 3, "").otherwise(
            F.concat(F.lit("App"), F.col("c_nationkey"))).alias("owner"),
        F.when(F.col("c_nationkey") == 7, "com.apple.dock").otherwise(F.col("c_mktsegment")).alias("owner_id"),
        F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("title"),
        (F.col("c_acctbal") / 4).alias("w"), (F.col("c_custkey") % 500).cast("double").alias("h"))


def window_list(spark, d):
    out = K.window_catalogue(windows(spark, d), exclude="MACHINERY")
    return out.select("window_id", "label", "width", "height")


def auto_choice(spark, d):
    devices = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("host_id"), F.col("c_custkey").alias("device_id"), F.col("c_custkey").alias("rank"),
        (F.col("c_acctbal") > 0).alias("external"), F.when(F.col("c_mktsegment") == "FURNITURE", "usb").otherwise("pci").alias("transport"))
    preferred = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("host_id")).agg(
        (F.max("s_suppkey") * 10).alias("preferred_id"))
    return K.auto_devices(devices, preferred)


def tick_report(spark, d):
    ev = events(spark, d)
    elapsed = (F.max("us") - F.min("us")) / 1_000_000_000.0
    return Q.tick_counters(ev, ["stream_id"], F.floor(F.col("us") / DAY_US).cast("long"), "event_type", KINDS, elapsed)


def supplier_costs(spark, d):
    out = Q.cost_summary(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return out.select("l_suppkey", r6("mean").alias("mean"), "p95", "n")


def presentation_tails(spark, d):
    return Q.interval_p95(event_stream(spark, d), "us").done().select("event_id", F.col("interval_p95").cast("long").alias("interval_p95"))


def acceptance_tails(spark, d):
    return Q.acceptance_p95(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


def selected_tails(spark, d):
    return Q.selected_tails(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


def nested_formats(spark, d):
    """Each part as one format with one or two rate ranges."""
    one = F.struct("lo", "hi")
    two = F.struct(F.col("lo").alias("lo"), (F.col("hi") * 2).alias("hi"))
    return formats(spark, d).withColumn("rates", F.when(F.col("format_idx") % 3 == 0, F.array(one, two)).otherwise(F.array(one)))


def catalogue(spark, d):
    return K.order_by_area(K.format_catalogue(nested_formats(spark, d)))


def catalogue_ranges(spark, d):
    return K.format_ranges(nested_formats(spark, d))


def advertised(spark, d):
    return K.advertised_rates(formats(spark, d), ["device_id"])


def levels(spark, d):
    return Q.level_peak(events(spark, d), ["stream_id"], "us", "value", DAY_US)


def order_structure(spark, d):
    """Orders as source sequences: first two lines synthesised, the third the endpoint."""
    li = table(spark, d, "lineitem").withColumn("made", F.col("l_linenumber") != 3)
    return Q.pair_structure(li, ["l_orderkey"], "l_shipdate", "made", 2)


def presented(spark, d):
    s = event_stream(spark, d).withColumn("seq", F.floor(F.col("us") / DAY_US) + F.col("k") % 3)
    return Q.distinct_presented(s)


def gate_windows(spark, d):
    s = event_stream(spark, d).previous(before=F.col("us"))
    df = s.done().withColumn("made", F.col("event_type").isin("click", "view", "error"))
    df = df.withColumn("interval", (F.col("us") - F.col("before")) / 1e6)
    return Q.acceptance(df, ["stream_id"], "us", 5 * DAY_US, "made", "interval", (0.5, 1.2), (0.8, 2.5), (1.5, 3.0),
                        150_000.0, 5.0)


def acceptance_verdicts(spark, d):
    out = gate_windows(spark, d)
    return out.select("stream_id", "win", r6("source_fps").alias("source_fps"), r6("generated_fps").alias("generated_fps"),
                      r6("output_fps").alias("output_fps"), r6("p95").alias("p95"), "passed")


def acceptance_gates(spark, d):
    return Q.acceptance_gate(gate_windows(spark, d), ["stream_id"], 3)


def ingress(spark, d):
    s = event_stream(spark, d)
    s = s.withColumn("pts_ns", F.when(F.col("k") != 50, F.col("us") + F.when(F.col("k") == 51, -DAY_US).otherwise(0)))
    s = (s.withColumn("sample", F.floor(F.col("us") / (7 * DAY_US)).cast("long")).withColumn("generation", F.col("sample"))
          .withColumn("epoch", F.when(F.col("k") == 52, 1).otherwise(0)).withColumn("arrival_s", F.col("us") / 1e6))
    out = Q.ingress_health(s, "sample", (F.col("sample") + 1) * 7 * 86400.0, max_age_s=86400.0)
    return out.select("stream_id", "sample", "n_rows", "n_pts", "healthy")


def cost_stream(spark, d):
    s = ordered(events(spark, d), ["stream_id", "event_type"], ["us", "event_id"])
    return Q.gated_cost(s, "value")


def gated(spark, d):
    return cost_stream(spark, d).done().select("event_id", "admission", "estimate", "warm")


def overload(spark, d):
    """Costs of one kind judged against the running costs of all kinds of the same stream."""
    s = event_stream(spark, d)
    kind = F.when(F.col("event_type").isin("click", "view"), "batch").when(F.col("event_type") == "error", "later").otherwise("endpoint")
    s = s.withColumn("kind", kind)
    for name in ("batch", "later", "endpoint"):
        s = s.trailing_rows(24, **{f"all_{name}": lambda w, name=name: F.collect_list(
            F.when(F.col("kind") == name, F.col("value") / 1000)).over(w)})
    from cadencekit.operators.rates import median_upper, nearest_rank
    size = lambda n: F.size(f"all_{n}")
    df = s.number("n").done()
    for n in ("batch", "later", "endpoint"):
        df = df.withColumn(f"adm_{n}", F.when(size(n) >= 6, median_upper(F.col(f"all_{n}"))))
        df = df.withColumn(f"est_{n}", F.coalesce(f"adm_{n}", F.when(size(n) > 0, nearest_rank(F.col(f"all_{n}")))))
    phases = F.array(F.lit(1 / 3), F.lit(2 / 3))
    verdict = Q.over_budget(
        F.col("kind"), F.col("n") > 2, F.col("adm_batch"), F.col("adm_later"), F.col("adm_endpoint"), F.col("est_batch"),
        F.col("est_later"), F.col("est_endpoint"), phases, F.col("k") / 400, F.col("k") / 1200)
    return df.withColumn("v", verdict).select("event_id", F.col("v.pair").alias("pair"), F.col("v.whole").alias("whole"),
                                             F.col("v.single").alias("single"))


def rollup(spark, d):
    df = events(spark, d).withColumn("visible", F.col("k") > 20)
    return Q.snapshot_rollup(df, ["stream_id"], "visible", ["value", "k"])


OFFER = lambda: (F.when(F.col("p_size") <= 5, 29.97).when(F.col("p_size") <= 10, 30.0).when(F.col("p_size") <= 15, 59.94)
                 .when(F.col("p_size") <= 20, 60.0).when(F.col("p_size") == 21, 120.0).otherwise(F.col("p_size").cast("double")))
OFFER_SQL = """CASE WHEN p_size <= 5 THEN 29.97::DOUBLE WHEN p_size <= 10 THEN 30 WHEN p_size <= 15 THEN 59.94
  WHEN p_size <= 20 THEN 60 WHEN p_size = 21 THEN 120 ELSE p_size END"""


def offers(spark, d):
    rates = table(spark, d, "part").select(F.col("p_brand").alias("device_id"), OFFER().alias("rate"))
    selected = rates.select("device_id").distinct().withColumn(
        "selected", F.when(F.substring("device_id", 7, 3).cast("int") % 3 == 0, 30.0)
        .when(F.substring("device_id", 7, 3).cast("int") % 3 == 1, 60.0).otherwise(0.0))
    return rates, selected


OFFERS = f"""offers AS (SELECT DISTINCT p_brand AS device_id, {OFFER_SQL} AS rate FROM part),
sel AS (SELECT DISTINCT device_id, CASE CAST(device_id[7:] AS INT) % 3 WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 60 ELSE 0 END AS selected FROM offers),
flags AS (SELECT device_id, bool_or(rate = 29.97) AND bool_or(rate = 30) AS both30, bool_or(rate = 59.94) AND bool_or(rate = 60) AS both60 FROM offers GROUP BY 1),
kept AS (SELECT device_id, rate, selected FROM offers JOIN sel USING (device_id) JOIN flags USING (device_id)
  WHERE NOT (both30 AND rate = CASE WHEN selected = 30 THEN 29.97 ELSE 30 END) AND NOT (both60 AND rate = CASE WHEN selected = 60 THEN 59.94 ELSE 60 END))"""


def aliases(spark, d):
    rates, selected = offers(spark, d)
    return K.collapse_aliases(K.union_rates(rates), selected, ["device_id"]).select("device_id", "rate")


def shortcuts(spark, d):
    rates, selected = offers(spark, d)
    return K.rate_shortcuts(rates, selected)


def rate_union(spark, d):
    part = table(spark, d, "part")
    a = part.select(F.col("p_brand").alias("device_id"), OFFER().alias("rate"))
    b = part.select(F.col("p_brand").alias("device_id"), (F.col("p_size") - 10).cast("double").alias("rate"))
    return K.union_rates(a, b)


CHECKS = {
    "a3_packet_duration": Check(packet_durations, """
SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(CASE WHEN l_linenumber < 3 AND l_discount - 0.02 > 0 THEN l_discount - 0.02 END,
  CASE WHEN l_tax > 0 THEN floor(l_quantity) / 48000.0 END), 9)::DOUBLE AS duration_s FROM lineitem"""),
    "a4_diagnostics": Check(diagnostics_records, f"""
WITH {EVENTS_SQL} SELECT stream_id, us // {DAY_US // 4} AS tick, CASE WHEN count(*) > 1 THEN max(value) ELSE 0 END AS ratio
FROM ev GROUP BY 1, 2 HAVING tick % 5 = 0"""),
    "a6_fragments": Check(fragments, f"""
WITH {EVENTS_SQL} SELECT stream_id, us // {DAY_US} AS fragment, count(*) AS n_rows, max(event_id) AS last_id FROM ev GROUP BY 1, 2"""),
    "a7_settings": Check(settings_log, f"""
WITH {EVENTS_SQL} SELECT event_id, value AS strength, CASE event_type WHEN 'click' THEN 'off' WHEN 'view' THEN 'off' ELSE event_type END AS mode,
  event_type NOT IN ('click', 'view') AND k > 50 AND k % 2 = 0 AS force, k <= 80 AS skip_duplicates,
  '{SETTING_DEFAULTS["target"]}' AS target, 1.0::DOUBLE AS contrast FROM ev"""),
    "b2_delivery": Check(delivery, f"""
WITH {EVENTS_SQL}, d AS (SELECT stream_id, CASE WHEN event_type IN ('click', 'view') AND k > 10 THEN 'kept' WHEN event_type = 'error' THEN 'dropped' END AS delivery FROM ev)
SELECT stream_id, delivery, count(*) AS count FROM d WHERE delivery IS NOT NULL GROUP BY 1, 2"""),
    "b29_window_catalogue": Check(window_list, """
WITH w AS (SELECT c_custkey AS window_id, CASE WHEN c_nationkey = 3 THEN '' ELSE 'App' || c_nationkey END AS owner,
  CASE WHEN c_nationkey = 7 THEN 'com.apple.dock' ELSE c_mktsegment END AS owner_id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS title,
  c_acctbal / 4 AS w, (c_custkey % 500)::DOUBLE AS h FROM customer)
SELECT window_id, CASE WHEN title = '' THEN owner ELSE title END || ' — ' || owner AS label, CAST(round(w) AS INT) AS width, CAST(round(h) AS INT) AS height
FROM w WHERE owner <> '' AND owner_id NOT IN ('com.apple.dock', 'MACHINERY') AND w >= 160 AND h >= 120"""),
    "b30_auto_device": Check(auto_choice, """
WITH p AS (SELECT s_nationkey AS host_id, max(s_suppkey) * 10 AS preferred_id FROM supplier GROUP BY 1),
c AS (SELECT c_nationkey AS host_id, c_custkey AS device_id, coalesce(c_custkey = preferred_id, FALSE) AS saved FROM customer
  LEFT JOIN p ON p.host_id = c_nationkey WHERE c_acctbal > 0 AND c_mktsegment = 'FURNITURE')
SELECT host_id, device_id FROM c QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY saved DESC, device_id) = 1"""),
    "d1_tick_counters": Check(tick_report, f"""
WITH {EVENTS_SQL}, t AS (SELECT stream_id, us // {DAY_US} AS tick, (max(us) - min(us)) / 1000000000.0::DOUBLE AS elapsed_s,
""" + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in KINDS) + " FROM ev GROUP BY 1, 2) SELECT *, "
        + ", ".join(f"CASE WHEN elapsed_s > 0 THEN CAST(round(n_{k} / elapsed_s) AS BIGINT) END AS fps_{k}" for k in KINDS) + " FROM t"),
    "d2_cost_summary": Check(supplier_costs, """
WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS i,
  count(*) OVER (PARTITION BY l_suppkey) AS n, avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS m FROM lineitem)
SELECT l_suppkey, round(m, 6) AS mean, v AS p95, n FROM r WHERE i = least(n - 1, floor(n * 0.95::DOUBLE))"""),
    "d3_interval_p95": Check(presentation_tails, f"""
WITH {EVENTS_SQL}, i AS (SELECT *, us - lag(us) OVER ({W}) AS step FROM ev),
l AS (SELECT event_id, list_sort(list(step) FILTER (WHERE step > 0) OVER ({W} ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) AS v FROM i)
SELECT event_id, coalesce(v[CAST(floor((len(v) - 1) * 0.95::DOUBLE) AS INT) + 1], 0) AS interval_p95 FROM l"""),
    "d4_acceptance_p95": Check(acceptance_tails, """
WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity))
SELECT l_returnflag, l_linestatus, v AS p95, n FROM r WHERE i = ceil(n * 0.95::DOUBLE) - 1"""),
    "d4_selected_tails": Check(selected_tails, """
WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n
  FROM lineitem WHERE l_extendedprice IS NOT NULL WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice))
SELECT l_returnflag, l_linestatus, n, max(v) FILTER (WHERE i = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95_floor_n,
  max(v) FILTER (WHERE i = floor((n - 1) * 0.95::DOUBLE)) AS p95_floor_n_minus_1, max(v) FILTER (WHERE i = ceil(n * 0.95::DOUBLE) - 1) AS p95_ceil_n_minus_1
FROM r GROUP BY ALL"""),
    "d8_format_catalogue": Check(catalogue, f"""
WITH {FORMATS}, f AS (SELECT *, CASE WHEN format_idx % 3 = 0 THEN hi * 2 ELSE hi END AS top, CASE WHEN format_idx % 3 = 0 THEN 2 ELSE 1 END AS nr,
  pixel_format = '420v' AS nv FROM formats)
SELECT device_id, width, height, arg_max(format_idx, (top, nv, CASE WHEN nv THEN format_idx ELSE -format_idx END)) AS format_idx,
  CAST(min(lo) AS INT) AS min_fps, CAST(max(top) AS INT) AS max_fps, CAST(sum(nr) AS BIGINT) AS n_ranges FROM f GROUP BY 1, 2, 3"""),
    "d8_format_ranges": Check(catalogue_ranges, f"""
WITH {FORMATS} SELECT device_id, width, height, format_idx, 0 AS pos, lo, hi FROM formats UNION ALL
SELECT device_id, width, height, format_idx, 1, lo, hi * 2 FROM formats WHERE format_idx % 3 = 0"""),
    "d9_advertised_rates": Check(advertised, f"""
WITH {FORMATS}, pts AS (SELECT unnest([20, 24, 25, 29.97, 30, 40, 45, 48, 50, 59.94, 60, 90, 100, 120, 144]::DOUBLE[]) AS p)
SELECT DISTINCT device_id, round(p * 100) / 100 AS rate FROM formats, pts WHERE hi - lo >= 0.01 AND p BETWEEN lo AND hi
UNION SELECT device_id, round(hi * 100) / 100 FROM formats UNION SELECT device_id, round(lo * 100) / 100 FROM formats WHERE hi - lo >= 0.01
UNION SELECT device_id, 0.0 FROM formats"""),
    "d10_level_peak": Check(levels, f"WITH {EVENTS_SQL} SELECT stream_id, us // {DAY_US} AS slot, max(value) AS peak FROM ev GROUP BY 1, 2"),
    "d11_pair_structure": Check(order_structure, """
WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = 3) AS endpoints, count(*) FILTER (WHERE l_linenumber <> 3) AS generated,
  count(DISTINCT l_shipdate) FILTER (WHERE l_linenumber <> 3) AS times, max(l_shipdate) FILTER (WHERE l_linenumber <> 3) AS last,
  max(l_shipdate) FILTER (WHERE l_linenumber = 3) AS e FROM lineitem GROUP BY 1)
SELECT l_orderkey, endpoints, generated, CASE WHEN endpoints = 0 THEN 'no_endpoint' WHEN endpoints > 1 THEN 'bad_order' WHEN generated < 2 THEN 'incomplete'
  WHEN generated > 2 THEN 'bad_order' WHEN times = 2 AND last < e THEN 'complete' ELSE 'bad_order' END AS verdict FROM g"""),
    "d12_distinct_presented": Check(presented, f"""
WITH {EVENTS_SQL}, s AS (SELECT *, us // {DAY_US} + k % 3 AS seq FROM ev),
t AS (SELECT *, max(seq) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s)
SELECT stream_id, count(*) FILTER (WHERE top IS NULL OR seq > top) AS presented, count(*) FILTER (WHERE seq <= top) AS repeats FROM t GROUP BY 1"""),
    "d12_presented_sketch": Check(sketched, f"""
WITH {EVENTS_SQL}, e AS (SELECT unnest([stream_id, -1]) AS stream_id, us FROM ev)
SELECT stream_id, count(DISTINCT us) AS presented, TRUE AS within FROM e GROUP BY 1"""),
    "d13_acceptance": Check(acceptance_verdicts, f"""
WITH {EVENTS_SQL}, i AS (SELECT *, (us - lag(us) OVER ({W})) / 1e6 AS iv, us // {5 * DAY_US} AS win, event_type IN ('click', 'view', 'error') AS made FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, win ORDER BY iv) - 1 AS r, count(iv) OVER (PARTITION BY stream_id, win) AS n FROM i),
a AS (SELECT stream_id, win, count(*) FILTER (WHERE NOT made) / 5.0::DOUBLE AS source_fps, count(*) FILTER (WHERE made) / 5.0::DOUBLE AS generated_fps,
  count(*) / 5.0::DOUBLE AS output_fps, max(CASE WHEN r = ceil(n * 0.95::DOUBLE) - 1 THEN iv END) AS p95 FROM r GROUP BY 1, 2)
SELECT stream_id, win, round(source_fps, 6) AS source_fps, round(generated_fps, 6) AS generated_fps, round(output_fps, 6) AS output_fps, round(p95, 6) AS p95,
  source_fps BETWEEN 0.5 AND 1.2 AND generated_fps BETWEEN 0.8 AND 2.5 AND output_fps BETWEEN 1.5 AND 3.0 AND coalesce(p95 <= 150000, FALSE) AS passed FROM a"""),
    "d14_ingress_health": Check(ingress, f"""
WITH {EVENTS_SQL}, s AS (SELECT *, CASE WHEN k <> 50 THEN us + CASE WHEN k = 51 THEN -{DAY_US} ELSE 0 END END AS pts, us // {7 * DAY_US} AS sample FROM ev),
p AS (SELECT *, CASE WHEN lag(sample) OVER ({W}) = sample THEN pts - lag(pts) OVER ({W}) END AS step FROM s)
SELECT stream_id, sample, count(*) AS n_rows, count(pts) AS n_pts, coalesce(count(*) >= 10 AND count(pts) = count(*)
  AND max(CASE WHEN k = 52 THEN 1 ELSE 0 END) = min(CASE WHEN k = 52 THEN 1 ELSE 0 END) AND min(step) > 0
  AND (sample + 1) * 7 * 86400.0::DOUBLE - max(us / 1e6) <= 86400, FALSE) AS healthy FROM p GROUP BY 1, 2"""),
    "d17_over_budget": Check(overload, f"""
WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY us, event_id) AS n, k / 400 AS period, k / 1200 AS slot,
  CASE WHEN event_type IN ('click', 'view') THEN 'batch' WHEN event_type = 'error' THEN 'later' ELSE 'endpoint' END AS kind FROM ev),
l AS (SELECT *,
  list_sort(coalesce(list(value / 1000) FILTER (WHERE kind = 'batch') OVER (PARTITION BY stream_id ORDER BY us, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), [])) AS b,
  list_sort(coalesce(list(value / 1000) FILTER (WHERE kind = 'later') OVER (PARTITION BY stream_id ORDER BY us, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), [])) AS l,
  list_sort(coalesce(list(value / 1000) FILTER (WHERE kind = 'endpoint') OVER (PARTITION BY stream_id ORDER BY us, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), [])) AS e FROM n),
a AS (SELECT *, CASE WHEN len(b) >= 6 THEN b[len(b) // 2 + 1] END AS ab, b[least(len(b) - 1, CAST(floor(len(b) * 0.95::DOUBLE) AS BIGINT)) + 1] AS tb, CASE WHEN len(l) >= 6 THEN l[len(l) // 2 + 1] END AS al, l[least(len(l) - 1, CAST(floor(len(l) * 0.95::DOUBLE) AS BIGINT)) + 1] AS tl, CASE WHEN len(e) >= 6 THEN e[len(e) // 2 + 1] END AS ae, e[least(len(e) - 1, CAST(floor(len(e) * 0.95::DOUBLE) AS BIGINT)) + 1] AS te FROM l),
v AS (SELECT *, coalesce(period > 0 AND ab <= 1 / 3 * period * 1.5::DOUBLE AND al <= (2 / 3 - 1 / 3) * period * 0.9::DOUBLE
    AND ae <= (1 - 2 / 3) * period * 0.9::DOUBLE AND ab + al + ae <= period * 0.9::DOUBLE, FALSE) AS fits,
  coalesce(ab, tb, 0) + coalesce(ae, te, 0) + coalesce(al, tl, 0) AS known, CASE kind WHEN 'batch' THEN ab WHEN 'later' THEN al ELSE ae END AS own FROM a)
SELECT event_id, n > 2 AND slot > 0 AND ab IS NOT NULL AND al IS NOT NULL AND ae IS NOT NULL AND NOT fits AS pair, n > 2 AND period > 0 AND known > period AS whole,
  n > 2 AND slot > 0 AND coalesce(own, 0) > slot * CASE kind WHEN 'batch' THEN 1.5::DOUBLE ELSE 0.9::DOUBLE END AS single FROM v"""),
    "d18_snapshot_rollup": Check(rollup, f"""
WITH {EVENTS_SQL} SELECT stream_id, count(*) AS n_visible, min(value) AS min_value, max(value) AS max_value, min(k) AS min_k, max(k) AS max_k
FROM ev WHERE k > 20 GROUP BY 1"""),
    "w17_gated_cost": Check(gated, f"""
WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY stream_id, event_type ORDER BY us, event_id)),
l AS (SELECT event_id, n, list_sort(coalesce(list(value) FILTER (WHERE n > 2) OVER (PARTITION BY stream_id, event_type ORDER BY us, event_id
  ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), [])) AS v FROM n),
a AS (SELECT *, v[least(len(v) - 1, CAST(floor(len(v) * 0.95::DOUBLE) AS BIGINT)) + 1] AS tail FROM l)
SELECT event_id, CASE WHEN len(v) >= 16 THEN tail WHEN len(v) >= 6 THEN v[len(v) // 2 + 1] END AS admission,
  CASE WHEN len(v) >= 16 OR len(v) < 6 THEN tail ELSE v[len(v) // 2 + 1] END AS estimate, n > 2 AS warm FROM a"""),
    "k1_rate_shortcuts": Check(shortcuts, f"""
WITH {OFFERS}, o AS (SELECT *, CASE WHEN rate = selected THEN 0 WHEN rate IN (29.97, 30) THEN 1 WHEN rate = 50 THEN 2 WHEN rate IN (59.94, 60) THEN 3
  WHEN rate = max(CASE WHEN rate >= 90 THEN rate END) OVER (PARTITION BY device_id) THEN 4 ELSE 5 END AS pri FROM kept)
SELECT device_id, rate FROM o QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY pri, rate) <= 4"""),
    "k2_area_order": Check(lambda spark, d: K.order_by_area(K.format_catalogue(nested_formats(spark, d))).select("device_id", "width", "height"), f"""
WITH {FORMATS} SELECT DISTINCT device_id, width, height FROM formats"""),
    "u1_union_rates": Check(rate_union, f"""
SELECT p_brand AS device_id, {OFFER_SQL} AS rate FROM part UNION SELECT p_brand, (p_size - 10)::DOUBLE FROM part WHERE p_size > 10"""),
    "u2_collapse_aliases": Check(aliases, f"WITH {OFFERS} SELECT device_id, rate FROM kept"),
}
CHECKS["d13_acceptance_gate"] = Check(acceptance_gates, f"""
SELECT stream_id, count(*) FILTER (WHERE passed) AS n_passed, count(*) AS n_windows, count(*) FILTER (WHERE passed) >= 3 AS accepted
FROM ({CHECKS["d13_acceptance"].sql}) GROUP BY 1""")
