"""Boundary values of rates, sizes, budgets and catalogues."""

import duckdb
import pytest
from compare import differences
from pyspark.sql import functions as F

from cadencekit.checks import scalars
from cadencekit.functions import costs, rates, sizes, values
from cadencekit.operators import catalog as K
from cadencekit.operators.ordered import ordered
from cadencekit.operators.pairing import pair_period
from cadencekit.operators.quality import interval_p95, pair_structure
from cadencekit.operators.rates import delivered_rate

NAN, INF = float("nan"), float("inf")


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lit(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize("rate,snapped", [(29.97, 29.97), (30.4, 30.0), (37.5, 37.5), (59.4, 59.94), (47.5, 48.0),
                                          (35.0, 35.0), (NAN, None), (INF, None), (0.0, None), (200.0, 200.0)])
def test_snap(spark, rate, snapped):
    assert one(spark, rates.snap_rate(lit(rate)))[0] == snapped


def test_ranges(spark):
    got = one(spark, *[rates.nominal_rate(lit(x)) for x in (19.49, 19.5, 60.25, 60.26, NAN)],
              *[rates.sampling_rate(lit(x)) for x in (9.99, 10, 240, 240.1, INF)])
    assert got == (None, 19.5, 60.0, None, None, None, 10.0, 240.0, None, None)
    assert one(spark, rates.bounded_rate(lit(61), lit(60)), rates.bounded_rate(lit(24), lit(NAN)),
               rates.bounded_rate(lit(None), lit(60))) == (60.0, 24.0, None)


@pytest.mark.parametrize("content,target,display,step", [
    (30, 60, 60, 2), (20, 60, 60, 3), (24.9, 60, 75, 3), (25, 60, 120, 2), (60, 60, 60, 1), (60, 120, 120, 2),
    (20, NAN, 60, 3), (NAN, 60, 60, 1), (29.97, 60, 60, 2), (20.17, 60, 60, 2 if 20.17 * 3 > 60.5 else 3)])
def test_step(spark, content, target, display, step):
    assert one(spark, rates.choose_step(lit(content), lit(target), lit(display)))[0] == step


def test_fit_and_phases(spark):
    got = one(spark, rates.fit_step(lit(3), lit(1 / 60), lit(120)), rates.fit_step(lit(3), lit(1 / 60), lit(60)),
              rates.fit_step(lit(3), lit(1 / 20), lit(60)), rates.fit_step(lit(NAN), lit(1 / 20), lit(60)),
              rates.phases(lit(2)), rates.phases(lit(3)), rates.phases(lit(2.4)), rates.phases(lit(4)))
    assert got == (2, 1, 3, 1, [0.5], [1 / 3, 2 / 3], [], [])


def test_sizes(spark):
    def size(w, h, mode, rate):
        return sizes.target_size(F.lit(w), F.lit(h), F.lit(mode), lit(rate))
    got = one(spark, size(1920, 1080, "efficient", 30), size(1920, 1080, "efficient", 60), size(1080, 1920, "balanced", 60),
              size(640, 480, "quality", 60), size(3840, 2160, "flow", 60), size(1920, 1080, "flow", 60), size(1920, 1, "flow", 30),
              size(1920, 1080, "off", 30))
    assert [tuple(x) if x else None for x in got] == [
        (1280, 720), (960, 540), (720, 1280), (640, 480), (1280, 720), (1920, 1080), None, None]
    got = one(spark, sizes.pixel_size(lit(800), lit(500), lit(2)), sizes.pixel_size(lit(3000), lit(1000), lit(2)),
              sizes.pixel_size(lit(0), lit(5), lit(1)), sizes.pixel_size(lit(101), lit(51), lit(NAN)))
    assert [tuple(x) for x in got] == [(1600, 1000), (3840, 1280), (0, 0), (100, 50)]


def test_budgets(spark):
    half, thirds = F.array(lit(0.5)), F.array(lit(1 / 3), lit(2 / 3))
    fit = lambda b, later, e, ph, p: costs.costs_fit(lit(b), lit(later), lit(e), ph, lit(p))
    assert one(spark, fit(0.010, None, 0.005, half, 1 / 30), fit(0.026, None, 0.005, half, 1 / 30),
               fit(0.010, None, 0.001, thirds, 0.05), fit(0.010, 0.010, 0.010, thirds, 0.05),
               fit(0.010, 0.016, 0.010, thirds, 0.05), fit(NAN, None, 0.001, half, 0.05),
               fit(0.01, 0.01, 0.01, F.reverse(thirds), 0.05)) == (True, False, False, True, False, False, False)
    admit = lambda b, force, ok: costs.admit_pair(lit(b), lit(None), lit(0.0), half, lit(0.02), F.lit(force), F.lit(ok))
    assert one(spark, admit(1, True, True), admit(1, False, True), admit(0.001, False, True), admit(1, True, False),
               admit(INF, True, True)) == (True, False, True, False, False)
    assert one(spark, costs.processing_cost(lit(1), lit(2), lit(2.5)), costs.processing_cost(lit(-1), lit(2), lit(2)),
               costs.pair_cost(lit(1), lit(None), lit(1), F.lit(1)), costs.pair_cost(lit(1), lit(None), lit(1), F.lit(2)),
               costs.kept_cooldown(F.lit(True), F.lit(False), F.lit(True), lit(9), lit(5)),
               costs.kept_cooldown(F.lit(True), F.lit(True), F.lit(True), lit(9), lit(5))) == (3.0, INF, 2.0, None, 9.0, 0.0)


def test_processing_cost_follows_its_sql(spark, tmp_path):
    """Only the first part has to be valid; a missing tax leaves the span."""
    odd = [None, NAN, INF, -INF, -0.5, 0.0, 0.0123456]
    rows = [(n, n % 7 + 1, tax, discount) for n in range(3, 7) for tax in odd for discount in [*odd, 0.03, 0.07]]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_tax double, l_discount double")
    df = df.selectExpr("*", "1L AS l_partkey", "1L AS l_suppkey", "1d AS l_quantity", "1d AS l_extendedprice", "'A' AS l_returnflag", "'O' AS l_linestatus")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    check = scalars.CHECKS["b25_processing_cost"]
    assert differences(check.run(spark, str(tmp_path)), con, check.sql) == []


def test_pair_period(spark):
    def period(ticks, hz, fps=None, fresh=True, unique=True, end=0.99):
        return F.round(pair_period(lit(1), lit(1 + ticks / hz), lit(hz), lit(fps), lit(1 + end * ticks / hz), F.lit(fresh), F.lit(unique)), 6)
    got = one(spark, period(1, 60), period(2, 60), period(3, 60), period(4, 60), period(1.5, 60), period(6, 120, 20),
              period(6, 120), period(6, 120, 20, fresh=False), period(6, 120, 20, unique=False), period(2, 120),
              period(6, 120, 20, end=1.5), period(13, 120, 20))
    assert got == (0.016667, 0.033333, 0.05, None, None, 0.05, None, None, None, None, None, None)


def test_values(spark):
    got = one(spark, values.fourcc(F.lit(875704438)), values.fourcc(F.lit(0xFF000000)), values.rational_ns(F.lit(1001), F.lit(30000)),
              values.rational_ns(F.lit(-1), F.lit(2)), values.rational_ns(F.lit(2**62), F.lit(2**31 - 1)), values.rational_ns(F.lit(1), F.lit(0)),
              values.mix(lit(1), lit(3), lit(0.25)), values.mix(lit(1), lit(3), lit(-1)), values.mix(lit(1), lit(3), lit(2)),
              values.smoothstep(0, 1, lit(0.5)), rates.rate_label(lit(29.97)), rates.rate_label(lit(60)))
    assert got == ("420v", "—", 33366667, -500000000, round(2**62 * 10**9 / (2**31 - 1)), None, 1.5, 1.0, 3.0, 0.5, "29.97", "60")


def test_delivered_rate(spark):
    lists = {"few": [1 / 120] * 7, "good": [1 / 120] * 8, "late": [1 / 60] * 9 + [1 / 30] + [1 / 60] * 2,
             "mixed": [1 / 60, 1 / 40] * 6, "switched": [1 / 60] * 9 + [1 / 30] * 3}
    df = spark.createDataFrame([(k, i, x) for k, v in lists.items() for i, x in enumerate(v)], "k string, i long, interval_s double")
    out = delivered_rate(ordered(df, ["k"], ["i"])).done()
    got = {r.k: r.fps for r in out.groupBy("k").agg(F.max_by("delivered_fps", "i").alias("fps")).collect()}
    assert got["few"] is None and got["mixed"] is None and got["switched"] is None
    assert got["good"] == pytest.approx(120) and got["late"] == pytest.approx(60)


def test_shortcuts(spark):
    offers = {"a": ([29.97, 30, 50, 59.94, 60, 120], 0.0), "b": ([20, 30, 40, 50, 60], 40.0), "c": ([29.97, 30, 60], 30.0), "d": ([NAN, -1.0, 25], 0.0)}
    df = spark.createDataFrame([(k, float(r)) for k, (v, _) in offers.items() for r in v], "device_id string, rate double")
    chosen = spark.createDataFrame([(k, s) for k, (_, s) in offers.items()], "device_id string, selected double")
    got = {}
    for r in K.rate_shortcuts(df, chosen).collect():
        got.setdefault(r.device_id, []).append(r.rate)
    assert {k: sorted(v) for k, v in got.items()} == {
        "a": [29.97, 50, 59.94, 120], "b": [30, 40, 50, 60], "c": [30, 60], "d": [25]}


def test_next_rate_and_overlap(spark, rows):
    rates_df = spark.createDataFrame([("a", 20.0), ("a", 25.0), ("b", 29.97), ("b", 59.94)], "device_id string, rate double")
    asked = spark.createDataFrame([("a", 30.0), ("b", 30.0), ("b", 29.975)], "device_id string, content_fps double")
    assert rows(K.next_rate(asked, rates_df, ["device_id"]), "content_fps", "target_rate") == [
        (29.975, 29.97), (30.0, 25.0), (30.0, 59.94)]
    displays = spark.createDataFrame([(1, 0.0, 0.0, 1920.0, 1080.0), (2, 1920.0, 0.0, 2560.0, 1440.0)], "display_id long, x double, y double, w double, h double")
    windows = spark.createDataFrame([(1, 1800.0, 0.0, 400.0, 300.0), (2, 1720.0, 0.0, 400.0, 300.0), (3, 0.0, 0.0, 0.0, 5.0), (4, -900.0, -900.0, 100.0, 100.0)],
                                    "window_id long, x double, y double, w double, h double")
    assert rows(K.largest_overlap(windows, displays), "window_id", "display_id") == [(1, 2), (2, 2), (3, None), (4, None)]


def test_match_format(spark, rows):
    formats = spark.createDataFrame([("d", 0, 64, 48, 10.0, 20.0), ("d", 1, 64, 48, 24.0, 30.0), ("d", 2, 64, 48, 25.0, 60.0), ("d", 3, 32, 24, 60.0, 60.0)],
                                    "device_id string, format_idx int, width int, height int, lo double, hi double")
    asked = spark.createDataFrame([("d", 0.0, 0), ("d", 15.0, 0), ("d", 29.0, 0), ("d", 30.009, 0), ("d", 45.0, 1), ("d", 22.0, 0), ("d", 60.0, 3)],
                                  "device_id string, rate double, format_idx int")
    assert rows(K.match_format(asked, formats), "rate", "chosen_idx", "supported") == [
        (0.0, 0, True), (15.0, 0, True), (22.0, 0, False), (29.0, 1, True), (30.009, 1, True), (45.0, 2, True), (60.0, 3, True)]


def test_pair_structure_and_tail(spark, rows):
    cases = {1: [(1, 1), (2, 1), (3, 0)], 2: [(1, 1), (2, 0)], 3: [(1, 1), (2, 1), (3, 1), (4, 0)], 4: [(1, 1), (4, 1), (3, 0)], 5: [(1, 1)], 6: [(1, 0), (2, 0)]}
    df = spark.createDataFrame([(k, t, bool(g)) for k, v in cases.items() for t, g in v], "seq long, t long, generated boolean")
    assert rows(pair_structure(df, ["seq"], "t", "generated"), "seq", "verdict") == [
        (1, "complete"), (2, "incomplete"), (3, "bad_order"), (4, "bad_order"), (5, "no_endpoint"), (6, "bad_order")]
    redraw = spark.createDataFrame([(0, 1.0), (1, 1 + 1 / 120), (2, 1.0)], "i long, t double")
    out = interval_p95(ordered(redraw.withColumn("k", F.lit(1)), ["k"], ["i"]), "t").done()
    assert [r.interval_p95 for r in out.orderBy("i").collect()] == pytest.approx([0, 1 / 120, 1 / 120])


def test_blends_keep_the_sign_of_a_zero(spark, tmp_path):
    """A tiny negative component rounds to a negative zero, as in SQL."""
    rows = [(0, [-1e-7, 0.5, 1e-7]), (1, [-0.0, 0.0, -4.9e-7]), (2, [float("nan"), INF, -INF]), (3, [None, -2.5, 1.5]), (4, []), (5, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    check = scalars.CHECKS["g2_value_blend"]
    assert differences(check.run(spark, str(tmp_path)), con, check.sql) == []
