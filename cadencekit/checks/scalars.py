"""Checks of the column helpers, as projections over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadencekit.checks.base import Check, r6, table
from cadencekit.functions import costs, rates, sizes, values

NAN, INF = float("nan"), float("inf")


def lines(spark, sf_dir):
    """Line items read as rate measurements with a target, a display and some bad values."""
    q = F.col("l_quantity") * (1 + F.col("l_tax") + F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_suppkey", "l_partkey",
        q.alias("rate"),
        F.when(F.col("l_linenumber") == 1, NAN).when(F.col("l_linenumber") == 2, INF)
        .when(F.col("l_linenumber") == 3, -INF).otherwise(F.col("l_discount") - 0.03).alias("odd"),
        F.when(F.col("l_returnflag") == "A", 30.0).when(F.col("l_returnflag") == "N", 60.0)
        .otherwise(0.0).alias("target"),
        F.when(F.col("l_linestatus") == "O", 60.0).otherwise(120.0).alias("display"),
        (F.col("l_linenumber") > 3).alias("flag"))


LINES = """
WITH lines AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice, l_returnflag,
    l_linestatus, l_suppkey, l_partkey, l_quantity * (1 + l_tax + l_discount) AS rate,
    CASE l_linenumber WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE
      WHEN 3 THEN '-Infinity'::DOUBLE ELSE l_discount - 0.03 END AS odd,
    CASE l_returnflag WHEN 'A' THEN 30.0::DOUBLE WHEN 'N' THEN 60.0 ELSE 0.0 END AS target,
    CASE l_linestatus WHEN 'O' THEN 60.0::DOUBLE ELSE 120.0 END AS display,
    l_linenumber > 3 AS flag
  FROM lineitem)
"""
KEYS = ("l_orderkey", "l_linenumber", "l_partkey")


def _line_check(sql: str, **columns) -> Check:
    """Projection over the line view; ``columns`` maps output names to column builders."""
    def run(spark, sf_dir):
        return lines(spark, sf_dir).select(*KEYS, *[make().alias(n) for n, make in columns.items()])
    return Check(run, f"{LINES} SELECT {', '.join(KEYS)}, {sql} FROM lines")


def _size(struct_maker):
    def run(spark, sf_dir):
        df = lines(spark, sf_dir).withColumn("size", struct_maker())
        return df.select(*KEYS, F.col("size.width").alias("out_w"), F.col("size.height").alias("out_h"))
    return run


# Picture sizes and modes derived from the line view.
W_COL = lambda: (F.col("l_extendedprice") / 25).cast("int")
H_COL = lambda: (F.col("l_extendedprice") / 40).cast("int")
W_SQL, H_SQL = "CAST(trunc(l_extendedprice / 25) AS INT)", "CAST(trunc(l_extendedprice / 40) AS INT)"
MODE = lambda: (F.when(F.col("l_linenumber") <= 2, "efficient").when(F.col("l_linenumber") <= 4, "flow")
                .when(F.col("l_linenumber") == 5, "quality").otherwise("off"))
MODE_SQL = ("CASE WHEN l_linenumber <= 2 THEN 'efficient' WHEN l_linenumber <= 4 THEN 'flow' "
            "WHEN l_linenumber = 5 THEN 'quality' ELSE 'off' END")
CAP_SQL = f"""CASE {MODE_SQL} WHEN 'efficient' THEN CASE WHEN rate > 40 THEN 960 ELSE 1280 END
  WHEN 'flow' THEN CASE WHEN rate > 40 AND greatest({W_SQL}, {H_SQL}) > 1920 THEN 1280 ELSE 1920 END
  WHEN 'quality' THEN 1920 END"""

SNAP_SQL = """(WITH s AS (SELECT unnest([20, 23.976, 24, 25, 29.97, 30, 40, 45, 48, 50, 59.94, 60]::DOUBLE[]) AS v)
  SELECT CASE WHEN min(abs(v - rate)) <= greatest(0.15, rate * 0.015) THEN arg_min(v, (abs(v - rate), v)) ELSE rate END FROM s)"""

def cost_lines(spark, sf_dir):
    """Line items read as command costs in seconds, with the phases of two- and three-step pairs."""
    df = lines(spark, sf_dir).withColumns({
        "batch": F.col("l_discount") / 5, "endp": F.col("l_tax") / 20, "period": 1 / F.col("l_quantity"),
        "later": F.when(F.col("l_linenumber") != 7, F.col("l_tax") / 10),
        "step": F.when(F.col("l_linenumber") % 2 == 0, 2.0).otherwise(3.0)})
    return df.withColumn("phases", rates.phases("step"))


COST_CTE = LINES + """, c AS (
  SELECT *, l_discount / 5 AS batch, CASE WHEN l_linenumber <> 7 THEN l_tax / 10 END AS later,
    l_tax / 20 AS endp, 1 / l_quantity AS period, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 3 END AS step
  FROM lines), fit AS (
  SELECT *, coalesce(batch <= 1 / step::DOUBLE * period * 1.5
      AND (step = 2 OR later <= (2 / 3::DOUBLE - 1 / 3::DOUBLE) * period * 0.9)
      AND endp <= (1 - (step - 1) / step::DOUBLE) * period * 0.9
      AND batch + CASE step WHEN 3 THEN later ELSE 0 END + endp <= period * 0.9, FALSE) AS fits FROM c)
"""


def _cost_check(sql, **columns):
    def run(spark, sf_dir):
        return cost_lines(spark, sf_dir).select(*KEYS, *[make().alias(n) for n, make in columns.items()])
    return Check(run, f"{COST_CTE} SELECT {', '.join(KEYS)}, {sql} FROM fit")


def rational_times(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("scale", (F.col("o_custkey") * 7 % 90001).cast("int"))
    return df.select("o_orderkey", values.rational_ns("o_orderkey", "scale").alias("pts_ns"))


def audio_levels(spark, sf_dir):
    channels = F.array(-F.col("l_quantity") * 2, -F.col("l_extendedprice") / 700)
    return lines(spark, sf_dir).select(*KEYS, r6(values.db_to_level(channels)).alias("level"))


def codes(spark, sf_dir):
    code = F.col("p_partkey") * 2654435761 % 4294967296
    return table(spark, sf_dir, "part").select("p_partkey", values.fourcc(code).alias("code"))


def embedding_mix(spark, sf_dir):
    """Blend each vector with its own mirror at three phases."""
    df = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("a"), F.explode(
            F.array(F.lit(0.0), F.lit(0.25), F.lit(1.0))).alias("phase"))
    blended = values.mix_arrays("a", F.reverse("a"), "phase")
    return df.select("vec_id", "phase", F.transform(blended, r6).alias("blend"))


def ramps(spark, d):
    """Ramps up, down and of no width to speak of, over the line items' prices."""
    x = F.col("l_extendedprice") / 1000
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(values.smoothstep(10, 60, x)).alias("up"), r6(values.smoothstep(0.06, 0.02, "l_discount")).alias("down"),
        r6(values.smoothstep(24.99, 25.01, "l_quantity")).alias("steep"))


CHECKS = {
    "f2_smoothstep": Check(ramps, """
WITH u AS (SELECT l_orderkey, l_linenumber, least(1.0, greatest(0.0, (l_extendedprice / 1000 - 10) / 50.0::DOUBLE)) AS a,
  least(1.0, greatest(0.0, (l_discount - 0.06::DOUBLE) / (0.02::DOUBLE - 0.06::DOUBLE))) AS b,
  least(1.0, greatest(0.0, (l_quantity - 24.99::DOUBLE) / (25.01::DOUBLE - 24.99::DOUBLE))) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a * a * (3 - 2 * a), 6) AS up, round(b * b * (3 - 2 * b), 6) AS down, round(c * c * (3 - 2 * c), 6) AS steep FROM u"""),
    "a2_rational_time": Check(rational_times, """
SELECT o_orderkey, CASE WHEN s > 0 THEN o_orderkey // s * 1000000000
  + CAST(round(o_orderkey % s * 1e9 / s) AS BIGINT) END AS pts_ns
FROM (SELECT o_orderkey, o_custkey * 7 % 90001 AS s FROM orders)"""),
    "b1_finite_positive": _line_check(
        "CASE WHEN isfinite(odd) AND odd > 0 THEN round(odd, 6) END AS v",
        v=lambda: r6(rates.finite_pos("odd"))),
    "b3_supported_layout": _line_check(
        """coalesce((l_linestatus || l_returnflag) IN ('OA', 'OR') AND l_linenumber = 2
             OR (l_linestatus || l_returnflag) = 'FN' AND l_linenumber = 4, FALSE) AS ok""",
        ok=lambda: sizes.supported_layout(
            F.when((F.col("l_linestatus") == "O") & F.col("l_returnflag").isin("A", "R"), "420v")
            .when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N"), "BGRA").otherwise("2vuy"),
            F.when(F.col("l_linenumber") == 4, 0).otherwise(F.col("l_linenumber")))),
    "b4_sampling_range": _line_check(
        "CASE WHEN rate * 5 BETWEEN 10 AND 240 THEN round(rate * 5, 6) END AS v",
        v=lambda: r6(rates.sampling_rate(F.col("rate") * 5))),
    "b5_content_range": _line_check(
        "CASE WHEN rate * 1.2 BETWEEN 19.5 AND 60.25 THEN round(least(rate * 1.2, 60), 6) END AS v",
        v=lambda: r6(rates.nominal_rate(F.col("rate") * 1.2))),
    "b6_bounded_rate": _line_check(
        "CASE WHEN isfinite(odd) AND odd > 0 THEN round(least(rate, odd * 1000), 6) ELSE round(rate, 6) END AS v",
        v=lambda: r6(rates.bounded_rate("rate", F.col("odd") * 1000))),
    "b7_snap_rate": _line_check(f"round({SNAP_SQL}, 6) AS v", v=lambda: r6(rates.snap_rate("rate"))),
    "b8_target_size": Check(
        _size(lambda: sizes.target_size(W_COL(), H_COL(), MODE(), "rate")),
        f"""{LINES}, s AS (SELECT *, {W_SQL} AS w, {H_SQL} AS h, {CAP_SQL} AS cap FROM lines),
        f AS (SELECT *, least(1.0, cap::DOUBLE / greatest(w, h)) AS sc FROM s),
        o AS (SELECT *, CAST(floor(w * sc / 2) * 2 AS INT) AS ow, CAST(floor(h * sc / 2) * 2 AS INT) AS oh FROM f)
        SELECT {', '.join(KEYS)}, CASE WHEN cap IS NOT NULL AND w >= 2 AND h >= 2 AND ow >= 2 AND oh >= 2 THEN ow END AS out_w,
        CASE WHEN cap IS NOT NULL AND w >= 2 AND h >= 2 AND ow >= 2 AND oh >= 2 THEN oh END AS out_h FROM o"""),
    "b9_size_ladder": _line_check(
        f"""CASE WHEN {W_SQL} > 1280 THEN 1280 WHEN {W_SQL} > 960 THEN 960 WHEN {W_SQL} > 854 THEN 854 END AS down,
        CASE WHEN {W_SQL} < 640 THEN 640 WHEN {W_SQL} < 854 THEN 854 WHEN {W_SQL} < 960 THEN 960
             WHEN {W_SQL} < 1280 THEN 1280 END AS up,
        CASE {MODE_SQL} WHEN 'efficient' THEN CASE WHEN rate > 40 THEN 960 ELSE 1280 END
             WHEN 'flow' THEN CASE WHEN rate > 40 THEN 1280 ELSE 1920 END WHEN 'quality' THEN 1920 END AS top""",
        down=lambda: sizes.rung_down(W_COL()), up=lambda: sizes.rung_up(W_COL()),
        top=lambda: sizes.ceiling(MODE(), "rate")),
    "b10_pixel_size": Check(
        _size(lambda: sizes.pixel_size(W_COL(), H_COL(), F.col("l_linenumber") / 2)),
        f"""{LINES}, s AS (SELECT *, {W_SQL}::DOUBLE AS w, {H_SQL}::DOUBLE AS h FROM lines),
        f AS (SELECT *, least(greatest(1.0::DOUBLE, l_linenumber / 2), 3840.0 / greatest(w, 1.0)) AS sc FROM s)
        SELECT {', '.join(KEYS)}, greatest(2, CAST(floor(w * sc / 2) * 2 AS INT)) AS out_w,
        greatest(2, CAST(floor(h * sc / 2) * 2 AS INT)) AS out_h FROM f"""),
    "b11_refresh_clamp": _line_check(
        "CASE WHEN l_partkey - 100 > 0 THEN least(240, greatest(30, l_partkey - 100)) ELSE 60 END AS v",
        v=lambda: rates.clamp_refresh(F.col("l_partkey") - 100)),
    "b12_processing_edge": _line_check(
        f"""greatest({W_SQL}::DOUBLE, CASE WHEN flag THEN least(want, {H_SQL} * 2.0::DOUBLE) ELSE want END) AS edge
        FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 1920.0::DOUBLE WHEN 4 THEN 2560.0 WHEN 5 THEN 3840.0
          WHEN 6 THEN coalesce(CASE WHEN l_linestatus = 'O' THEN 3024.0::DOUBLE END, {W_SQL}::DOUBLE)
          ELSE {W_SQL}::DOUBLE END AS want FROM lines) AS lines(
          l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice, l_returnflag, l_linestatus,
          l_suppkey, l_partkey, rate, odd, target, display, flag, want) -- """,
        edge=lambda: sizes.processing_edge(
            F.when(F.col("l_linenumber") == 1, "1080p").when(F.col("l_linenumber") == 4, "2K")
            .when(F.col("l_linenumber") == 5, "4K").when(F.col("l_linenumber") == 6, "screen").otherwise("native"),
            F.when(F.col("l_linestatus") == "O", 3024), W_COL(), H_COL() * 2, "flag")),
    "b13_aspect_scale": _line_check(
        f"""round(CASE l_returnflag WHEN 'A' THEN least(1920.0 / w, 1080.0 / h) WHEN 'N' THEN greatest(1920.0 / w, 1080.0 / h)
          ELSE 1920.0 / w END, 6) AS sx,
        round(CASE l_returnflag WHEN 'A' THEN least(1920.0 / w, 1080.0 / h) WHEN 'N' THEN greatest(1920.0 / w, 1080.0 / h)
          ELSE 1080.0 / h END, 6) AS sy FROM (SELECT *, {W_SQL}::DOUBLE + 1 AS w, {H_SQL}::DOUBLE + 1 AS h FROM lines) -- """,
        sx=lambda: r6(_aspect()["x"]), sy=lambda: r6(_aspect()["y"])),
    "b14_audio_level": Check(audio_levels, f"""{LINES} SELECT {', '.join(KEYS)},
        round(CASE WHEN p <= -80 THEN 0 ELSE least(1.0, pow(10.0::DOUBLE, p / 20)) END, 6) AS level
        FROM (SELECT *, greatest(-l_quantity * 2, -l_extendedprice / 700) AS p FROM lines)"""),
    "b15_fourcc": Check(codes, """
SELECT p_partkey, CASE WHEN greatest(a, b, c, d) < 128 THEN chr(a) || chr(b) || chr(c) || chr(d) ELSE '—' END AS code
FROM (SELECT p_partkey, CAST((v >> 24) & 255 AS INT) AS a, CAST((v >> 16) & 255 AS INT) AS b,
             CAST((v >> 8) & 255 AS INT) AS c, CAST(v & 255 AS INT) AS d
      FROM (SELECT p_partkey, p_partkey * 2654435761 % 4294967296 AS v FROM part))"""),
    "b16_rate_label": _line_check(
        """CASE WHEN l_quantity + floor(l_discount * 20) / 4 = round(l_quantity + floor(l_discount * 20) / 4)
           THEN printf('%.0f', l_quantity + floor(l_discount * 20) / 4)
           ELSE printf('%.2f', l_quantity + floor(l_discount * 20) / 4) END AS label""",
        label=lambda: rates.rate_label(F.col("l_quantity") + F.floor(F.col("l_discount") * 20) / 4)),
    "b17_choose_step": _line_check(
        """CASE WHEN rate * 2 >= goal AND rate * 2 <= display + 0.5 THEN 2
             WHEN rate * 3 >= goal AND rate * 3 <= display + 0.5 AND rate < 25 THEN 3
             WHEN rate * 2 <= display + 0.5 THEN 2 ELSE 1 END AS step
           FROM (SELECT *, least(CASE WHEN target > 0 THEN target ELSE 60 END, display) - 0.5 AS goal FROM lines) -- """,
        step=lambda: rates.choose_step("rate", "target", "display")),
    "b18_fit_step": _line_check(
        "CASE WHEN least(3, floor(display / rate + 0.02)) >= 2 THEN CAST(least(3, floor(display / rate + 0.02)) AS INT) ELSE 1 END AS step",
        step=lambda: rates.fit_step(F.lit(3.0), 1 / F.col("rate"), "display")),
    "b19_phases": _line_check(
        "CASE l_linenumber WHEN 2 THEN [0.5::DOUBLE] WHEN 3 THEN [0.333333::DOUBLE, 0.666667] ELSE []::DOUBLE[] END AS phases",
        phases=lambda: F.transform(rates.phases("l_linenumber"), r6)),
    "b20_eligible": _line_check(
        """coalesce(rate * 1.2 BETWEEN 19.5 AND 60.25 AND flag AND l_linenumber <= 5
           AND (l_linenumber - 3) * least(rate * 1.2, 60) <= display + 0.5, FALSE) AS ok""",
        ok=lambda: rates.eligible(F.col("rate") * 1.2, "display", "flag",
                                  F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber") - 3).otherwise(9))),
    "b21_admitted_rate": _line_check(
        """round(CASE WHEN display * 2 BETWEEN 10 AND 240 AND m BETWEEN 19.5 AND 60.25 THEN least(m, 60) END, 6) AS v
           FROM (SELECT *, CASE WHEN flag THEN coalesce(CASE WHEN l_linestatus = 'O' THEN rate END, 1 / (1 / (rate * 1.1)))
                 ELSE display * 2 END AS m FROM lines) -- """,
        v=lambda: r6(rates.admitted_rate(1 / (F.col("rate") * 1.1), F.col("display") * 2, "flag",
                                         F.when(F.col("l_linestatus") == "O", F.col("rate"))))),
    "b22_follow_ok": _line_check(
        "coalesce(target > 0 AND target >= l_quantity * 2 - 0.01, FALSE) AS ok",
        ok=lambda: rates.follow_ok(F.col("l_quantity") * 2, "target")),
    "b23_prefer_adjacent": _line_check(
        """flag AND l_linestatus = 'O' AND abs(rate - l_quantity * 1.06) <= greatest(1.5, l_quantity * 1.06 * 0.05) AS ok""",
        ok=lambda: rates.prefer_adjacent("rate", F.col("l_quantity") * 1.06, "flag",
                                         F.col("l_linestatus") == "O")),
    "b24_pair_timely": _line_check(
        """l_discount <= 0.05 + s * 0.35 AND abs((l_discount + l_tax - l_discount) - s) <= s * 0.35
           AND l_discount + l_tax <= 0.1 + s * 0.35 AND l_tax * 1.5 > 0 AND l_tax * 1.5 <= s * 1.35 AS ok
           FROM (SELECT *, 1 / l_quantity AS s FROM lines) -- """,
        ok=lambda: costs.pair_timely("l_discount", F.lit(0.05), F.col("l_discount") + F.col("l_tax"),
                                     F.lit(0.1), 1 / F.col("l_quantity"), F.col("l_tax") * 1.5)),
    "b25_processing_cost": _line_check(
        "CASE WHEN isfinite(odd) AND odd >= 0 THEN round(greatest(odd + l_tax, l_discount), 6) ELSE 'Infinity'::DOUBLE END AS cost",
        cost=lambda: r6(costs.processing_cost("odd", "l_tax", "l_discount", strict=False))),
    "b26_pair_cost": _cost_check(
        "round(batch + CASE step WHEN 3 THEN later ELSE 0 END + endp, 9) AS cost",
        cost=lambda: F.round(costs.pair_cost("batch", "later", "endp", F.size("phases")), 9)),
    "b27_costs_fit": _cost_check(
        """fits, coalesce(batch <= period * 1.5 AND endp <= period * 1.5 AND endp <= period * 0.9
             AND batch + endp + endp <= 3 * period * 0.9, FALSE) AS slot_fits""",
        fits=lambda: costs.costs_fit("batch", "later", "endp", "phases", "period"),
        slot_fits=lambda: costs.costs_fit_slot(F.array("batch", "endp"), "endp", "period")),
    "b28_admit_pair": _cost_check(
        """l_linestatus = 'O' AND (step = 2 OR later IS NOT NULL) AND (flag OR fits) AS ok""",
        ok=lambda: costs.admit_pair("batch", "later", "endp", "phases", "period", "flag",
                                    F.col("l_linestatus") == "O")),
    "b31_recordable": _line_check(
        f"flag AND {W_SQL} >= 2 AND {H_SQL} >= 2 AS ok",
        ok=lambda: sizes.recordable("flag", W_COL(), H_COL())),
    "b32_bitrate": _line_check(
        f"round(greatest(8e6::DOUBLE, {W_SQL}::DOUBLE * {H_SQL} * greatest(30.0::DOUBLE, rate) * 0.15), 3) AS bits",
        bits=lambda: F.round(rates.bitrate(W_COL(), H_COL(), "rate"), 3)),
    "c12_endpoint_fresh": _line_check(
        "coalesce(isfinite(odd) AND odd >= 0 AND odd + l_tax <= 1 / l_quantity * 3, FALSE) AS ok",
        ok=lambda: costs.endpoint_fresh("odd", "l_tax", 1 / F.col("l_quantity"))),
    "g2_value_blend": Check(embedding_mix, """
SELECT vec_id, phase, CASE WHEN phase <= 0 THEN [round(x::DOUBLE, 6) FOR x IN embedding]
  WHEN phase >= 1 THEN [round(x::DOUBLE, 6) FOR x IN list_reverse(embedding)]
  ELSE [round(embedding[i]::DOUBLE * (1 - phase) + embedding[len(embedding) + 1 - i]::DOUBLE * phase, 6)
        FOR i IN range(1, len(embedding) + 1)] END AS blend
FROM embeddings, (SELECT unnest([0.0, 0.25, 1.0]::DOUBLE[]) AS phase)"""),
}


def _aspect():
    mode = F.when(F.col("l_returnflag") == "A", "fit").when(F.col("l_returnflag") == "N", "fill").otherwise("stretch")
    return sizes.aspect_scale(mode, W_COL() + 1, H_COL() + 1, F.lit(1920), F.lit(1080))
