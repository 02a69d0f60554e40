"""Buffers, ledgers, payloads and sinks."""

import json
import random
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest
from compare import differences
from pyspark.sql import functions as F

from cadencekit.checks import controls, live
from cadencekit.operators import buffers as B
from cadencekit.operators import payload as P
from cadencekit.operators.control import Demotion, late_interval_control
from cadencekit.operators.ordered import ordered
from cadencekit.operators.quality import reconcile
from cadencekit.sources import sinks

SEC = 1_000_000_000


def outcomes(spark, packets, max_s=2, rows=2048):
    df = spark.createDataFrame([("s", i, t, d) for i, (t, d) in enumerate(packets)], "k string, i long, pts_ns long, duration_ns long")
    out = B.bounded_buffer(ordered(df, ["k"], ["i"]), max_ns=max_s * SEC, max_rows=rows).done()
    return [r.outcome for r in out.orderBy("i").collect()]


def test_buffer_rules(spark):
    assert outcomes(spark, [(i * SEC // 2, SEC // 2) for i in range(5)]) == ["evicted"] + ["kept"] * 4
    assert outcomes(spark, [(SEC, 5), (0, 5)]) == ["kept", "rejected"]
    assert outcomes(spark, [(0, SEC // 10), (10 * SEC, SEC // 10)]) == ["evicted", "kept"]
    assert outcomes(spark, [(0, 3 * SEC)]) == ["evicted"]
    assert outcomes(spark, [(0, 0), (0, -1), (0, None), (None, 5)]) == ["rejected"] * 4
    assert outcomes(spark, [(i, 1) for i in range(10)], rows=3) == ["evicted"] * 7 + ["kept"] * 3


@pytest.mark.parametrize("limit", [None, 500])
def test_long_run(spark, hot, limit):
    if limit:
        hot(limit)
    got = outcomes(spark, [(i * SEC // 100, SEC // 100) for i in range(10_000)])
    assert got.count("evicted") == 9800 and got[9800] == "kept" and got[9799] == "evicted"


def test_closed_form_equals_the_queue(spark):
    rng = random.Random(5)
    for _ in range(6):
        t, packets = 0, []
        for _ in range(60):
            t += rng.choice([0, SEC // 5, SEC // 2, -SEC // 5, 3 * SEC])
            packets.append((t, rng.choice([SEC // 5, SEC // 2, 0, 3 * SEC])))
        pdf = pd.DataFrame([(i, a, d, None) for i, (a, d) in enumerate(packets)],
                           columns=["packet_no", "pts_ns", "duration_ns", "pull"]).astype(object)
        out, state = B.DrainedBuffer(max_rows=9)(pdf, None)
        kept = {e[0] for e in state["queue"]}
        lost = {n for gone in out["evicted"] for n in gone}
        got = outcomes(spark, packets, rows=9)
        assert {i for i, o in enumerate(got) if o == "kept"} == kept
        assert {i for i, o in enumerate(got) if o != "kept"} == lost


def instant_events(spark, folder):
    """Three puts, the second of no length, and a pull of two."""
    rows = [(0, 1, "view", 1.0), (1, 2, "view", 0.0), (2, 3, "view", 2.0), (3, 4, "error", 1.0), (4, 5, "view", 0.0)]
    df = spark.createDataFrame([(i, t, 7, kind, v, '{"k": 2}') for i, t, kind, v in rows],
                               "event_id long, t long, user_id long, event_type string, value double, props string")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("t") + 1_704_067_200).cast("timestamp_ntz")).drop("t")
    df.write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["w12_buffer_with_drain", "t8_buffer_stream", "t8_stop_deadline"])
def test_instants_are_held_as_in_the_sql(spark, tmp_path, name):
    """Packets of no length are held and drained."""
    check, con = (controls.CHECKS | live.CHECKS)[name], instant_events(spark, tmp_path)
    assert differences(check.run(spark, str(tmp_path)), con, check.sql) == []


def test_long_stall_balances(spark):
    """250 packets while nothing is ready, then 10 that are drained at once."""
    step = SEC * 1024 // 48000
    puts = [("s", i, i, i * step, step, None) for i in range(250)]
    for i in range(250, 260):
        puts += [("s", i * 2, i, i * step, step, None), ("s", i * 2 + 1, None, None, None, 64)]
    df = spark.createDataFrame(puts, "k string, o long, packet_no long, pts_ns long, duration_ns long, pull int")
    out = B.buffer_with_drain(df, ["k"], ["o"]).collect()
    evicted = sorted(n for r in out for n in r.evicted)
    drained = [n for r in sorted(out, key=lambda r: r.o) for n in r.drained]
    assert drained == sorted(drained) and sorted(evicted + drained) == list(range(260))
    assert evicted == list(range(len(evicted))) and (250 - len(evicted)) * step <= 2 * SEC


def test_video_admission(spark):
    data = [(0, None, 64), (1, -5, 64), (2, 100, 32), (3, 90, 64), (4, 110, 64), (5, 110, 64), (6, 120, 64)]
    df = spark.createDataFrame([("s", i, p, w, 48, 64, 48) for i, p, w in data],
                               "k string, i long, pts_ns long, width int, height int, session_width int, session_height int")
    out = B.admit_video(ordered(df, ["k"], ["i"])).done().orderBy("i").collect()
    assert [r.drop_reason for r in out] == ["invalid", "invalid", "size", "before_start", None, "not_increasing", None]


def test_reconcile(spark, rows):
    received = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "session_id string, pts_ns long")
    ledger = spark.createDataFrame([("s", 1, "accepted"), ("s", 2, "accepted"), ("s", 2, "dropped"), ("s", 9, "failed")],
                                   "session_id string, pts_ns long, status string")
    assert rows(reconcile(received, ledger, ["session_id"]), "pts_ns", "balanced", "missing", "unknown") == [
        (1, True, False, False), (2, False, False, False), (3, False, True, False), (9, False, False, True)]


def test_identity_ignores_unrelated_attributes(spark):
    base = {"matrix": "709", "note": "a"}
    data = [(0, b"abcd", base), (1, b"abcd", base | {"note": "b"}), (2, b"abcd", {"matrix": "601"}), (3, b"abce", {"matrix": "601"}), (4, b"abc", {"matrix": "601"})]
    df = spark.createDataFrame([("s", *r) for r in data], "k string, i long, payload binary, attrs map<string,string>")
    df = df.withColumn("sig", P.compared_attrs(F.col("attrs"))).drop("attrs")
    out = P.identical(df, ["k"], ["i"], "payload", ["sig"]).orderBy("i").collect()
    assert [r.identical for r in out] == [None, True, False, False, False]


def test_tolerance_edge(spark):
    def flip(n):
        raw = bytearray(1000)
        raw[-n:] = b"\x01" * n if n else b""
        return bytes(raw[:1000])
    data = [(0, bytes(1000)), (1, flip(2)), (2, bytes(1000)), (3, flip(3)), (4, bytes(999))]
    df = spark.createDataFrame([("s", *r) for r in data], "k string, i long, payload binary")
    out = P.equivalent(df, ["k"], ["i"], "i", "payload").orderBy("i").collect()
    assert [r.equivalent for r in out] == [None, True, True, False, False]
    padded = df.withColumn("stride", F.lit(1500))
    out = P.equivalent(padded, ["k"], ["i"], "i", "payload", stride="stride").orderBy("i").collect()
    assert [r.equivalent for r in out] == [None, True, True, True, False]


def test_motion_finds_a_known_shift(spark):
    y, x = np.mgrid[0:64, 0:64]
    big = 0.5 + 0.15 * np.sin(x / 3.1) + 0.15 * np.sin(y / 3.7) + 0.1 * np.sin((x + 2 * y) / 9.3)
    old, new = big[16:48, 16:48], big[14:46, 15:47]
    df = spark.createDataFrame([("s", 0, old.ravel().tolist()), ("s", 1, new.ravel().tolist()), ("s", 2, new.ravel().tolist())],
                               "k string, seq long, luma array<double>")
    cells = P.motion(P.frame_pairs(df, ["k"], "seq", "luma"), ["k", "seq"], "luma", F.lit(32)).collect()
    inner = [c for c in cells if c.seq == 1 and 2 <= c.bx <= 5 and 2 <= c.by <= 5]
    assert sum((c.dx, c.dy) == (1, 2) for c in inner) >= 0.8 * len(inner)
    still = [c for c in cells if c.seq == 2]
    assert all((c.dx, c.dy, c.cost, c.flow_x) == (0, 0, 0, 0) for c in still) and len(still) == 64


def test_motion_search_holds_little():
    """Three thousand pictures at once: the search goes in parts, with the same cells as one by one."""
    rng = np.random.default_rng(3)
    prev, cur = (pd.Series(list(rng.random((3000, 64)))) for _ in range(2))
    width = pd.Series([8] * 3000)
    tracemalloc.start()
    found = P._motion_cells.func(prev, cur, width)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    for i in (0, 1500, 2999):
        assert P._motion_cells.func(*(s[i:i + 1] for s in (prev, cur, width)))[0] == found[i]


def test_motion_search_matches_a_plain_scan():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 3, (2, 8, 8)) / 4.0

    def cost(y, x, dy, dx):
        def at(m, r, c):
            return m[min(max(r, 0), 7), min(max(c, 0), 7)]
        return np.mean([abs(at(a, y + i, x + j) - at(b, y + i + dy, x + j + dx)) for i in (-2, 0, 2) for j in (-2, 0, 2)])

    ys, xs = (g.ravel()[None] for g in np.mgrid[0:8, 0:8])
    zero = np.zeros(ys.shape, dtype=int)
    dy, dx, best, second = P._search(a[None], b[None], ys, xs, zero, zero, 2)
    for i, (y, x) in enumerate(zip(ys[0], xs[0], strict=True)):
        top, runner, pick = 1e10, 1e10, (0, 0)
        for sy in range(-2, 3):
            for sx in range(-2, 3):
                c = cost(y, x, sy, sx)
                if c < top - 1e-12 or (abs(c - top) < 1e-12 and sy * sy + sx * sx < pick[0] ** 2 + pick[1] ** 2):
                    runner, top, pick = top, c, (sy, sx)
                elif c < runner:
                    runner = c
        assert best[0, i] == pytest.approx(top) and second[0, i] == pytest.approx(runner)


def test_late_interval_hysteresis(spark):
    def rows(n, interval, start, slot=1 / 60):
        return [(start + i * slot, interval, slot, True, 60.0, 20, False) for i in range(n)]
    data = rows(1, 1 / 60, 20) + rows(40, 1 / 60, 20.1) + rows(12, 1 / 40, 21) + rows(60, 1 / 60, 22)
    data += [(30.0, 1 / 60, 1 / 60, True, 60.0, 20, True)]
    columns = "n int, time_s double, interval_s double, slot_s double, pair boolean, display_hz double, n_batches int, overload boolean"
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], columns).withColumn("stream_id", F.lit(1))
    out = {r["n"]: r for r in late_interval_control(df, ["stream_id"], ["n"]).collect()}
    demoted = [out[i]["demoted"] for i in range(len(data))]
    assert not any(demoted[:41]) and demoted[52] and not demoted[-2] and demoted[-1]
    assert out[len(data) - 1]["n_ratios"] == 1


def test_demotion_goes_on_from_its_state():
    names = ["time_s", "opens", "ratio", "bound", "restore", "overload"]
    data = [(20 + i / 60, i == 0, None if i == 0 else 1.5 if 40 < i < 53 else 1.0, 1.05, True, False) for i in range(113)]
    out, _ = Demotion()(pd.DataFrame(data, columns=names), None)
    one, state = Demotion()(pd.DataFrame(data[:50], columns=names), None)
    two, _ = Demotion()(pd.DataFrame(data[50:], columns=names), json.loads(json.dumps(state)))
    assert one["demoted"] + two["demoted"] == out["demoted"] and any(out["demoted"])


def test_replace_output_keeps_the_old_one_on_failure(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.replace_output(spark.range(3).toDF("x"), path)
    sinks.replace_output(spark.range(5).toDF("x"), path)
    assert spark.read.parquet(path).count() == 5

    def broken(frame, where):
        frame.write.parquet(where)
        raise RuntimeError("disk full")

    with pytest.raises(RuntimeError):
        sinks.replace_output(spark.range(9).toDF("x"), path, broken)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_sample_reader_fills_times_and_digests(spark, tmp_path):
    from cadencekit.sources import tables
    from cadencekit.sources.schema import SAMPLES

    rows = spark.createDataFrame([("s", 1001, 30000, b"ab"), ("s", 5, 0, b"ab")],
                                 "stream_id string, pts_value bigint, pts_scale int, payload binary")
    rows.write.parquet(str(tmp_path / "samples"))
    out = tables.read_samples(spark, str(tmp_path / "samples"), SAMPLES).orderBy("pts_value").collect()
    assert [r.pts_ns for r in out] == [None, 33366667] and out[0].content_hash == out[1].content_hash
    assert tables.read_samples(spark, str(tmp_path / "samples"), stream=True, max_files_per_trigger=1).isStreaming
    assert [r.pts_valid for r in tables.with_pts(rows).orderBy("pts_value").collect()] == [False, True]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.bin").write_bytes(b"abc")
    assert tables.read_payload_files(spark, str(tmp_path / "raw")).first().n_bytes == 3


def test_diagnostics_and_fragments(spark, tmp_path):
    df = spark.createDataFrame([("s", t, True, float("nan") if t == 5 else 1.5, None) for t in range(1, 12)] + [("z", 5, False, 1.0, None)],
                               "stream_id string, tick long, active boolean, fps double, basis double")
    sinks.write_diagnostics(df, str(tmp_path / "log"))
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()), key=lambda r: r["tick"])
    assert [(r["tick"], r["fps"], r["basis"]) for r in got] == [(5, 0.0, None), (10, 1.5, None)]
    parts = spark.createDataFrame([("s", i * 4 * SEC) for i in range(10)], "stream_id string, pts_ns long")
    sinks.write_fragments(parts, str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).groupBy("fragment").count().count() == 4
