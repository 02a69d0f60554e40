"""Streams over several micro-batches, late rows, timers, and equality with the batch form."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cadencekit.operators.buffers import DrainedBuffer
from cadencekit.operators.control import StableRate, stable_rate
from cadencekit.sources import sinks
from cadencekit.streaming import streams as S

BASE_MS = 1_700_000_000_000


def feed(spark, folder, batches, schema):
    """One Parquet file, and so one micro-batch, per list of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    frame = spark.createDataFrame([], schema)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_controller_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    data = [(f"k{i % 3}", i, 0, i, rng.choice([30.0, 30.005, 25.0, None])) for i in range(120)]
    schema = "k string, o long, epoch long, seq long, rate double"
    stream = feed(spark, tmp_path, [data[i:i + 30] for i in range(0, 120, 30)], schema)
    live = S.drain(S.control_stream(stream, ["k"], ["o"], StableRate(need=3)))
    batch = stable_rate(spark.createDataFrame(data, schema), ["k"], ["o"], need=3)
    pick = ["k", "o", "stable_fps", "streak"]
    assert sorted(map(repr, live.select(pick).collect())) == sorted(map(repr, batch.select(pick).collect()))
    assert live.filter("late_row").count() == 0


def test_late_rows_are_counted_not_lost(spark, tmp_path):
    schema = "k string, o long, content string"
    stream = feed(spark, tmp_path, [[("a", 1, "x"), ("a", 3, "y")], [("a", 2, "z"), ("a", 4, "y")]], schema)
    out = {r.o: r for r in S.drain(S.change_stream(stream, ["k"], ["o"])).collect()}
    assert out[2].late_row and out[2].changed is None and out[2].n_late_rows == 1
    assert out[3].changed is True and out[4].changed is False and len(out) == 4


def timed(rows):
    return [(k, None if at is None else BASE_MS + at, *rest) for k, at, *rest in rows]


def with_time(stream):
    return stream.withColumn("at", F.timestamp_millis("at_ms")).withColumn("at_us", F.col("at_ms") * 1000)


def test_first_picture_timer(spark, tmp_path):
    rows = [[("a", 0, "start"), ("b", 0, "start")], [("b", 1000, "picture")], [("c", 9000, "start")], [("a", 12000, "picture"), ("c", 9500, "picture")]]
    rows += [[("z", 90_000, "other")], [("z", 90_001, "other")]]
    stream = with_time(feed(spark, tmp_path, [timed(r) for r in rows], "k string, at_ms long, kind string"))
    out = S.drain(S.first_event_timeout(stream, ["k"], "at", "at_us", "at_ms", "kind", "20 seconds"))
    got = sorted((r.k, r.state, (r.at_us - BASE_MS * 1000) // 1000) for r in out.collect())
    assert got == [("a", "no_picture", 3000), ("a", "running", 12000), ("b", "running", 1000), ("c", "running", 9500)]


def test_lifetime_lapses(spark, tmp_path):
    rows = [[("a", 0, 2.0)], [("a", 1000, 3.0)], [("b", 9000, 1.0)], [("b", 9100, 1.0)]]
    rows = [rows[2], rows[1], rows[3], rows[0], [("z", 90_000, 0.0)], [("z", 90_001, 0.0)]]
    stream = with_time(feed(spark, tmp_path, [timed(r) for r in rows], "k string, at_ms long, value double"))
    out = S.drain(S.ttl_stream(stream, ["k"], "at", "at_us", "at_ms", "value", "20 seconds"))
    got = sorted((r.k, r.state, (r.at_us - BASE_MS * 1000) // 1000) for r in out.collect())
    assert got == [("a", "active", 0), ("a", "active", 1000), ("a", "expired", 2250), ("b", "active", 9000),
                   ("b", "active", 9100), ("b", "expired", 10350)]


def test_rows_behind_the_watermark_are_an_error(spark, tmp_path):
    rows = [[("a", 90_000, 2.0)], [("a", 90_001, 2.0)], [("a", 0, 1.0)], [("a", 90_002, 1.0)]]
    stream = with_time(feed(spark, tmp_path, [timed(r) for r in rows], "k string, at_ms long, value double"))
    with pytest.raises(RuntimeError, match="behind the watermark"):
        S.drain(S.ttl_stream(stream, ["k"], "at", "at_us", "at_ms", "value", "1 second"))


@pytest.mark.parametrize(("name", "n_files"), [
    ("t1_tick_stream", 4), ("t2_cadence_stream", 4), ("t3_epoch_stream", 4), ("t4_change_stream", 1), ("t4_change_stream", 16),
    ("t6_pinned_epoch", 4), ("t7_late_rows", 4), ("t9_ttl_stream", 4), ("t10_first_event", 4), ("t11_control_stream", 4)])
def test_shuffled_files_of_a_folder(spark, tmp_path, monkeypatch, name, n_files):
    """A table in files of no order of time, one a trigger: the answer is the batch oracle's."""
    from compare import connect, differences

    from cadencekit.checks import live

    whole = "/root/testdata/sf0.001"
    spark.read.parquet(f"{whole}/events.parquet").orderBy(F.xxhash64("event_id")).repartition(n_files).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(live, "BATCH_BYTES", 1)
    check = live.CHECKS[name]
    assert differences(check.run(spark, str(tmp_path)), connect(whole), check.sql) == []


def test_stop_deadline_drops_what_is_pending(spark, tmp_path):
    put = lambda k, at, n, stop=None: (k, at, n, at * 1_000_000, 10_000_000, None, stop)
    rows = [[put("a", i * 10, i) for i in range(12)], [("a", 200, None, None, None, 0, BASE_MS + 200)],
            [put("z", 9000, 0)], [put("z", 9100, 1)]]
    schema = "k string, at_ms long, packet_no long, pts_ns long, duration_ns long, pull int, stop_ms long"
    stream = with_time(feed(spark, tmp_path, [timed(r) for r in rows], schema))
    step = DrainedBuffer()
    out = S.drain(S.buffer_stream(stream.filter("packet_no is not null or stop_ms is not null"), ["k"], ["at_ms"], "at", "0 seconds", step))
    dropped = [sorted(r.evicted) for r in out.collect() if r.k == "a" and r.event == "deadline"]
    assert dropped == [list(range(12))]


def state_rows(spark, folder, variable):
    """What a finished query holds in one state variable."""
    return spark.read.format("statestore").option("stateVarName", variable).load(str(folder)).collect()


def run(stream, folder):
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def test_rows_wait_for_their_order_and_late_ones_are_reported(spark, tmp_path):
    """Within the wait any order is put right; a row within the grace is late, not lost; nothing stays but what is not due."""
    schema = "k string, at_ms long, content string"
    rows = [[("a", 4000, "y"), ("a", 1000, "x")], [("a", 2000, "x"), ("a", 3000, "z")], [("a", 30_000, "y")], [("a", 30_001, "y")],
            [("a", 2500, "late"), ("a", None, "no time")], [("a", 60_000, "y"), ("a", 59_000, "w")]]
    stream = with_time(feed(spark, tmp_path / "in", [timed(r) for r in rows], schema))
    out = run(S.change_stream(stream, ["k"], ["at_ms"], S.Arrival("at", 5, grace_s=40)), tmp_path)
    got = sorted((-1 if r.at_ms is None else r.at_ms - BASE_MS, r.changed, r.late_row, r.n_late_rows) for r in out.collect())
    assert got == [(-1, None, True, 2), (1000, None, False, 0), (2000, False, False, 0), (2500, None, True, 2), (3000, True, False, 0),
                   (4000, True, False, 0), (30_000, False, False, 2), (30_001, False, False, 2)]
    waiting = state_rows(spark, tmp_path / "cp", "waiting_runs")
    assert [(r.user_map_value.first_us // 1000 - BASE_MS, r.user_map_value.n_rows) for r in waiting] == [(59_000, 2)]


def test_cadence_state_is_one_second_of_changes(spark, tmp_path):
    """Twenty seconds at 50 a second, twenty triggers: the list states hold the last second, the value one row."""
    schema = "k string, seq long, pts_ns long, epoch long, width long, height long, pixel_format string, plane_count long, content string"
    rows = [("a", i, i * 20_000_000, 0, 1280, 720, "420v", 2, f"c{i // 2}") for i in range(1000)]
    stream = feed(spark, tmp_path / "in", [rows[i:i + 50] for i in range(0, 1000, 50)], schema)
    out = run(S.cadence_stream(stream, ["k"], ["seq"]), tmp_path)
    assert out.filter("state = 'estimated'").count() > 900
    assert len(state_rows(spark, tmp_path / "cp", "step")) == 1
    for name, most in (("loose", 26), ("exact", 26), ("seen", 51)):
        held = state_rows(spark, tmp_path / "cp", f"step_{name}")
        assert 0 < len(held) <= most


def test_stop_deadline_by_the_clock(spark, tmp_path):
    """No row comes after the stop: the deadline holds by the clock all the same."""
    put = lambda k, at, n, stop=None: (k, at, n, at * 1_000_000, 10_000_000, None, stop)
    rows = [[put("a", i * 10, i) for i in range(5)] + [("a", 200, None, None, None, 0, BASE_MS + 200)]]
    schema = "k string, at_ms long, packet_no long, pts_ns long, duration_ns long, pull int, stop_ms long"
    stream = feed(spark, tmp_path / "in", [timed(r) for r in rows], schema)
    out = S.buffer_stream(stream, ["k"], ["at_ms"], None, deadline_ms=500)
    query = (out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
             .trigger(processingTime="200 milliseconds").start())
    found, until = [], time.time() + 60
    while not found and time.time() < until:
        time.sleep(1)
        found = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").filter("event = 'deadline'").collect() if (tmp_path / "out").exists() else []
    query.stop()
    assert [sorted(r.evicted) for r in found] == [[0, 1, 2, 3, 4]]


def test_idle_state_goes(spark, tmp_path):
    """A key without rows for longer than ``idle_ms`` starts anew."""
    schema = "k string, o long, v long"
    live = S.latest_stream(feed(spark, tmp_path / "in", [[("a", 5, 1), ("a", 6, 2)]], schema), ["k"], ["o"], 1000)
    query = (live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
             .trigger(processingTime="200 milliseconds").start())
    found, until = [], time.time() + 60
    while len(found) < 2 and time.time() < until:
        time.sleep(3)
        found = sorted(r.o for r in spark.read.schema(live.schema).parquet(f"{tmp_path}/out").collect()) if (tmp_path / "out").exists() else []
        if found == [6] and not (tmp_path / "in/b1").exists():
            time.sleep(3)
            spark.createDataFrame([("a", 1, 3)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b1")
    query.stop()
    assert found == [1, 6]


def test_latest_keeps_one_row_per_trigger(spark, tmp_path):
    rows = [[("a", i, i) for i in range(10)], [("a", 4, 99)], [("a", 20, 20), ("a", 21, 21)]]
    out = S.drain(S.latest_stream(feed(spark, tmp_path, rows, "k string, o long, v long"), ["k"], ["o"])).orderBy("o").collect()
    assert [(r.o, r.n_dropped) for r in out] == [(9, 9), (21, 11)]


def test_event_time_anchor(spark, tmp_path):
    rows = [[("a", i * 1_000_000_000) for i in range(5)], [("a", i * 1_000_000_000) for i in range(5)]]
    stream = feed(spark, tmp_path, rows, "k string, pts_ns long")
    at = S.wall_clock(F.col("pts_ns"), F.timestamp_millis(F.lit(BASE_MS)))
    out = S.drain(S.dedupe_stream(stream.withColumn("at", at), ["k", "pts_ns"], "at", "1 hour"))
    assert out.count() == 5


def test_batch_sink_is_idempotent(spark, tmp_path):
    write = sinks.replace_batch(str(tmp_path / "out"))
    for batch_id, n in ((0, 3), (1, 4), (1, 4)):
        write(spark.range(n).toDF("x"), batch_id)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_keys_wait_in_groups(spark, tmp_path, monkeypatch):
    """Forty keys in four groups: a group's rows wait as one run, and every key keeps its own state and count of late rows."""
    monkeypatch.setattr(S, "GROUPS", 4)
    schema = "k long, at_ms long, content string"
    keys = [None, *range(39)]
    first = [(k, 1000 + i * 10, f"c{(i + (k or 0)) // 2}") for k in keys for i in range(5)]
    rows = [first[::-1], [("z", 30_000, "y")], [("z", 30_001, "y")], [(3, 1005, "late"), (3, 1006, "late"), (5, 2000, "more")],
            [("z", 90_000, "y")], [("z", 90_001, "y")]]
    rows = [[(-1 if k == "z" else k, *rest) for k, *rest in batch] for batch in rows]
    stream = with_time(feed(spark, tmp_path / "in", [timed(r) for r in rows[:3]], schema))
    live = S.change_stream(stream, ["k"], ["at_ms"], S.Arrival("at", 5, grace_s=40))
    waiting = run(S.change_stream(stream, ["k"], ["at_ms"], S.Arrival("at", 50)), tmp_path / "held")
    assert waiting.count() == 0
    held = state_rows(spark, tmp_path / "held/cp", "waiting_runs")
    assert sum(r.user_map_value.n_rows for r in held) == 202 and len({r.key[0] for r in held}) == 4 and len(held) <= 6
    run(live, tmp_path)
    for i, batch in enumerate(rows[3:], 3):
        spark.createDataFrame(timed(batch), schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    got = {(r.k, r.at_ms - BASE_MS): (r.changed, r.late_row, r.n_late_rows) for r in run(live, tmp_path).collect()}
    for k in keys:
        assert [got[k, 1000 + i * 10] for i in range(5)] == [(None if i == 0 else (i + (k or 0)) % 2 == 0, False, 0) for i in range(5)]
    assert got[3, 1005] == got[3, 1006] == (None, True, 2) and got[5, 2000] == (True, False, 0)


def test_buffers_go_in_groups(spark, tmp_path, monkeypatch):
    """Forty keys in four groups: one call a group and trigger, and every key keeps a buffer of its own."""
    monkeypatch.setattr(S, "GROUPS", 4)
    schema = "k long, at_ms long, packet_no long, pts_ns long, duration_ns long, pull int, stop_ms long"
    keys = [None, *range(39)]
    put = lambda k, at, n: (k, at, n, at * 1_000_000, 1_000_000, None, None)
    rows = [[put(k, 10 + i, (k or 0) * 100 + i) for i in range(3) for k in keys][::-1],
            [(k, 20, None, None, None, 2, None) for k in keys], [(k, 30, None, None, None, 2, None) for k in keys if k != 7]]
    stream = with_time(feed(spark, tmp_path / "in", [timed(r) for r in rows], schema))
    out = run(S.buffer_stream(stream, ["k"], ["at_ms"], "at"), tmp_path).collect()
    first = {k: (k or 0) * 100 for k in keys}
    assert sorted((-1 if r.k is None else r.k, *r.drained) for r in out if len(r.drained) == 2) == sorted(
        (-1 if k is None else k, n, n + 1) for k, n in first.items())
    assert {r.k: r.drained for r in out if len(r.drained) == 1} == {k: [n + 2] for k, n in first.items() if k != 7}
    assert len(out) == 79 and all(r.event == "media" and not r.evicted for r in out)
    held = state_rows(spark, tmp_path / "cp", "buffers")
    assert len(held) == 40 and len({r.key[0] for r in held}) == 4


def test_deadlines_wait_in_groups(spark, tmp_path, monkeypatch):
    """Forty keys in four groups, every row a stop: a group has one timer, and only buffers whose stop is due are dropped."""
    monkeypatch.setattr(S, "GROUPS", 4)
    schema = "k long, at_ms long, packet_no long, pts_ns long, duration_ns long, pull int, stop_ms long"
    put = lambda k, at, n: (k, at, n, at * 1_000_000, 1_000_000, None, BASE_MS + at)
    rows = [[put(k, 10 + i + 40_000 * (k % 2), k * 100 + i) for i in range(3) for k in range(40)], [put(-1, 60_000, 0)], [put(-1, 60_001, 1)]]
    stream = with_time(feed(spark, tmp_path / "in", [timed(r) for r in rows], schema))
    out = run(S.buffer_stream(stream, ["k"], ["at_ms"], "at", "30 seconds"), tmp_path).collect()
    assert sorted((r.k, r.event, *r.evicted) for r in out) == [(k, "deadline", *range(k * 100, k * 100 + 3)) for k in range(0, 40, 2)]
    timers = spark.read.format("statestore").option("readRegisteredTimers", True).load(f"{tmp_path}/cp").collect()
    assert len(timers) == 4
