"""Cadence on known streams, and against the row-by-row rules on random ones."""

import random

import pandas as pd
import pytest

from cadencekit.operators.control import StableRate
from cadencekit.operators.ordered import ordered
from cadencekit.operators.pairing import unique_pairs
from cadencekit.plans.cadence import cadence
from cadencekit.streaming.steps import Cadence

SCHEMA = ("stream_id string, seq long, epoch long, pts_ns long, width int, height int, pixel_format string, "
          "plane_count int, content string, near string")


def stream(name, ticks, scale, content, near=None):
    return [(name, i, 0, round(i * 1e9 / scale), 64, 48, "420v", 2, str(content(i)), str((near or content)(i)))
            for i in ticks]


def run(spark, data):
    random.Random(1).shuffle(data)
    s = unique_pairs(cadence(ordered(spark.createDataFrame(data, SCHEMA), ["stream_id"], ["seq"]), near="near"))
    return {(r.stream_id, r.seq): r for r in s.done().collect()}


def mixed(i):
    return i // 3 if i <= 60 else 1000 + (i + 1) // 2 if i <= 120 else 5000 + i


def test_known_streams(spark):
    data = stream("static", range(61), 60, lambda i: 0)
    data += stream("modes", range(181), 60, mixed)
    data += stream("slow", range(121), 120, lambda i: i // 6)
    data += stream("small", range(121), 120, lambda i: i // 6, lambda i: 0)
    data += stream("unique", range(121), 120, lambda i: i)
    data += stream("stop", range(90), 60, lambda i: min(i, 60))
    data += stream("pair", range(66), 60, lambda i: i // 6)
    data += [("odd", i, 0, i * 37_000_000, 64, 48, "420v", 2, str(i), str(i)) for i in range(29)]
    got = run(spark, data)
    assert got["static", 60].state_reason == "static_content" and got["static", 60].strict_fps is None
    assert got["static", 59].state_reason == "warming_up"
    for seq, rate in ((60, 20), (120, 30), (180, 60)):
        assert got["modes", seq].fps == pytest.approx(rate, rel=1e-6)
    assert got["slow", 120].fps == pytest.approx(20, rel=1e-6) and got["slow", 120].repeat_proof
    assert got["small", 120].state_reason == "static_content"
    assert got["small", 120].strict_fps == pytest.approx(20, rel=1e-6) and got["small", 120].repeat_proof
    assert got["unique", 120].strict_fps == pytest.approx(120, rel=1e-6) and not got["unique", 120].repeat_proof
    assert got["stop", 75].fps == pytest.approx(60, rel=1e-6) and got["stop", 76].state_reason == "static_content"
    assert got["odd", 28].fps == pytest.approx(27, abs=0.05)
    assert (got["pair", 65].prev_seq, got["pair", 65].cur_seq, got["pair", 65].cur_pts_ns) == (54, 60, 1_000_000_000)


def test_break_reasons_and_precedence(spark):
    base = stream("b", range(40), 60, lambda i: i)

    def change(i, **fields):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for j in range(i, 40):
            row = dict(zip(names, base[j], strict=True))
            if j == i or fields.get("all"):
                row.update({k: v for k, v in fields.items() if k != "all"})
            base[j] = tuple(row.values())

    change(5, pts_ns=None)
    change(10, plane_count=1)
    change(15, width=32)
    change(20, epoch=9, all=True)
    change(25, pts_ns=0)
    base[30:] = [(r[0], r[1] + 2, *r[2:]) for r in base[30:]]
    change(35, pts_ns=None, plane_count=7)
    got = {k[1]: r.reason for k, r in run(spark, base).items()}
    assert got[5] == "invalid_timestamp" and got[6] == "warming_up"
    assert got[10] == "unsupported_format" and got[11] == "warming_up"
    assert got[15] == "layout_changed" and got[16] == "layout_changed"
    assert got[20] == "epoch_changed" and got[21] is None
    assert got[25] == "timestamp_discontinuity" and got[26] == "timestamp_discontinuity"
    assert got[32] == "sequence_gap" and got[37] == "invalid_timestamp"


def random_stream(rng, name):
    rows, pts, seq, epoch, content, width = [], 0, 0, 0, 0, 64
    step = round(1e9 / rng.choice([24, 30, 60, 120]))
    hold = rng.choice([1, 2, 3, 6])
    for i in range(260):
        pts += step if rng.random() > 0.01 else rng.choice([0, -step, 260_000_000])
        seq += 1 if rng.random() > 0.005 else 2
        epoch += rng.random() < 0.004
        width = rng.choice([64, 32]) if rng.random() < 0.004 else width
        content += (i % hold == 0) and rng.random() > 0.05
        rows.append((name, seq, epoch, pts if rng.random() > 0.004 else None, width, 48,
                     "420v" if rng.random() > 0.004 else "x", 2, f"c{content}", f"n{content // rng.choice([1, 1, 2])}"))
    return rows


@pytest.mark.parametrize("limit", [None, 60])
def test_random_streams_match_the_row_rules(spark, hot, limit):
    if limit:
        hot(limit)
    rng = random.Random(7)
    data = [r for i in range(12) for r in random_stream(rng, f"r{i}")]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    expected = {}
    for name in {r[0] for r in data}:
        pdf = pd.DataFrame([r for r in data if r[0] == name], columns=names).astype(object)
        out, _ = Cadence(near="near")(pdf, None)
        for i, seq in enumerate(pdf["seq"]):
            expected[name, seq] = tuple(out[c][i] for c in Cadence.columns)
    got = run(spark, data)
    assert set(got) == set(expected)
    for key, want in expected.items():
        r = got[key]
        have = (r.state, r.state_reason, r.fps, r.updates, r.strict_fps, r.repeat_proof)
        assert _same(have, want), (key, have, want)


def _same(have, want):
    return all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * abs(b))
               for a, b in zip(have, want, strict=True))


def test_streak():
    pdf = pd.DataFrame({"epoch": [0] * 6, "seq": range(6), "rate": [29.97] * 4 + [29.975, 30.02]})
    assert StableRate()(pdf, None)[0]["stable_fps"] == [None] * 4 + [29.97, None]
    pdf = pd.DataFrame({"epoch": [0] * 6, "seq": [0, 1, 2, 2, 3, 4], "rate": [30.0] * 6})
    assert StableRate()(pdf, None)[0]["streak"] == [1, 2, 3, 0, 1, 2]
