"""Formats, ranges and rates of requests against a plain scan of all ranges."""

import math
import random

import pytest

from cadencekit.operators.catalog import match_format, range_pieces

TOL = 0.01


def plain(ranges, device, rate, selected):
    """(chosen format, supported, lo, hi, rate) by the rule, range by range."""
    mine = [r for r in ranges if r[0] == device and r[1] == selected]
    valid = lambda r: r[5] - TOL <= r[6] + TOL and not math.isnan(r[6])
    if not mine or rate is None:
        return selected, False, None, None, None
    aim = max((r[6] for r in mine if valid(r)), default=None) if rate == 0 else rate
    same = [r for r in ranges if r[0] == device and r[3:5] == mine[0][3:5]]
    for part in (mine, same):
        for _, idx, _, _, _, lo, hi in sorted(part, key=lambda r: (r[1], r[2])):
            if aim is not None and lo - TOL <= aim <= hi + TOL:
                target = hi if abs(hi - aim) < TOL else lo if abs(lo - aim) < TOL else aim
                return idx, True, lo, hi, target
    return selected, False, None, None, None


def drawn(seed, formats=60, far=2e13):
    draw = random.Random(seed)
    ranges = []
    for device in ("a", None):
        for idx in range(formats):
            size = draw.choice([(64, 48), (1920, 1080)])
            for pos in range(draw.randint(1, 4)):
                lo = draw.choice([5.0, 10.0, 23.976, 29.97, 30.0, 59.94, draw.uniform(1, 200)])
                hi = draw.choice([lo, lo + 0.015, lo + draw.uniform(0, 90), lo - 5, math.nan, far])
                ranges.append((device, idx, pos, *size, lo, hi))
    ends = [e + d for r in ranges for e in r[5:7] if e == e for d in (0, TOL, -TOL, 0.009, -0.009)]
    asked = [(n, draw.choice(["a", None, "b"]), draw.choice([0.0, None, -1.0, math.nan, draw.choice(ends), draw.uniform(0, 300)]), draw.randint(0, formats))
             for n in range(900)]
    return ranges, asked


@pytest.mark.parametrize("limit", [None, 60])
def test_against_a_plain_scan(spark, hot, limit):
    if limit:
        hot(limit)
    ranges, asked = drawn(1, 30, 240.0) if limit else drawn(0)
    formats = spark.createDataFrame(ranges, "device_id string, format_idx int, pos int, width int, height int, lo double, hi double")
    requests = spark.createDataFrame(asked, "n int, device_id string, rate double, format_idx int")
    got = {r.n: (r.chosen_idx, r.supported, r.chosen_lo, r.chosen_hi, r.target_rate) for r in match_format(requests, formats).collect()}
    assert len(got) == len(asked)
    for n, device, rate, selected in asked:
        assert got[n] == plain(ranges, device, rate, selected), (device, rate, selected)


def test_pieces_are_disjoint_and_few(spark):
    ranges, _ = drawn(7)
    formats = spark.createDataFrame(ranges, "device_id string, format_idx int, pos int, width int, height int, lo double, hi double")
    assert range_pieces(formats, ["device_id"]).count() <= 2 * len(ranges)


def test_empty_tables(spark):
    formats = spark.createDataFrame([], "device_id string, format_idx int, width int, height int, lo double, hi double")
    asked = spark.createDataFrame([("a", 30.0, 1)], "device_id string, rate double, format_idx int")
    assert [tuple(r)[3:] for r in match_format(asked, formats).collect()] == [(1, False, None, None, None)]
    assert match_format(asked.limit(0), formats).count() == 0
