"""Overlaps at any scale, names found by grams, tails by selection and payloads by blocks, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from cadencekit.operators import catalog as K
from cadencekit.operators import payload as P
from cadencekit.operators.quality import RANKS, selected_tails


def test_overlap_at_any_scale(spark, rows):
    rng = random.Random(4)

    def rects(n, sizes):
        return [(i, rng.choice("ab"), rng.uniform(-2000, 2000), rng.uniform(-2000, 2000), rng.choice(sizes), rng.choice(sizes)) for i in range(n)]
    windows, displays = rects(120, [0.25, 7.0, 64.0, 900.0, 0.0]), rects(40, [3.0, 512.0, 1920.0, 1_000_000.0])
    windows += [(900, "a", 0.0, 0.0, float("inf"), 1.0), (901, "a", None, 0.0, 1.0, 1.0)]
    displays += [(77, *displays[3][1:])]
    w = spark.createDataFrame(windows, "window_id long, host string, x double, y double, w double, h double")
    d = spark.createDataFrame(displays, "display_id long, host string, x double, y double, w double, h double")
    want = []
    for i, host, x, y, wide, high in windows:
        found = []
        for j, other, dx, dy, dw, dh in displays:
            a = min(x + wide, dx + dw) - max(x, dx) if x is not None and wide < 1e300 else 0
            b = min(y + high, dy + dh) - max(y, dy)
            if other == host and a > 0 and b > 0:
                central = dx <= x + wide / 2 < dx + dw and dy <= y + high / 2 < dy + dh
                found.append((a * b, central, -j))
        want.append((i, -max(found)[2] if found else None))
    assert rows(K.largest_overlap(w, d, ["host"]), "window_id", "display_id") == sorted(want, key=repr)
    levels = F.transform(F.sequence(F.lit(20), F.lit(30)), lambda k: F.struct(k.cast("int").alias("level")))
    cells = K.grid_cells(d.filter("w = 1000000 or h = 1000000"), levels).groupBy("display_id", "_at.level").count()
    assert 0 < cells.agg(F.max("count")).first()[0] <= 4
    assert K.largest_overlap(w.limit(0), d, ["host"]).count() == 0 and K.largest_overlap(w, d.limit(0), ["host"]).count() == len(windows)


def test_names_inside(spark, rows):
    rng = random.Random(5)
    names = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["é🙂", "x é🙂 y"]
    wholes = ["".join(rng.choice("ab ") for _ in range(rng.choice([3, 20, 200]))) for _ in range(40)] + names[:10] + ["x é🙂 y"]
    a = spark.createDataFrame([(rng.choice([1, 2, None]), n) for n in names], "k int, name string")
    b = spark.createDataFrame([(rng.choice([1, 2, None]), n) for n in wholes], "k int, name string")
    got = rows(K.names_inside(a, b, ["k"]), "k", "part", "whole")
    want = {(x.k, x.name, y.name) for x in a.collect() for y in b.collect() if x.k == y.k and x.name and x.name in y.name}
    assert got == sorted(want, key=repr) and len(got) > 100
    long = spark.createDataFrame([(1, "".join(rng.choice("abcdefgh") for _ in range(200)))], "k int, name string")
    grams = long.select(F.explode(F.concat(*[K._grams(F.col("name"), n) for n in (1, 2, 3)])))
    assert grams.count() <= 3 * 200


@pytest.mark.parametrize("spread, accuracy", [(0.001, 10_000), (0.05, 100), (0.0, 1)])
def test_tails_by_selection(spark, spread, accuracy):
    rng = random.Random(6)
    data = [(k, rng.choice([rng.random() * 100, 5.0]) if rng.random() < 0.9 else None) for k, n in ((1, 3000), (2, 1), (3, 20), (None, 400)) for _ in range(n)]
    data += [(4, 7.0)] * 50 + [(5, None)]
    df = spark.createDataFrame(data, "k int, v double").repartition(5)
    got = {r.k: r for r in selected_tails(df, ["k"], "v", spread=spread, accuracy=accuracy).collect()}
    index = {"floor_n": lambda n: min(n - 1, int(n * 0.95)), "floor_n_minus_1": lambda n: int((n - 1) * 0.95), "ceil_n_minus_1": lambda n: -(-n * 95 // 100) - 1}
    values = {k: sorted(v for x, v in data if x == k and v is not None) for k in {k for k, _ in data}}
    assert set(got) == {k for k, v in values.items() if v} and set(index) == set(RANKS)
    for k, row in got.items():
        assert row.n == len(values[k])
        assert {r: row[f"p95_{r}"] for r in RANKS} == {r: values[k][at(len(values[k]))] for r, at in index.items()}


def test_payload_blocks(spark):
    rng = random.Random(7)
    data, raw = [], bytearray(rng.randbytes(3 * P.COMPARED_BYTES + 100))
    for i in range(12):
        for at in rng.sample(range(len(raw)), rng.choice([0, 1, 3, 40])):
            raw[at] = rng.randrange(256)
        data.append(("s", i, bytes(raw)))
    data += [("s", 12, b""), ("s", 13, b""), ("s", 14, None), ("s", 15, None), ("t", 16, b"x")]
    df = spark.createDataFrame(data, "k string, i long, payload binary")
    out = P.equivalent(df, ["k"], ["i"], "i", "payload")
    for (k, i, now), r in zip(data, out.orderBy("i").collect(), strict=True):
        before = next((p for q, j, p in data if (q, j) == (k, i - 1)), 0)
        if before == 0:
            assert r.equivalent is None and r.differing is None
        elif now is None or before is None or len(now) != len(before):
            assert r.equivalent == (now is before) and r.differing == (0 if now is before else None)
        else:
            n = sum(a != b for a, b in zip(now, before))
            assert (r.differing, r.equivalent) == (n, n <= 0.002 * len(now))


def test_equal_displays_meet_windows_once(spark, rows, monkeypatch):
    """A thousand displays at four places: four of them are dealt to cells, and the lowest id of a place wins."""
    dealt, cells = [], K.grid_cells

    def counted(rects, levels):
        dealt.append(rects.count())
        return cells(rects, levels)

    monkeypatch.setattr(K, "grid_cells", counted)
    w = spark.createDataFrame([("h", i, i * 10.0, 0.0, 50.0, 50.0) for i in range(20)], "host string, window_id long, x double, y double, w double, h double")
    d = spark.createDataFrame([("h", i, i % 4 * 100.0, 0.0, 100.0, 100.0) for i in range(999, -1, -1)],
                              "host string, display_id long, x double, y double, w double, h double")
    got = rows(K.largest_overlap(w, d, ["host"]), "window_id", "display_id")
    assert dealt == [20, 4]
    assert got == sorted([(i, (i * 10 + 25) // 100) for i in range(20)], key=repr)
