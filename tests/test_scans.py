"""Machines that never forget, over streams in very many pieces."""

import random

import numpy as np
import pytest

from cadencekit.operators import control, folds, scans
from cadencekit.operators.control import smooth_refresh


@pytest.fixture
def written(monkeypatch):
    """Counts the tables written on the way."""
    count = []
    real = scans.materialise
    for module in (scans, folds):
        monkeypatch.setattr(module, "materialise", lambda df: count.append(1) or real(df))
    return count


def published(rows, every):
    last, peak, out = None, 0.0, {}
    for time, row, level in sorted(rows):
        peak = max(peak, level or 0.0)
        if last is None or time - last >= every:
            out[row], last, peak = peak, time, 0.0
        else:
            out[row] = None
    return out


def test_chain_exits():
    entries, exits = scans.chain_exits(np.array([0, 0, 5, 9, 10, 11, 19, 20, 35]), 10)
    assert entries.tolist() == [0, 5, 9, 10] and exits.tolist() == [35, 35, 35, 35]
    entries, exits = scans.chain_exits(np.array([0, 4, 7, 12]), 10)
    assert entries.tolist() == [0, 4, 7, 12] and exits.tolist() == [12, 4, 7, 12]


def test_publications_over_pieces(spark, hot, written):
    hot(10)
    draw = random.Random(0)
    time, data = 0, []
    for row in range(1200):
        time += draw.choice([0, 0, 1, 3, 7, 20, 200] if row % 500 else [5000])
        data.append((time, row, draw.choice([None, draw.random(), float("nan")]) if draw.random() < 0.3 else draw.random()))
    small = [(t, r, 0.5) for t, r in ((0, 1), (5, 2), (30, 3))]
    table = [("hot", *r) for r in data] + [(None, *r) for r in data[::2]] + [("calm", *r) for r in small]
    df = spark.createDataFrame(table, "k string, us long, id long, level double")
    clean = lambda rows: [(t, r, v if v == v else None) for t, r, v in rows]
    near = control.PublishPeaks("us", "level", every=17)
    got = {(r.k, r.id): r.published for r in folds.fold(df, ["k"], ["us", "id"], near, near.columns).collect()}
    assert got == {(k, r): v for k, rows in (("hot", data), (None, data[::2]), ("calm", small)) for r, v in published(clean(rows), 17).items()}
    # Ten rounds of doubling at most (three tables each) for some hundreds of pieces, and a fixed number of others.
    assert len(written) <= 3 * 10 + 8


def test_smoothing_runs_each_piece_once(spark, hot, written, monkeypatch):
    hot(10)
    draw = random.Random(5)
    data = [("hot", i, draw.choice([None, -1.0, 0.0, draw.uniform(20, 300), 60.0]), draw.choice([60.0, 120.0])) for i in range(800)]
    df = spark.createDataFrame(data, "k string, id long, hz double, max_hz double")
    got = {r.id: r.refresh_hz for r in smooth_refresh(df, ["k"], ["id"]).collect()}
    level = 0.0
    for _, i, hz, top in data:
        if hz is not None and hz > 0:
            hz = min(hz, top)
            level = hz if level == 0 else level * 0.8 + hz * 0.2
        assert got[i] == pytest.approx(level, rel=1e-12)
    assert len(written) <= 6
