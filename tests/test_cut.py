"""A stream above the row limit is cut; no result may change."""

import random

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from cadencekit.checks import registry
from cadencekit.operators.asof import asof
from cadencekit.operators.ordered import Running, ordered
from cadencekit.operators.quality import exact_tail
from cadencekit.session import checkpoint_base

SF_DIR = "/root/testdata/sf0.001"
NAMES = ("w1_interval", "w4_epochs", "w7_trailing_frames", "w8_cadence_state", "w11_bounded_buffer", "c2_unique_pairs",
         "c3_evidence_asof", "d3_interval_p95", "d5_delivered_rate", "w10_stable_rate", "w24_decay_meter", "g1_timeline")


@pytest.mark.parametrize("name", NAMES)
def test_cut_equals_oracle(spark, hot, name):
    hot(9)
    assert differences(registry()[name].run(spark, SF_DIR), connect(SF_DIR), registry()[name].sql) == []


def skewed(spark):
    """One stream with a third of all rows, many of them at one instant."""
    rng = random.Random(3)
    rows = [("hot", 50 if i % 2 else rng.randrange(1000), i, rng.random()) for i in range(400)]
    rows += [(f"s{i % 40}", rng.randrange(1000), i, rng.random()) for i in range(400, 1200)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t long, id long, v double"), rows


def test_hot_stream_and_hot_instant_are_split(spark, hot):
    hot(30)
    df, _ = skewed(spark)
    s = ordered(df, ["k"], ["t", "id"])
    assert s.cut
    assert s.df.groupBy(*s.part).count().agg(F.max("count")).first()[0] <= 30


def test_infinite_and_missing_numbers_are_cut_too(spark, hot):
    hot(30)
    odd = {0: float("inf"), 1: float("nan"), 2: float("-inf"), 3: 1e308, 4: -1e308}
    rows = [("hot", odd.get(i % 50, float(i)), i) for i in range(600)]
    s = ordered(spark.createDataFrame(rows, "k string, t double, id long"), ["k"], ["t", "id"])
    assert s.cut and s.df.groupBy(*s.part).count().agg(F.max("count")).first()[0] <= 30
    got = {r.id: r.n for r in s.running(n=Running("count", F.lit(1))).done().collect()}
    rank = {i: n + 1 for n, (_, _, i) in enumerate(sorted(rows, key=lambda r: (r[1] != r[1], r[1] if r[1] == r[1] else 0, r[2])))}
    assert got == rank


class Away:
    """A session of a cluster, as far as the checkpoint folder goes."""

    def __init__(self, **settings):
        self.sparkContext, self.conf, self.folder, self.master = self, settings, None, "spark://somewhere:7077"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_no_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_base(Away())


def test_the_shared_folder_is_taken_from_the_session():
    assert checkpoint_base(Away(**{"spark.checkpoint.dir": "store://shared/x"})) == "store://shared/x"


def test_running_and_frames_match_plain_python(spark, hot):
    hot(30)
    df, data = skewed(spark)
    s = ordered(df, ["k"], ["t", "id"])
    s = s.running(total=Running("count", F.lit(1)), top=Running("max", F.col("v")), left=Running("count", F.lit(1), False))
    s = s.running(desc=True, after=Running("count", F.lit(1)))
    s = s.previous(before=F.col("id")).trailing_rows(40, best=lambda w: F.max("v").over(w))
    s = s.trailing_span("t", 100, near=lambda w: F.count("*").over(w))
    got = {r.id: r for r in s.done().collect()}
    assert len(got) == len(data)
    streams = {}
    for row in data:
        streams.setdefault(row[0], []).append(row)
    for stream in streams.values():
        stream.sort(key=lambda r: (r[1], r[2]))
        for i, (_, t, key, _) in enumerate(stream):
            r = got[key]
            assert (r.total, r.left or 0, r.after) == (i + 1, i, len(stream) - i)
            assert r.top == max(x[3] for x in stream[:i + 1])
            assert r.before == (stream[i - 1][2] if i else None)
            assert r.best == max(x[3] for x in stream[max(0, i - 39):i + 1])
            assert r.near == sum(t - 100 < x[1] <= t for x in stream)


def test_partitions_and_row_order_do_not_matter(spark):
    from cadencekit.checks.streams import cadence_state

    plain = sorted(map(repr, cadence_state(spark, SF_DIR).collect()))
    for partitions in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert sorted(map(repr, cadence_state(spark, SF_DIR).collect())) == plain
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_exact_tail_of_a_hot_key(spark, hot):
    hot(20)
    df, data = skewed(spark)
    for rank, index in (("floor_n", lambda n: min(n - 1, int(n * 0.95))), ("floor_n_minus_1", lambda n: int((n - 1) * 0.95)),
                        ("ceil_n_minus_1", lambda n: -(-n * 95 // 100) - 1)):
        got = {r.k: r.p95 for r in exact_tail(df, ["k"], "v", rank).collect()}
        for k in {r[0] for r in data}:
            values = sorted(r[3] for r in data if r[0] == k)
            assert got[k] == values[index(len(values))]


@pytest.mark.parametrize("forward", [False, True])
def test_asof_matches_brute_force(spark, hot, forward):
    hot(25)
    df, data = skewed(spark)
    left = df.filter("id % 2 = 0")
    right = df.filter("id % 2 = 1").select("k", F.col("t").alias("rt"), F.col("id").alias("rid"))
    got = {r.id: (r.asof_time, r.asof_rid) for r in asof(left, right, ["k"], "t", "rt", ["rid"], tie="rid", forward=forward).collect()}
    for k, t, key, _ in data:
        if key % 2:
            continue
        found = [(x[1], x[2]) for x in data if x[0] == k and x[2] % 2 and (x[1] >= t if forward else x[1] <= t)]
        assert got[key] == ((min(found) if forward else max(found)) if found else (None, None))
