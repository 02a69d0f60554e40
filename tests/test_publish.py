"""Publication by manifest: a writer that stops at any step leaves the table as it was."""

import pytest
from pyspark.sql import functions as F

from cadencekit.sources import publish as P
from cadencekit.sources import sinks


def values(spark, path):
    return sorted(r.x for r in P.read_published(spark, path).collect())


class Stop(Exception):
    pass


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert P.publish(spark.range(3).toDF("x"), path)
    return path


def test_nothing_is_published_yet(spark, tmp_path):
    assert P.manifest(spark, str(tmp_path / "none")).isEmpty()
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, str(tmp_path / "none"))


def test_stops_at_every_step(spark, table, monkeypatch):
    def before(frame, folder):
        raise Stop

    def half(frame, folder):
        frame.limit(2).write.parquet(folder)
        raise Stop

    for write in (before, half):
        with pytest.raises(Stop):
            P.publish(spark.range(9).toDF("x"), table, write=write)
        assert values(spark, table) == [0, 1, 2]

    def late(at):  # all data written, the manifest's row not yet
        raise Stop

    with monkeypatch.context() as m:
        m.setattr(P, "iso_date", late)
        with pytest.raises(Stop):
            P.publish(spark.range(9).toDF("x"), table)
    assert values(spark, table) == [0, 1, 2]
    assert P.publish(spark.range(5).toDF("x"), table)
    assert values(spark, table) == [0, 1, 2, 3, 4]
    assert [r.version for r in P.manifest(spark, table).orderBy("version").collect()] == [1, 2]


def test_batches_are_published_once(spark, table):
    write = P.publish_batches(table, "stream-1")
    for batch_id, x in ((0, 10), (0, 10), (1, 11), (0, 10), (1, 11)):
        write(spark.createDataFrame([(x,)], "x long"), batch_id)
    P.publish_batches(table, "stream-2")(spark.createDataFrame([(20,)], "x long"), 0)
    assert values(spark, table) == [0, 1, 2, 10, 11, 20]
    P.publish(spark.range(1).toDF("x"), table)
    assert values(spark, table) == [0] and P.current(spark, table).count() == 1


def test_empty_tables_and_partitions(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = spark.createDataFrame([(1, "a b", 2), (2, None, 3)], "`x` long, `odd name.` string, part long")
    P.publish(rows.limit(0), path, partition_by=["part"])
    assert P.read_published(spark, path).dtypes == rows.dtypes and P.read_published(spark, path).isEmpty()
    P.publish(rows, path, replaces=False, partition_by=["part"])
    assert sorted(map(tuple, P.read_published(spark, path).collect())) == [(1, "a b", 2), (2, None, 3)]


def test_dates_are_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        row = spark.range(1).select(P.iso_date(F.timestamp_seconds(F.lit(1_704_067_261)))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row[0] == "2024-01-01T00:01:01Z"


def test_diagnostics_of_a_stream(spark, tmp_path):
    schema = "stream_id long, tick long, active boolean, fps double"
    for n in range(2):
        spark.createDataFrame([(n, t, t != 10, float("nan") if t == 5 else 30.0) for t in range(12)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        sinks.stream_diagnostics(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r.value for r in P.read_published(spark, str(tmp_path / "out")).collect())
    assert got == sorted(f'{{"active":true,"fps":{fps},"stream_id":{n},"tick":{t}}}' for n in range(2) for t, fps in ((0, 30.0), (5, 0.0)))
