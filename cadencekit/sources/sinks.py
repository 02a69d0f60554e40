"""Sinks: diagnostics records, replace-on-success output and crash-safe fragments."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencekit.sources.publish import iso_date, publish_batches

def diagnostics(df: DataFrame, tick: str = "tick", active: str = "active", every: int = 5, at: str | None = None) -> DataFrame:
    """One JSON record per active stream on every ``every``-th tick; non-finite numbers become 0.  The instant ``at``, if
    there is one, is written as the ISO text ``date``."""
    due = df.filter(F.col(active) & (F.col(tick) % every == 0))
    if at is not None:
        due = due.withColumn("date", iso_date(F.col(at))).drop(at)
    safe = []
    for field in sorted(due.schema.fields, key=lambda f: f.name):
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            odd = F.isnan(column) | (F.abs(column) == float("inf"))
            column = F.when(odd, F.lit(0.0)).otherwise(column)
        safe.append(column.alias(field.name))
    record = F.to_json(F.struct(*safe), {"ignoreNullFields": "false"})
    return due.select(record.alias("value"))


def write_diagnostics(df: DataFrame, path: str, every: int = 5, tick: str = "tick", active: str = "active") -> None:
    diagnostics(df, tick, active, every).write.mode("append").text(path)


def stream_diagnostics(stream: DataFrame, path: str, checkpoint: str, writer: str = "diagnostics", **options):
    """Diagnostics of a stream, published once for each micro-batch; returns the stream's writer, not yet started."""
    publish_each = publish_batches(path, writer, lambda batch: diagnostics(batch, **options))
    return stream.writeStream.foreachBatch(publish_each).option("checkpointLocation", checkpoint)


def _files(df: DataFrame, path: str):
    session = df.sparkSession
    jvm, conf = session._jvm, session._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def replace_output(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] | None = None) -> None:
    """Write beside the target and swap only on success; a failure leaves the old output alone."""
    write = write or (lambda frame, where: frame.write.mode("error").parquet(where))
    fs, make = _files(df, path)
    token = uuid.uuid4().hex[:12]
    target, staged, old = make(path), make(f"{path}.staging-{token}"), make(f"{path}.old-{token}")
    try:
        write(df, staged.toString())
        had_old = fs.exists(target)
        if had_old and not fs.rename(target, old):
            raise OSError(f"cannot move the old output at {path} aside")
        if not fs.rename(staged, target):
            if had_old:
                fs.rename(old, target)
            raise OSError(f"cannot move the new output to {path}")
        if had_old:
            fs.delete(old, True)
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)


def replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: each micro-batch owns one partition, so a retry rewrites only it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    return write


def with_fragment(df: DataFrame, pts: str = "pts_ns", seconds: int = 10) -> DataFrame:
    """Number of the ten-second fragment a row belongs to."""
    return df.withColumn("fragment", F.floor(F.col(pts) / (seconds * 1_000_000_000)).cast("long"))


def write_fragments(df: DataFrame, path: str, seconds: int = 10, pts: str = "pts_ns",
                    keys: tuple[str, ...] = ("stream_id",)) -> None:
    """Append rows under one folder per fragment, so finished fragments survive a crash.

    Rows are clustered by key and fragment first to avoid tiny files; the rebalance splits clusters
    that are too large for one task.
    """
    cut = with_fragment(df, pts, seconds)
    clustered = cut.hint("rebalance", *[F.col(k) for k in keys], F.col("fragment"))
    clustered.write.mode("append").partitionBy("fragment").parquet(path)
