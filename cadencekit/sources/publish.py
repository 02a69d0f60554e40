"""Tables published by a manifest: data first, then one row that makes it visible.

A publication writes its files to a folder of its own, ``data/publication=<token>``, which no one reads yet, and then appends
one row, one small file, to ``manifest``.  Readers take the folders that the manifest names since the last row that
replaces what was there, so they see a publication as a whole or not at all, also if the writer stops at any step: what it
left behind has no row.  A micro-batch that is tried again finds its number in the manifest and does nothing.  One writer
at a time is assumed, as with any checkpointed stream.  Only Spark's readers and writers are used, so any store will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version long, publication string, replaces boolean, writer string, batch_id long, fields string, published string"
PUBLICATION = "publication"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each publication; none if nothing was published."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The publications that make up the table now: the last replacing one and those after it."""
    rows = manifest(spark, path)
    since = rows.filter("replaces").agg(F.max("version")).first()[0] or 0
    return rows.filter(F.col("version") >= since)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table as published.  Folders without a row in the manifest are not read."""
    rows = current(spark, path)
    last = rows.orderBy(F.col("version").desc()).select("fields").first()
    if last is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    fields = T.StructType.fromJson(json.loads(last["fields"]))
    data = spark.read.schema(T.StructType([*fields.fields, T.StructField(PUBLICATION, T.StringType())])).parquet(f"{path}/data")
    return data.join(F.broadcast(rows.select(PUBLICATION)), PUBLICATION, "left_semi").select(*[F.col(f"`{f.name}`") for f in fields.fields])


def publish(df: DataFrame, path: str, replaces: bool = True, writer: str | None = None, batch_id: int | None = None,
            partition_by: Sequence[str] = (), write: Callable[[DataFrame, str], None] | None = None) -> bool:
    """Publish a frame, in place of what was there or beside it; False if this writer's batch is already published."""
    spark = df.sparkSession
    rows = manifest(spark, path)
    if batch_id is not None and not rows.filter(F.col("writer").eqNullSafe(writer) & (F.col("batch_id") == batch_id)).isEmpty():
        return False
    token = uuid.uuid4().hex
    write = write or (lambda frame, folder: frame.write.partitionBy(*partition_by).parquet(folder))
    write(df, f"{path}/data/{PUBLICATION}={token}")
    version = (rows.agg(F.max("version")).first()[0] or 0) + 1
    row = spark.createDataFrame([(version, token, replaces, writer, batch_id, df.schema.json())], MANIFEST.rsplit(",", 1)[0])
    row.withColumn("published", iso_date(F.current_timestamp())).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return True


def publish_batches(path: str, writer: str, change: Callable[[DataFrame], DataFrame] = lambda df: df,
                    partition_by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch is published once, however often it is tried."""
    def write(batch: DataFrame, batch_id: int) -> None:
        publish(change(batch), path, False, writer, batch_id, partition_by)
    return write


def iso_date(at: F.Column) -> F.Column:
    """ISO 8601 text of an instant, to the second, in UTC."""
    utc = F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
