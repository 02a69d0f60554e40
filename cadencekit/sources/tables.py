"""Readers that turn raw tables into the library's tables, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencekit.functions.values import rational_ns
from cadencekit.sources.schema import SAMPLES, SETTING_DEFAULTS, SETTINGS


def with_pts(df: DataFrame, value: str = "pts_value", scale: str = "pts_scale") -> DataFrame:
    """``pts_ns`` from a rational time and ``pts_valid``; an invalid time has no ``pts_ns``."""
    df = df.withColumn("pts_ns", rational_ns(value, scale))
    return df.withColumn("pts_valid", F.col("pts_ns").isNotNull())


def read_samples(spark: SparkSession, path: str, schema: T.StructType | str = SAMPLES, stream: bool = False,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Samples from Parquet with an explicit schema; times and digests are filled in if missing."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.readStream if stream else spark.read
    reader = reader.schema(schema)
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.parquet(path)
    names = set(schema.names)
    if {"pts_ns", "pts_value", "pts_scale"} <= names:
        df = df.withColumn("pts_ns", F.coalesce("pts_ns", rational_ns("pts_value", "pts_scale")))
    if {"content_hash", "payload"} <= names:
        df = df.withColumn("content_hash", F.coalesce("content_hash", F.xxhash64("payload")))
    return df


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw picture files as payload rows; the file name is the sample's key."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("sample_path"), F.col("length").alias("n_bytes"),
                        F.xxhash64("content").alias("content_hash"), F.col("content").alias("payload"))


def delivered(df: DataFrame, status: str = "status", picture: str = "has_picture") -> DataFrame:
    """Mark rows ``kept`` (complete with a picture) or ``dropped`` (idle); others are left out."""
    kept = (F.col(status) == "complete") & F.col(picture)
    outcome = F.when(kept, "kept").when(F.col(status) == "idle", "dropped")
    return df.withColumn("delivery", outcome).filter(F.col("delivery").isNotNull())


def read_settings(df: DataFrame, column: str = "json") -> DataFrame:
    """Settings records as columns: missing fields take defaults, force needs a running mode."""
    parsed = df.withColumn("_s", F.from_json(column, SETTINGS)).drop(column)
    filled = parsed.select(
        *[c for c in parsed.columns if c != "_s"],
        *[F.coalesce(F.col(f"_s.{n}"), F.lit(d)).alias(n) for n, d in SETTING_DEFAULTS.items()])
    return filled.withColumn("force", F.col("force") & (F.col("mode") != "off"))
