"""Shared pieces of the registered checks: table access and the sample view of ``events``.

A check is a Spark query over the driver's tables and, where SQL can say the same, its oracle text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadencekit.operators.ordered import Ordered, Running, ordered

# The first instant of the event log and the length of one epoch, microseconds.
LOG_START_US = 1_704_067_200_000_000
EPOCH_US = 15 * 86_400_000_000
TICK_NS = 33_333_333
HOLE_NS = 300_000_000


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    """Rounded as the oracle does, which keeps the sign of a zero."""
    c = F.col(c) if isinstance(c, str) else c
    rounded = F.round(c, 6)
    return F.when(rounded == 0, c * 0.0).otherwise(rounded)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``us`` since the start of the log and the number ``k`` from ``props``."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), "event_id", "event_type", "value",
        (F.unix_micros(F.col("ts").cast("timestamp")) - LOG_START_US).alias("us"),
        F.get_json_object("props", "$.k").cast("long").alias("k"))


EVENTS_SQL = f"""
ev AS (
  SELECT user_id AS stream_id, event_id, event_type, value,
         epoch_us(ts) - {LOG_START_US} AS us,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)
"""


def event_stream(spark: SparkSession, sf_dir: str) -> Ordered:
    return ordered(events(spark, sf_dir), ["stream_id"], ["us", "event_id"])


def samples(spark: SparkSession, sf_dir: str) -> Ordered:
    """Events as 30 Hz samples with occasional bad stamps, jumps, gaps and layout changes."""
    s = event_stream(spark, sf_dir)
    low = F.col("value") < 25
    s = s.running(n=Running("count", F.lit(1)),
                  skips=Running("count", F.when((F.col("k") == 19) & low, 1)),
                  holes=Running("count", F.when((F.col("k") == 29) & low, 1)))
    raw = F.col("n") * TICK_NS + F.col("k") % 5 * 100_000 + F.col("holes") * HOLE_NS
    paired = F.concat(F.lit("f"), F.floor(F.col("n") / 2).cast("string"))
    return s.select(
        "us", "event_id", "value", "k", "n",
        raw.alias("raw_ns"),
        F.when(~((F.col("k") == 13) & low), raw).alias("pts_ns"),
        F.floor(F.col("us") / EPOCH_US).cast("long").alias("epoch"),
        (F.col("n") + F.col("skips")).alias("seq"),
        F.when((F.col("k") == 21) & low, 640).otherwise(1280).alias("width"),
        F.lit(720).alias("height"),
        F.when((F.col("k") == 17) & low, "RGB").otherwise("420v").alias("pixel_format"),
        F.lit(2).alias("plane_count"),
        F.when(F.col("stream_id") % 2 == 0, paired).otherwise(F.col("event_type")).alias("content"),
        F.when(F.col("stream_id") % 2 == 0, paired)
        .when(F.col("event_type").isin("click", "view"), "cv")
        .otherwise(F.col("event_type")).alias("near"))


SAMPLES_SQL = EVENTS_SQL + f""",
numbered AS (
  SELECT *, row_number() OVER w AS n,
         count(*) FILTER (WHERE k = 19 AND value < 25) OVER w AS skips,
         count(*) FILTER (WHERE k = 29 AND value < 25) OVER w AS holes
  FROM ev
  WINDOW w AS (PARTITION BY stream_id ORDER BY us, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
samples AS (
  SELECT stream_id, us, event_id, value, k, n,
         n * {TICK_NS} + k % 5 * 100000 + holes * {HOLE_NS} AS raw_ns,
         CASE WHEN NOT (k = 13 AND value < 25)
              THEN n * {TICK_NS} + k % 5 * 100000 + holes * {HOLE_NS} END AS pts_ns,
         us // {EPOCH_US} AS epoch, n + skips AS seq,
         CASE WHEN k = 21 AND value < 25 THEN 640 ELSE 1280 END AS width, 720 AS height,
         CASE WHEN k = 17 AND value < 25 THEN 'RGB' ELSE '420v' END AS pixel_format,
         2 AS plane_count,
         CASE WHEN stream_id % 2 = 0 THEN 'f' || CAST(n // 2 AS VARCHAR) ELSE event_type END AS content,
         CASE WHEN stream_id % 2 = 0 THEN 'f' || CAST(n // 2 AS VARCHAR)
              WHEN event_type IN ('click', 'view') THEN 'cv' ELSE event_type END AS near
  FROM numbered)
"""
