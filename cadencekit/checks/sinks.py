"""Checks of the sinks: what was published is read back, also after a writer that stopped half-way."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cadencekit.checks.base import EVENTS_SQL, LOG_START_US, Check, events
from cadencekit.checks.joins import DAY_US
from cadencekit.checks.live import live_events
from cadencekit.session import checkpoint_base
from cadencekit.sources import sinks
from cadencekit.sources.publish import publish, publish_batches, read_published


def folder(spark):
    return f"{checkpoint_base(spark)}/published-{uuid.uuid4().hex}"


def dated_records(spark, d):
    """Diagnostics of a stream, published batch by batch, with their date."""
    path, tick = folder(spark), F.floor(F.col("us") / (DAY_US // 4)).cast("long")
    odd = F.when(F.col("k") % 7 == 0, float("nan")).when(F.col("k") % 7 == 1, float("-inf")).otherwise(F.col("value"))
    ev = live_events(spark, d).select("stream_id", "event_id", odd.alias("value"), tick.alias("tick"), (F.col("event_type") != "signup").alias("active"),
                                      F.timestamp_micros(F.col("us") + LOG_START_US).alias("at"))
    sinks.stream_diagnostics(ev, f"{path}/table", f"{path}/checkpoint", at="at").trigger(availableNow=True).start().awaitTermination()
    field = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind).alias(name)
    return read_published(spark, f"{path}/table").select(field("event_id", "long"), field("value", "double"), field("date", "string"))


def replaced_output(spark, d):
    """A table, the same after a writer that fails half-way, and after one that ends."""
    path = folder(spark)
    counts = events(spark, d).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    publish(counts.filter("stream_id % 3 = 0"), path)
    broken = counts.withColumn("n", F.when(F.col("stream_id") % 2 == 1, F.raise_error(F.lit("the writer stops here")).cast("long")).otherwise(F.col("n")))
    try:
        publish(broken, path)
    except PySparkException:
        pass
    else:
        raise RuntimeError("the broken publication went through")
    kept = read_published(spark, path).withColumn("step", F.lit("failed"))
    publish(counts, path)
    return kept.unionByName(read_published(spark, path).withColumn("step", F.lit("ended")))


def published_fragments(spark, d):
    """Fragments of a day, published in two batches, of which one is tried twice."""
    path = folder(spark)
    cut = sinks.with_fragment(events(spark, d).withColumn("pts_ns", F.col("us") * 1000), seconds=86400)
    write = publish_batches(path, "fragments", partition_by=["fragment"])
    for batch_id, half in ((0, 0), (0, 0), (1, 1)):
        write(cut.filter(F.col("event_id") % 2 == half).select("stream_id", "event_id", "fragment"), batch_id)
    return read_published(spark, path).groupBy("stream_id", "fragment").agg(F.count(F.lit(1)).alias("n_rows"), F.max("event_id").alias("last_id"))


CHECKS = {
    "a4_dated_stream": Check(dated_records, f"""
WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k % 7 < 2 THEN 0 ELSE value END AS value,
  strftime(make_timestamp(us + {LOG_START_US}), '%Y-%m-%dT%H:%M:%SZ') AS date
FROM ev WHERE event_type <> 'signup' AND us // {DAY_US // 4} % 5 = 0"""),
    "a5_replace_on_success": Check(replaced_output, f"""
WITH {EVENTS_SQL}, c AS (SELECT stream_id, count(*) AS n, max(value) AS top FROM ev GROUP BY 1)
SELECT *, 'failed' AS step FROM c WHERE stream_id % 3 = 0 UNION ALL SELECT *, 'ended' FROM c"""),
    "a6_published_fragments": Check(published_fragments, f"""
WITH {EVENTS_SQL} SELECT stream_id, us // {DAY_US} AS fragment, count(*) AS n_rows, max(event_id) AS last_id FROM ev GROUP BY 1, 2"""),
}
