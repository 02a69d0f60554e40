"""What the sort of triples leaves on disk."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from cadencekit.llm import suffix_array
from cadencekit.session import materialise_and_free


def shuffled(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for folder in folders for p in Path(folder).rglob("shuffle_*")}


def gone(spark, before):
    for _ in range(50):
        if not shuffled(spark) - before:
            return True
        time.sleep(0.2)
    return False


def test_freed_shuffles(spark):
    before, setting = shuffled(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = materialise_and_free(df)
    assert gone(spark, before) and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    # The frame itself still answers.
    assert df.count() == 7


def test_triples_are_gone_before_the_texts_are_shuffled(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 5).alias("text"))
    before = shuffled(spark)
    found = suffix_array.remove_repeats(df)
    assert gone(spark, before)
    assert found.count() == 60
