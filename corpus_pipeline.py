"""A training corpus from ``documents``: language ID, near-dedup, secrets, mixing, packing.

Each stage works on all rows that the one before kept.  Null texts are rejected by the first stage; empty
tables give empty results; extra columns, whatever their names, travel along up to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadencekit.llm import language, mixing, packing, secret_scan, simhash
from cadencekit.llm.common import held_out, neutral
from cadencekit.session import checkpoint_base


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage: Callable) -> Callable:
    """A stage whose other columns have neutral names inside, so that they can't clash with what it adds."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = neutral(docs, *COLUMNS)
        return stage(spark, inner, sf_dir).select(*inner.columns).toDF(*docs.columns)
    return run


@carrying
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without a letter or far from every language go."""
    trained = language.train(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    found = language.identify(docs, trained, prefix="_")
    return found.where(~F.col("_rejected"))


@carrying
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group, that of least id (null last), then of least hash of its text; ids may repeat."""
    keepers = simhash.least_rows(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = docs["doc_id"].cast("long").eqNullSafe(keepers["_id"]) & (F.xxhash64(docs["text"].cast("string")) == keepers["_hash"])
    kept = docs.join(keepers, same, "left_semi")
    again = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    return kept.withColumn("_again", again).where("_again = 1")


@carrying
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark; ``n_chars`` follows the text."""
    found = secret_scan.scan(docs, secret_scan.train(docs))
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("_spans")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.size("_spans") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean


@carrying
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [("language", identify_language), ("near_dedup", drop_near_duplicates), ("secrets", redact_secrets),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: The models of the first and third stage can't be said in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_base(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
