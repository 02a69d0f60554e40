"""Shared helpers of the training-data operators: words, splits, positions, components."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadencekit.session import materialise

# Fixed value: a word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; ``bytes.split`` cuts at exactly the characters that ``WORD`` excludes."""
    return text.split()


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [value or b"" for value in batch.column(name).cast(pa.binary()).to_pylist()]


def text_parts(batch: pa.RecordBatch, size: int = 2_000_000):
    """Slices of a batch whose texts have about ``size`` bytes, or a longer one."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts and the empty one, which is a text's end; the tokens, by number; the texts' first places."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes, flat = pc.list_value_length(split).to_numpy().astype(np.int64), split.flatten()
    # White space at a text's ends gives empty words.
    real = pc.binary_length(flat).to_numpy() > 0
    if not real.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        flat = flat.filter(pa.array(real))
    flat = flat.dictionary_encode()
    kinds = flat.dictionary.cast(pa.binary())
    starts = np.cumsum(sizes + 1) - sizes - 1
    tokens = np.full(len(flat) + len(sizes), len(kinds), np.int64)
    inner = np.ones(len(tokens), bool)
    inner[starts + sizes] = False
    tokens[inner] = flat.indices.to_numpy()
    return pa.concat_arrays([kinds, pa.array([b""], pa.binary())]), tokens, starts


def neutral(docs: DataFrame, *used: str) -> DataFrame:
    """The table with other names for all columns but ``used``, so that none clashes with a column that an operator adds;
    ``toDF(*docs.columns)`` gives them back."""
    return docs.toDF(*[c if c in used else f"__other{i}" for i, c in enumerate(docs.columns)])


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """True for the rows whose crc32 of the key as text has the remainder; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def unit_hash(*columns: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of the columns; the same on every run."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Adds the position of each row in a total order, from 0, without gathering rows in one task.

    Rows are dealt out by range and numbered within each range; the ranges' counts, one row a
    partition, give the offsets.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each shuffle partition: bounded by the session's setting, whatever the input.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_range")
            .withColumn(name, F.col("_offset") + F.col("_inside")).drop("_range", "_inside", "_offset"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): ``node`` and ``root``, the least node it reaches.

    Each round hooks every node to the least of its neighbours and contracts the graph, which at least
    halves the nodes that are left; the rounds' maps are then composed backwards.  Rounds grow with
    the logarithm of the largest component.  Nodes without links to others are not returned.
    """
    edges = materialise(links.where("a <> b").select("a", "b").distinct())
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy(F.col("a").alias("node"))
                           .agg(F.least(F.col("node"), F.min("b")).alias("root")))
        hooks.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = hook.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = materialise(edges.join(left, "a").join(right, "b").where("x <> y")
                            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = hooks.pop()
    while hooks:
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("_final"))
        roots = (hooks.pop().join(later, "root", "left")
                 .select("node", F.coalesce("_final", "root").alias("root")))
    return roots


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcasts a value whose class need not be installed on the executors; see ``opened``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast):
    return pickle.loads(shared.value)


def record_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000):
    """Arrow batches of at most ``size`` rows from tuples."""
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) >= size:
            yield _batch(waiting, schema)
            waiting = []
    if waiting:
        yield _batch(waiting, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(columns, schema, strict=True)], schema=schema)
