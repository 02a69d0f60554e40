"""Mixing sources to target weights: repetition rates per source, then whole and hash-seeded copies.

Null sources form a source of their own, last in order.  Null texts have size 0.  A source of size 0
has target 0 and is taken 0 times.  Repeated rows are documents of their own: each draws by its id, its text's digest and its
number among the rows that share id, text and source, so reruns agree, whatever the order of the rows, and sources whose rows
have no id or the same one come as near their targets as others.  Long texts only count and are hashed.  There are no ties.
Other columns may have any names.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadencekit.llm.common import WORD, neutral, numbered
from cadencekit.operators.ordered import join_on
from cadencekit.session import materialise


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source of ``sizes`` (source, size): ``source_size``, ``target`` and ``rate``.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes.
    A target stops at ``most`` times its source's size; the excess is shared anew by weight.  Each
    round of the sharing is one aggregation to three numbers and closes at least one more source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    sources = materialise(numbered(totals, [F.col("source").asc_nulls_last()])
                          .select("source", "source_size", turn.cast("double").alias("weight")))
    cap = F.col("source_size") * most
    whole, open_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    closed, level = 0, 0.0
    while open_weight:
        level = float((whole or 0) - closed) / open_weight
        full = cap <= F.col("weight") * level
        now_closed, now_open = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
                                           F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if (now_closed, now_open) == (closed, open_weight):
            break
        closed, open_weight = now_closed, now_open
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", target.alias("target"),
                          F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def draw(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of seed and keys; null keys are empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(key.cast("string"), F.lit("")) for key in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def with_number(rows: DataFrame, twice: DataFrame, same: list[str], name: str = "_nth") -> DataFrame:
    """Adds the number of each row among those with equal ``same``, from 0, in any order.

    ``twice`` has the values of ``same`` that come more than once.  Such rows are set apart in a table of their own and
    numbered within its partitions; the counts by partition give the offsets, so no group has to fit in a task.
    """
    if twice.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    apart = materialise(join_on(rows, twice, same, "left_semi")).withColumn("_part", F.spark_partition_id())
    counts = apart.groupBy(*same, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each value and partition.
    before = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*same, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*same, "_part").orderBy(F.lit(0))) - 1
    given = join_on(apart.withColumn("_inside", inside), offsets, [*same, "_part"])
    given = given.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_part", "_inside", "_offset")
    return join_on(rows, twice, same, "left_anti").withColumn(name, F.lit(0).cast("long")).unionByName(given)


def with_copies(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """``rows`` (with ``_key``, ``_digest`` and ``source``) and ``_copies``, the number of copies the mix takes: the whole part of
    the rate, plus one with the fraction as probability.  ``sized`` has these and ``size`` for every document."""
    same = ["_key", "_digest", "source"]
    rates = source_rates(sized, weights, most).withColumnsRenamed(
        {"source_size": "_source_size", "target": "_target", "rate": "_rate"})
    twice = materialise(sized.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*same))
    whole = F.floor("_rate")
    extra = draw(F.col("_key"), F.col("_digest"), F.col("_nth"), seed=seed) < F.col("_rate") - whole
    return join_on(with_number(rows, twice, same), rates, ["source"]).withColumn("_copies", (whole + F.when(extra, 1).otherwise(0)).cast("int"))


def _marked(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.withColumns({"_key": F.col(key), "_digest": F.md5(body.cast("binary")), "source": F.col(source), "size": word_count(body)})


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The mixed documents themselves, each row as often as the mix takes it."""
    inner = neutral(docs, key, text, source)
    own = [F.col(c).alias(n) for c, n in ((key, "k"), (text, "t"), (source, "s"))]
    marked = _marked(inner.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(inner.columns)], *own), "k", "t", "s").drop("k", "t", "s")
    sized = materialise(marked.select("_key", "_digest", "source", "size"))
    taken = with_copies(marked, sized, weights, most, seed)
    return (taken.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*[f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns))


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
               weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """Per document: size, its source's size and target, and the words taken from it."""
    sized = materialise(_marked(docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("s")), "k", "t", "s")
                        .select("_key", "_digest", "source", "size"))
    taken = with_copies(sized, sized, weights, most, seed)
    return taken.select(F.col("_key").alias("doc_id"), "size", F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).alias("taken"))
