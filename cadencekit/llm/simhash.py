"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Null texts count as empty: fingerprint zero, linked like any other.  Repeated rows and equal texts share a
fingerprint, so only different fingerprints are compared.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadencekit.llm.common import binary_column, components, words
from cadencekit.session import materialise

BITS = 64
BLOCK_SHINGLES = 1 << 16


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the hashes of the text's shingles of ``width`` words."""
    parts = words(text.lower())
    if not parts:
        return 0
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) < width:
        starts, ends = [0], [len(joined)]
    else:
        starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
        ends = ends[width - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(ends), BLOCK_SHINGLES):
        block = slice(at, at + BLOCK_SHINGLES)
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[block], ends[block])],
                          np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint``, the 64 bits as a long, and ``text_hash``, also a long, of every whole text."""
    def run(batches):
        for batch in batches:
            prints = [simhash(body, width, seed) for body in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64()), batch.column("text_hash")],
                                             names=["doc_id", "fingerprint", "text_hash"])

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fingerprint long, text_hash long")


def _ball(value: Column, bits: int, radius: int) -> Column:
    """A segment's value and, for radius 1, its values with one set bit cleared: of two values that differ in one
    bit, one finds the other so."""
    cleared = [F.when(F.getbit(value, F.lit(b)) == 1, value.bitwiseXOR(F.lit(1 << b).cast("long"))) for b in range(bits)]
    return F.array_compact(F.array(value, *cleared * (radius > 0)))


def hamming_links(prints: DataFrame, most_bits: int = 3, crowded: int = 32, block: int = 4096) -> DataFrame:
    """Links (a, b), a below b, between different fingerprints with at most ``most_bits`` (up to 3)
    differing bits; together they connect what such pairs connect.

    The 64 bits are two segments.  With up to 3 differing bits, one segment differs in at most one, so
    each fingerprint looks up the ball of radius 1 around each segment in that segment's table and the
    full distance decides.  A segment value that over ``crowded`` fingerprints share goes another way: its
    members are compared with their visitors in blocks of bounded size, and each pair of blocks returns
    only a spanning forest, so that the output stays in proportion to the rows.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("two segments of radius 1 find up to 3 differing bits")
    half, keys = BITS // 2, ["segment", "value"]
    low = F.col("fp").bitwiseAND(F.lit((1 << half) - 1).cast("long"))
    high = F.shiftrightunsigned("fp", half)
    segment = F.explode(F.array(F.struct(F.lit(0).alias("segment"), low.alias("value")),
                                F.struct(F.lit(1).alias("segment"), high.alias("value")))).alias("s")
    table = materialise(prints.select("fp", segment).select("fp", "s.segment", "s.value"))
    visits = table.select(F.col("fp").alias("visitor"), "segment",
                          F.explode(_ball(F.col("value"), half, most_bits // 2)).alias("value"))
    busy = materialise(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > crowded)
                       .select(*keys))
    # One entry stands for all members of a crowded value, so the visits are looked up in one join.
    lookup = table.join(busy, keys, "left_anti").unionByName(busy.withColumn("fp", F.lit(None).cast("long")))
    near = (F.col("fp") != F.col("visitor")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("visitor"))) <= most_bits)
    met = materialise(visits.join(lookup, keys).where(F.col("fp").isNull() | near).select(*keys, "fp", "visitor"))
    links = met.where("fp is not null").select(F.least("fp", "visitor").alias("a"), F.greatest("fp", "visitor").alias("b"))
    if busy.isEmpty():
        return links.distinct()
    members = table.join(busy, keys, "left_semi").select(*keys, "fp", F.lit(True).alias("member"))
    guests = met.where("fp is null").select(*keys, F.col("visitor").alias("fp"), F.lit(False).alias("member"))
    return links.union(_crowd_links(members.unionByName(guests), most_bits, block)).distinct()


def _crowd_links(both: DataFrame, most_bits: int, block: int) -> DataFrame:
    keys = ["segment", "value"]
    sizes = both.groupBy(*keys).agg(F.ceil(F.count(F.when(F.col("member"), 1)) / block).alias("_rows"),
                                    F.ceil(F.count(F.when(~F.col("member"), 1)) / block).alias("_columns"))
    both = both.join(sizes, keys)
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("member"), F.col("_rows")).otherwise(F.col("_columns")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("member"), F.col("_columns")).otherwise(F.col("_rows")) - 1))
    dealt = both.withColumn("_own", own).withColumn("_other", other)
    dealt = dealt.select(*keys, "fp", "member", F.when(F.col("member"), F.col("_own")).otherwise(F.col("_other")).alias("_r"),
                         F.when(F.col("member"), F.col("_other")).otherwise(F.col("_own")).alias("_c"))

    def forest(group: pa.Table) -> pa.Table:
        fps = group["fp"].to_numpy()
        member = group["member"].to_numpy(zero_copy_only=False)
        rows, columns = np.unique(fps[member]), np.unique(fps[~member])
        pairs = spanning_forest(rows, columns, most_bits)
        return pa.table({"a": pa.array(pairs.min(axis=1), pa.int64()), "b": pa.array(pairs.max(axis=1), pa.int64())})

    return dealt.groupBy(*keys, "_r", "_c").applyInArrow(forest, "a long, b long")


def spanning_forest(rows: np.ndarray, columns: np.ndarray, most_bits: int) -> np.ndarray:
    """Pairs that connect what all close pairs of the two sets connect; fewer than there are numbers."""
    nodes = np.union1d(rows, columns)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at = np.searchsorted(nodes, columns)
    found = []
    for row in rows:
        here = int(np.searchsorted(nodes, row))
        for there in at[np.bitwise_count((columns ^ row).view(np.uint64)) <= most_bits].tolist():
            x, y = find(here), find(there)
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((row, nodes[there]))
    return np.array(found, np.int64).reshape(-1, 2)


def near_duplicates(docs: DataFrame, most_bits: int = 3, width: int = 3, seed: int = 42, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (long) and ``component_id``, the least id it is linked with."""
    prints = materialise(fingerprints(docs, width, seed, key, text).drop("text_hash"))
    first = materialise(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")))
    groups = components(hamming_links(first.select("fp"), most_bits))
    least = (groups.join(first, groups["node"] == first["fp"])
             .groupBy("root").agg(F.min("first").alias("least")))
    linked = groups.join(least, "root").select(F.col("node").alias("fp"), "least")
    ids = first.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return (prints.join(ids, prints["fingerprint"] == ids["fp"])
            .select("doc_id", "fingerprint", "component_id"))


def least_rows(docs: DataFrame, most_bits: int = 3, width: int = 3, seed: int = 42, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``doc_id`` and ``text_hash`` of one row for each component: the least by id (null last), then hash of the text."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    prints = materialise(fingerprints(docs, width, seed, key, text).groupBy(F.col("fingerprint").alias("fp")).agg(F.min(order).alias("first")))
    groups = components(hamming_links(prints.select("fp"), most_bits))
    least = prints.join(groups, prints["fp"] == groups["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("least"))
    return least.select("least.doc_id", "least.text_hash")
