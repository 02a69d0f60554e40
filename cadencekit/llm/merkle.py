"""Merkle manifest of a dataset: a tree of digests for each group, a tree over the groups' roots, proofs by pointer jumping.

A row's leaf is the SHA-256 of its chosen columns, each written as ``-`` if null, else as its UTF-8 byte count, ``:``
and its value.  The leaves of a group stand in the order of a key (null first; rows that share a key by leaf digest, so
that every run builds the same tree); every 2 neighbours become the digest of their digests, a last one without
a neighbour the digest of its own.  Groups (null first) are the leaves of one more tree, whose root stands for the table.

Null and empty texts, long texts and repeated rows are rows like any other; an empty table gives no rows.  Columns are
taken by position, so none of a table's own names clashes.  Digests are bytes inside and lowercase hex in results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadencekit.llm.common import numbered
from cadencekit.session import materialise

CHUNK_LEVELS = 10
DIGEST = 32
#: Ancestors that weigh less are sent to all tasks; their number is known from the count of leaves.
SMALL_BYTES = 8 << 20
ROW_OF_FILE = (1 << 33) - 1


def leaf(*columns: Column) -> Column:
    """The digest of a row's columns, as 32 bytes."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def placed(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (``grp``, ``order`` columns, others) with ``tree`` (place of their group), ``index`` in it and its number of
    leaves ``n``; and the groups (``grp``, ``n``, ``tree``).

    Rows are dealt out by range and numbered inside each range, so a group of any size is spread over many tasks; one
    row for each range and group gives the offsets.
    """
    # The rows are a written table by now, so the last sort column is the same on every attempt: equal rows spread too.
    rows = materialise(rows).withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col("grp").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    dealt = materialise(dealt.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(ROW_OF_FILE))))
    parts = materialise(dealt.groupBy("_range", "grp").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")))
    groups = numbered(parts.groupBy("grp").agg(F.sum("_n").alias("n")), [F.col("grp").asc_nulls_first()], "tree")
    groups = materialise(groups)
    before = Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    shifts = parts.select("_range", "grp", shift)
    whole = groups.select(F.col("grp").alias("_grp"), "n", "tree")
    shifts = shifts.join(whole, shifts["grp"].eqNullSafe(whole["_grp"])).drop("_grp").withColumnsRenamed({"grp": "_grp", "_range": "_part"})
    same = (dealt["_range"] == shifts["_part"]) & dealt["grp"].eqNullSafe(shifts["_grp"])
    out = dealt.join(shifts, same).withColumn("index", F.col("_at") + F.col("_shift"))
    return out.drop("_part", "_grp", "_range", "_at", "_shift"), groups


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def _runs(count: int, level: int) -> int:
    """Nodes of a tree of ``count`` leaves at a level."""
    return -(-count >> level)


def _climb(table: pa.Table, low: int) -> pa.Table:
    """One chunk of a tree at level ``low``: for each of its nodes and their parents, up to ``CHUNK_LEVELS`` levels, the
    sibling's digest as ``segment``; and, in ``digest``, the node in which they end."""
    table = table.sort_by("index")
    tree, count, first = table["tree"][0].as_py(), table["n"][0].as_py(), table["index"][0].as_py()
    level, now = low, table["digest"].to_pylist()
    rows: list[tuple] = []
    while level < low + CHUNK_LEVELS and _runs(count, level) > 1:
        aside = [now[i ^ 1] if i ^ 1 < len(now) else b"" for i in range(len(now))]
        payload = table["payload"].to_pylist() if level == low == 0 else [None] * len(now)
        rows += [(tree, count, level, first + i, None, aside[i], payload[i]) for i in range(len(now))]
        now = [hashlib.sha256(b"".join(d.hex().encode() for d in now[i:i + 2])).digest() for i in range(0, len(now), 2)]
        level, first = level + 1, first >> 1
    payload = table["payload"][0].as_py() if level == 0 else None
    rows.append((tree, count, level, first, now[0], None, payload))
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), table.schema.field("payload").type]
    names = ["tree", "n", "level", "index", "digest", "segment", "payload"]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _climber(low: int):
    return lambda table: _climb(table, low)


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proofs of all leaves (``tree``, ``n``, ``index``, ``digest``, ``payload``) of many trees at once: the leaves with
    ``segment``, their siblings' digests up to the root of their tree, and ``top``, that root.

    Trees are built in chunks of 1024 nodes, ten levels a round.  Then each node holds the sibling on the way to its
    parent, and self-joins double the distance: a node's segment is followed by that of the ancestor in which it ends.
    Nodes whose level is no multiple of the distance are dropped, since no leaf's pointer meets them.
    """
    schema = f"tree long, n long, level int, index long, digest binary, segment binary, payload {leaves.schema['payload'].dataType.simpleString()}"
    count, tallest = leaves.agg(F.count(F.lit(1)), F.max(height(F.col("n")))).first()
    nodes, now, tops = [], leaves, []
    for low in range(0, max(tallest or 0, 1), CHUNK_LEVELS):
        chunk = F.shiftright("index", CHUNK_LEVELS).alias("chunk")
        done = materialise(now.groupBy("tree", chunk).applyInArrow(_climber(low), schema))
        nodes.append(done.where("segment is not null").drop("digest"))
        ended = F.col("level") == height(F.col("n"))
        tops.append(done.where("digest is not null").where(ended))
        now = done.where("digest is not null").where(~ended)
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    held = nodes[0]
    for more in nodes[1:]:
        held = held.unionByName(more)
    distance = 1
    while distance < (tallest or 0):
        held = materialise(_doubled(held, distance, count))
        distance *= 2
    alone = top.where("level = 0").select("tree", "n", "index", F.lit(b"").alias("segment"), "payload")
    paths = held.where("level = 0").select("tree", "n", "index", "segment", "payload").unionByName(alone)
    return paths, top.select("tree", F.col("digest").alias("top"))


def _doubled(held: DataFrame, distance: int, count: int) -> DataFrame:
    """Segments of twice the length.  At most 2^distance nodes share an ancestor, and few ancestors are left when that
    is many: these go to all tasks."""
    kept = held.where(F.col("level") % (2 * distance) == 0)
    far = held.where(F.col("level") >= distance).select(
        F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("index").alias("_index"), F.col("segment").alias("_segment"))
    if (2 * count >> distance) * (DIGEST * distance + 64) <= SMALL_BYTES:
        far = F.broadcast(far)
    # Nodes that have reached the root meet nothing, each by a number of its own.
    above = F.when(F.col("level") + distance < height(F.col("n")), F.shiftright("index", distance)).otherwise(-1 - F.col("index"))
    met = (F.col("tree") == F.col("_tree")) & (F.col("level") + distance == F.col("_level")) & (above == F.col("_index"))
    joined = kept.join(far, met, "left").withColumn("segment", F.concat("segment", F.coalesce("_segment", F.lit(b""))))
    return joined.select(*held.columns)


def manifest(docs: DataFrame, group: Column, key: Column, digest: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``grp``, ``key``, ``leaf``, the ``extra`` columns, its place (``index`` of
    ``n`` in its group, the group's ``tree`` of ``trees``), ``subroot``, ``root`` and ``proof``: the siblings' digests
    from the leaf to the root in one string of bytes, 32 each."""
    extra = extra or {}
    rows = docs.select(group.alias("grp"), key.alias("key"), digest.alias("leaf"), *[c.alias(f"x_{name}") for name, c in extra.items()])
    rows, groups = placed(rows, ["key", "leaf"])
    carried = ["grp", "key", *[f"x_{name}" for name in extra]]
    leaves = materialise(rows.select("tree", "n", "index", F.col("leaf").alias("digest"), F.struct(*carried, "leaf").alias("payload")))
    paths, subroots = forest(leaves)
    trees = groups.count()
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("index"),
                            F.col("top").alias("digest"), F.struct(F.col("top").alias("subroot")).alias("payload"))
    above, roots = forest(materialise(upper))
    root = roots.first()  # one row of one digest
    above = above.select(F.col("index").alias("_tree"), F.col("segment").alias("_segment"), "payload.subroot",
                         F.lit(bytes(root["top"]) if root else None).cast("binary").alias("root"))
    if trees * (2 * DIGEST + DIGEST * max(trees.bit_length(), 1) + 64) <= SMALL_BYTES:
        above = F.broadcast(above)
    out = paths.join(above, F.col("tree") == F.col("_tree"))
    return out.select("payload.grp", "payload.key", "payload.leaf", *[F.col(f"payload.x_{name}").alias(name) for name in extra],
                      "index", "n", "tree", F.lit(trees).cast("long").alias("trees"), "subroot", "root",
                      F.concat("segment", "_segment").alias("proof"))


def climbed(leaf: bytes, index: int, count: int, siblings: list[bytes]) -> bytes:
    """The digest at which a leaf and the siblings on its way arrive; takes those it needs off the front of the list."""
    level = 0
    while _runs(count, level) > 1:
        at, here = index >> level, leaf.hex().encode()
        if at ^ 1 < _runs(count, level):
            aside = siblings.pop(0).hex().encode()
            here = aside + here if at & 1 else here + aside
        leaf, level = hashlib.sha256(here).digest(), level + 1
    return leaf


def folded(proofs: DataFrame, leaf: str, name: str = "folded_root") -> DataFrame:
    """Adds the root that the digest in column ``leaf`` and the row's proof give; equal to ``root`` only for the digest
    that the tree was built with.  ``proofs`` are rows of :func:`manifest`."""
    schema = proofs.withColumn(name, F.lit(None).cast("binary")).schema
    places = ("index", "n", "tree", "trees", "proof")

    def run(batches):
        for batch in batches:
            out = []
            for digest, index, count, tree, trees, proof in zip(*[batch.column(c).to_pylist() for c in (leaf, *places)], strict=True):
                siblings = [proof[i:i + DIGEST] for i in range(0, len(proof), DIGEST)]
                out.append(climbed(climbed(digest, index, count, siblings), tree, trees, siblings))
            yield batch.append_column(name, pa.array(out, pa.binary()))

    return proofs.mapInArrow(run, schema)
