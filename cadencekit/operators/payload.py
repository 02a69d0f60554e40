"""Payload comparison and motion features of neighbouring samples.

Windows carry only keys, sizes and digests; payload bytes are fetched by key for the few pairs that
really need a byte comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencekit.operators.ordered import join_on, ordered

# Tolerance, luma weights, block size, search radii and confidence ramps.
BYTE_TOLERANCE = 0.002
COMPARED_BYTES = 4096
LUMA = (0.2126, 0.7152, 0.0722)
BLOCK = 4
RADII = (4, 2, 2)
TEXTURE_RAMP, UNIQUE_RAMP, RESIDUAL_RAMP = (0.00005, 0.008), (0.0002, 0.012), (0.04, 0.16)
# Interpretation attributes that must agree for two pictures to be the same.
COMPARED_ATTRS = (
    "matrix", "primaries", "transfer", "gamma", "color_space", "chroma_top", "chroma_bottom",
    "clean_aperture", "pixel_aspect", "field_count", "field_detail", "orientation")


def compared_attrs(attrs: Column) -> Column:
    """The attributes that matter, as a comparable array; others are ignored."""
    return F.array(*[F.element_at(attrs, name) for name in COMPARED_ATTRS])


def _signature(df: DataFrame, payload: str, same: Sequence[str]) -> Column:
    return F.struct(F.octet_length(payload).alias("size"), *[F.col(c).alias(f"a_{c}") for c in same])


def identical(df: DataFrame, keys: Sequence[str], by: Sequence[str], payload: str,
              same: Sequence[str] = ()) -> DataFrame:
    """``identical`` to the previous row: same size, same ``same`` columns, same bytes.

    Null on the first row.  Bytes are compared through their SHA-256 digest.  The payload column is
    left out of the result, and of every shuffle.
    """
    slim = df.withColumn("_sig", _signature(df, payload, same)).withColumn(
        "_digest", F.sha2(F.col(payload).cast("binary"), 256)).drop(payload)
    s = ordered(slim, keys, by).previous(_row=F.lit(True), _psig=F.col("_sig"), _pdig=F.col("_digest"))
    equal = F.col("_sig").eqNullSafe(F.col("_psig")) & F.col("_digest").eqNullSafe(F.col("_pdig"))
    return (s.withColumn("identical", F.when(F.col("_row"), equal))
            .drop("_row", "_sig", "_psig", "_digest", "_pdig").done())


@F.pandas_udf(T.LongType())
def differing_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of positions at which two equally long byte strings differ."""
    counts = [int(np.count_nonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)))
              for x, y in zip(a, b, strict=True)]
    return pd.Series(counts, dtype="int64")


def block_digests(payload: Column, size: int = COMPARED_BYTES) -> Column:
    """A digest of 16 bytes for each block of ``size`` bytes."""
    count = F.ceil(F.octet_length(payload) / size).cast("int")
    digests = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.unhex(F.md5(F.substring(payload, i * size + 1, F.lit(size)))))
    return F.when(count > 0, digests).when(count == 0, F.array().cast("array<binary>"))


def equivalent(df: DataFrame, keys: Sequence[str], by: Sequence[str], row_id: str, payload: str,
               same: Sequence[str] = (), tol: float = BYTE_TOLERANCE, stride: str | None = None) -> DataFrame:
    """``equivalent`` to the previous row: at most ``tol`` of the bytes differ.

    ``stride`` names a column with the padded byte count to use as the denominator.  ``row_id`` is
    unique.  Digests of blocks travel through the window; of pairs of equal size and attributes only the blocks
    that differ are read again, both sides in one join, and nothing but these blocks is shuffled to be compared.
    """
    flat = _signature(df, payload, same)
    content = F.col(payload).cast("binary")
    slim = df.select(*keys, *[c for c in by if c != row_id], row_id, flat.alias("_sig"), block_digests(content).alias("_digests"),
                     F.col(stride).cast("double").alias("_total") if stride
                     else F.octet_length(payload).cast("double").alias("_total"))
    s = ordered(slim, keys, by).previous(_pid=F.col(row_id), _psig=F.col("_sig"), _pdigests=F.col("_digests"))
    comparable = F.col("_sig").eqNullSafe(F.col("_psig"))
    other = F.filter(F.sequence(F.lit(0), F.size("_digests") - 1), lambda i: F.get("_digests", i) != F.get("_pdigests", i))
    blocks = F.when(comparable & (F.size("_digests") > 0), other).when(comparable, F.array().cast("array<int>"))
    pairs = s.done().withColumn("_blocks", blocks).drop("_sig", "_psig", "_digests", "_pdigests")
    exact = F.size("_blocks") == 0
    asked = pairs.filter(F.col("_pid").isNotNull() & (F.size("_blocks") > 0)).select(
        F.col(row_id).alias("_pair"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(row_id).alias("id")),
                                                        F.struct(F.lit(1).alias("side"), F.col("_pid").alias("id")))).alias("_of"), "_blocks")
    asked = asked.groupBy(F.col("_of.id").alias("_id")).agg(F.collect_list(F.struct("_pair", "_of.side", "_blocks")).alias("_asked"))
    sent = (df.select(F.col(row_id).alias("_id"), content.alias("_bytes")).join(asked, "_id")
            .select("_bytes", F.explode("_asked").alias("_a")).select("_bytes", "_a._pair", "_a.side", F.explode("_a._blocks").alias("_block"))
            .select("_pair", "_block", "side", F.substring("_bytes", F.col("_block") * COMPARED_BYTES + 1, F.lit(COMPARED_BYTES)).alias("_part")))
    met = sent.groupBy("_pair", "_block").agg(*[F.max(F.when(F.col("side") == i, F.col("_part"))).alias(n) for i, n in enumerate("ab")])
    read = met.select(F.col("_pair").alias(row_id), differing_bytes("a", "b").alias("_d")).groupBy(row_id).agg(F.sum("_d").alias("_diff"))
    out = join_on(pairs, read, [row_id])
    verdict = exact | (F.col("_diff") <= F.col("_total") * tol)
    return (out.withColumn("equivalent", F.when(F.col("_pid").isNotNull(), F.coalesce(verdict, F.lit(False))))
            .withColumn("differing", F.when(exact & F.col("_pid").isNotNull(), F.lit(0)).otherwise(F.col("_diff")))
            .drop("_pid", "_blocks", "_total", "_diff"))


def block_mean(df: DataFrame, frame: Sequence[str], size: int, width: Column, height: Column,
               value: str = "luma", x: str = "x", y: str = "y") -> DataFrame:
    """Mean of ``size`` x ``size`` blocks; a block over the edge repeats the edge pixels."""
    def copies(position: Column, length: Column) -> Column:
        padded = F.ceil(length / size) * size
        return F.when(position == length - 1, padded - length + 1).otherwise(1)

    weight = copies(F.col(x), width) * copies(F.col(y), height)
    return df.groupBy(*frame, F.floor(F.col(x) / size).cast("int").alias("bx"),
                      F.floor(F.col(y) / size).cast("int").alias("by")).agg(
        (F.sum(F.col(value) * weight) / (size * size)).alias("luma"))


def block_luma(pixels: DataFrame, frame: Sequence[str], width: Column, height: Column,
               size: int = BLOCK) -> DataFrame:
    """Block brightness from ``r``, ``g``, ``b`` pixels with ``x`` and ``y``."""
    luma = sum((F.col(c) * w for c, w in zip("rgb", LUMA, strict=True)), F.lit(0.0))
    return block_mean(pixels.withColumn("luma", luma), frame, size, width, height)


def pyramid(tiles: DataFrame, frame: Sequence[str], width: Column, height: Column) -> DataFrame:
    """Next coarser level of a tile table: 2 x 2 means."""
    return block_mean(tiles, frame, 2, width, height, x="bx", y="by")


def frame_pairs(frames: DataFrame, keys: Sequence[str], seq: str, luma: str) -> DataFrame:
    """Each frame with the luma of the frame before it, fetched by key."""
    s = ordered(frames.select(*keys, seq), keys, [seq]).previous(_before=F.col(seq))
    links = s.done().filter(F.col("_before").isNotNull())
    old = frames.select(*keys, F.col(seq).alias("_before"), F.col(luma).alias("prev_luma"))
    return join_on(join_on(frames, links, [*keys, seq], "inner"), old, [*keys, "_before"], "inner").drop("_before")


def _coarser(levels: np.ndarray) -> np.ndarray:
    """2 x 2 means of a stack of pictures (n, height, width), edges repeated."""
    padded = np.pad(levels, [(0, 0), *[(0, n % 2) for n in levels.shape[1:]]], mode="edge")
    return (padded[:, ::2, ::2] + padded[:, 1::2, ::2] + padded[:, ::2, 1::2] + padded[:, 1::2, 1::2]) / 4


# The 3 x 3 stride-2 patch around a position.
PATCH_Y, PATCH_X = (g.ravel() for g in np.mgrid[-2:3:2, -2:3:2])


def _patches(levels: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Patches at positions of shape (n, ...), clamped to the picture: (n, ..., 9)."""
    frame = np.arange(len(levels)).reshape(-1, *[1] * ys.ndim)
    rows = np.clip(ys[..., None] + PATCH_Y, 0, levels.shape[1] - 1)
    cols = np.clip(xs[..., None] + PATCH_X, 0, levels.shape[2] - 1)
    return levels[frame, rows, cols]


def _search(a: np.ndarray, b: np.ndarray, ys, xs, seed_y, seed_x, radius: int):
    """Best displacement around a seed (n, cells): lowest cost, then shortest, then first in scan order."""
    step_y, step_x = (g.ravel() for g in np.mgrid[-radius:radius + 1, -radius:radius + 1])
    dy, dx = seed_y[..., None] + step_y, seed_x[..., None] + step_x
    here = _patches(a, ys, xs)[:, :, None, :]
    costs = np.abs(here - _patches(b, ys[..., None] + dy, xs[..., None] + dx)).mean(axis=-1)
    best = np.lexsort((dy * dy + dx * dx, costs), axis=-1)[..., :1]
    second = np.partition(costs, 1, axis=-1)[..., 1]
    return (*(np.take_along_axis(v, best, -1)[..., 0] for v in (dy, dx, costs)), second)


def _ramp(lo: float, hi: float, x: np.ndarray) -> np.ndarray:
    u = np.clip((x - lo) / (hi - lo), 0, 1)
    return u * u * (3 - 2 * u)


def _motion(prev: np.ndarray, cur: np.ndarray) -> list[list[dict]]:
    """Displacement and confidence of each 4 x 4 cell of every frame pair, coarse to fine."""
    levels = [(prev, cur)]
    for _ in range(2):
        levels.append(tuple(_coarser(x) for x in levels[-1]))
    n, height, width = levels[2][0].shape
    cy, cx = (np.broadcast_to(g.ravel(), (n, height * width)) for g in np.mgrid[0:height, 0:width])
    zero = np.zeros(cy.shape, dtype=int)
    dy2, dx2, _, _ = _search(*levels[2], cy, cx, zero, zero, RADII[0])
    dy1, dx1, _, _ = _search(*levels[1], cy * 2 + 1, cx * 2 + 1, dy2 * 2, dx2 * 2, RADII[1])
    ys, xs = cy * 4 + 2, cx * 4 + 2
    dy, dx, best, second = _search(prev, cur, ys, xs, dy1 * 2, dx1 * 2, RADII[2])
    patch = _patches(prev, ys, xs)

    def cost(step_y: int, step_x: int) -> np.ndarray:
        return np.abs(patch - _patches(cur, ys + dy + step_y, xs + dx + step_x)).mean(axis=-1)

    def shift(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        bend = low - 2 * best + high
        ok = (best > 1e-6) & (np.abs(bend) > 1e-5)
        return np.where(ok, np.clip(0.5 * (low - high) / np.where(ok, bend, 1), -0.5, 0.5), 0.0)

    texture = _ramp(*TEXTURE_RAMP, np.maximum(0, (patch**2).mean(axis=-1) - patch.mean(axis=-1) ** 2))
    unique = _ramp(*UNIQUE_RAMP, np.maximum(0, second - best))
    inside = (np.abs(dx2) < RADII[0]) & (np.abs(dy2) < RADII[0])
    trust = (1 - _ramp(*RESIDUAL_RAMP, best)) * np.maximum(texture, unique) * inside
    flow_x = (dx + shift(cost(0, -1), cost(0, 1))) * BLOCK
    flow_y = (dy + shift(cost(-1, 0), cost(1, 0))) * BLOCK
    names = ("bx", "by", "dx", "dy", "cost", "second", "flow_x", "flow_y", "confidence")
    columns = (cx, cy, dx, dy, best, second, flow_x, flow_y, trust)
    return [[dict(zip(names, cell, strict=True)) for cell in zip(*(c[i].tolist() for c in columns), strict=True)]
            for i in range(n)]


MOTION_TYPE = T.ArrayType(T.StructType([
    *[T.StructField(n, T.IntegerType()) for n in ("bx", "by", "dx", "dy")],
    *[T.StructField(n, T.DoubleType()) for n in ("cost", "second", "flow_x", "flow_y", "confidence")]]))


# Most candidate values held at once while searching: 4 MB, of which numpy holds about ten copies.
SEARCH_VALUES = 500_000


@F.pandas_udf(MOTION_TYPE)
def _motion_cells(prev: pd.Series, cur: pd.Series, width: pd.Series) -> pd.Series:
    out: list = [None] * len(prev)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (values, w) in enumerate(zip(prev, width, strict=True)):
        shapes.setdefault((len(values) // int(w), int(w)), []).append(i)
    for (h, w), rows in shapes.items():
        cells = max(1, -(-h // 4) * -(-w // 4))
        size = max(1, SEARCH_VALUES // (cells * 81 * 9))
        for start in range(0, len(rows), size):
            part = rows[start:start + size]
            old, new = (np.array([s.iloc[i] for i in part], dtype=float).reshape(-1, h, w) for s in (prev, cur))
            for i, found in zip(part, _motion(old, new), strict=True):
                out[i] = found
    return pd.Series(out)


def motion(pairs: DataFrame, frame: Sequence[str], luma: str, width: Column) -> DataFrame:
    """One row per 4 x 4 cell of each frame pair, from row-major luma arrays of both frames."""
    cells = pairs.select(*frame, F.explode(_motion_cells(F.col("prev_luma"), F.col(luma), width)).alias("m"))
    return cells.select(*frame, "m.*")


def motion_summary(cells: DataFrame, frame: Sequence[str], trusted: float = 0.5) -> DataFrame:
    """Share of trusted cells and their mean displacement per frame."""
    sure = F.col("confidence") >= trusted
    length = F.sqrt(F.col("flow_x") ** 2 + F.col("flow_y") ** 2)
    return cells.groupBy(*frame).agg(
        F.count("*").alias("n_cells"), F.avg(sure.cast("double")).alias("trusted_share"),
        F.avg(F.when(sure, length)).alias("mean_move"))
