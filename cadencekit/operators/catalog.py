"""Choices from catalogues: formats, rates, devices, windows and displays."""

from __future__ import annotations

import math
from collections.abc import Sequence
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadencekit.functions.rates import RATE_TOLERANCE, advertised_points, finite_pos
from cadencekit.operators.asof import asof
from cadencekit.operators.folds import fold
from cadencekit.operators.ordered import join_on

# Alias pairs, where a fractional and a whole rate name one mode.
ALIASES = ((29.97, 30.0), (59.94, 60.0))
HIGH_RATE = 90.0
MAX_SHORTCUTS = 4
# Owners of windows without user content, and the smallest useful window.
SYSTEM_OWNERS = ("com.apple.WindowManager", "com.apple.dock", "com.apple.wallpaper.agent",
                 "com.apple.controlcenter", "com.apple.notificationcenterui")
MIN_WINDOW = (160, 120)
# Order in which an unavailable mode is replaced.
MODE_FALLBACK = ("flow", "balanced", "efficient", "quality")


class Sweep:
    """Walks the ends of ranges in order and holds the open ones: from each end on, the open range that is first by format and
    position, until the next end."""

    CLOSE = 1

    def __init__(self, kinds: dict[str, str], tol: float) -> None:
        self.tol = tol
        self.columns = {"_n": "bigint", "_from": "double", "_idx": kinds["format_idx"], "_lo": "double", "_hi": "double"}

    def __call__(self, pdf: pd.DataFrame, state: object) -> tuple[dict[str, list], object]:
        n, ranges = state or (0, [])
        out: dict[str, list] = {name: [] for name in self.columns}
        for at, kind, idx, pos, lo, hi in zip(*(pdf[c].tolist() for c in ("_x", "_kind", "format_idx", "_pos", "lo", "hi")), strict=True):
            if kind == self.CLOSE:
                at = math.nextafter(at, math.inf)
            else:
                heappush(ranges, [idx, pos, lo, hi])
            while ranges and ranges[0][3] + self.tol < at:
                heappop(ranges)
            n += 1
            idx, _, lo, hi = ranges[0] if ranges else (None,) * 4
            for name, value in zip(out, (n, at, idx, lo, hi), strict=True):
                out[name].append(value)
        return out, [n, ranges]


def range_pieces(formats: DataFrame, keys: Sequence[str], tol: float = RATE_TOLERANCE) -> DataFrame:
    """The ranges of each size (keys, ``width``, ``height``) cut at their ends into disjoint pieces: rows with the rate ``_from``
    which on the range of ``_idx``, ``_lo``, ``_hi`` is the first of those that hold it, in the order ``_n``; null in gaps."""
    ends = F.explode(F.array(F.struct((F.col("lo") - tol).cast("double").alias("x"), F.lit(0).alias("kind")),
                             F.struct((F.col("hi") + tol).cast("double").alias("x"), F.lit(Sweep.CLOSE).alias("kind"))))
    size = [*keys, "width", "height"]
    ranges = formats.filter((F.col("lo") - tol <= F.col("hi") + tol) & ~F.isnan("hi"))
    events = ranges.withColumn("_e", ends).select(
        *size, F.col("_e.x").alias("_x"), F.col("_e.kind").alias("_kind"), "format_idx", _position(formats).alias("_pos"),
        F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    sweep = Sweep(dict(formats.dtypes), tol)
    return fold(events, size, ["_x", "_kind", "format_idx", "_pos"], sweep, sweep.columns)


def _position(formats: DataFrame) -> Column:
    return (F.col("pos") if "pos" in formats.columns else F.lit(0)).cast("long")


def match_format(requests: DataFrame, formats: DataFrame, keys: Sequence[str] = ("device_id",),
                 tol: float = RATE_TOLERANCE) -> DataFrame:
    """Format that serves each request: the selected one, else the first of its size, else itself; with its range and rate.

    ``requests``: keys, ``rate`` (0 = the selected format's highest), ``format_idx`` (selected).  ``formats``: keys,
    ``format_idx``, ``width``, ``height``, ``lo``, ``hi`` (one row per range, in the order ``pos`` if there is such a
    column).  Adds ``chosen_idx``, ``supported``, ``chosen_lo``, ``chosen_hi`` (the chosen format's first range that holds the
    rate) and ``target_rate``: the range's end where the rate is within ``tol`` of it, else the rate.

    A format's own ranges are one record.  The ranges of a size are swept once into disjoint pieces, among which each
    distinct rate that its own format does not serve is one as-of row; requests themselves are only joined.
    """
    position = _position(formats)
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    holds = (F.col("lo") - tol <= F.col("hi") + tol) & ~F.isnan("hi")
    records = formats.groupBy(*keys, "format_idx").agg(
        F.first("width").cast("long").alias("_w"), F.first("height").cast("long").alias("_h"), F.max(F.when(holds, hi)).alias("_top"),
        F.array_sort(F.collect_list(F.when(holds, F.struct(position.alias("pos"), lo.alias("lo"), hi.alias("hi"))))).alias("_ranges"))
    rate = F.col("rate").cast("double")
    asked = join_on(requests, records, [*keys, "format_idx"])
    asked = asked.withColumn("_aim", F.when(rate == 0, F.col("_top")).otherwise(rate))
    asked = asked.withColumn("_own", F.get(F.filter("_ranges", lambda r: F.col("_aim").between(r["lo"] - tol, r["hi"] + tol)), F.lit(0)))
    open_rate = F.col("_own").isNull() & ~F.isnan("_aim") & (F.abs("_aim") < float("inf"))
    asked = asked.withColumn("_missed", F.when(open_rate, F.col("_aim"))).drop("_ranges", "_top")
    pieces = range_pieces(formats, keys, tol).select(
        *keys, F.col("width").cast("long").alias("_w"), F.col("height").cast("long").alias("_h"), "_from", "_n", "_idx", "_lo", "_hi")
    size = [*keys, "_w", "_h"]
    probes = asked.filter("_missed is not null").select(*size, "_missed").distinct()
    met = asof(probes, pieces, size, "_missed", "_from", ["_idx", "_lo", "_hi"], tie="_n", prefix="_size").drop("_sizetime")
    found = join_on(asked, met.filter("_size_idx is not null"), [*size, "_missed"])
    lo, hi, aim = F.coalesce("_own.lo", "_size_lo"), F.coalesce("_own.hi", "_size_hi"), F.col("_aim")
    target = F.when(F.abs(hi - aim) < tol, hi).when(F.abs(lo - aim) < tol, lo).when(lo.isNotNull(), aim)
    chosen = F.when(F.col("_own").isNull(), F.col("_size_idx"))
    return found.select(*requests.columns, F.coalesce(chosen, "format_idx").alias("chosen_idx"),
                        lo.isNotNull().alias("supported"), lo.alias("chosen_lo"), hi.alias("chosen_hi"), target.alias("target_rate"))


def next_rate(requests: DataFrame, rates: DataFrame, keys: Sequence[str], content: str = "content_fps",
              rate: str = "rate", tol: float = RATE_TOLERANCE) -> DataFrame:
    """Lowest supported rate not below the content rate (within ``tol``), else the highest."""
    offered = rates.withColumn("_rate", finite_pos(rate)).filter("_rate is not null")
    offered = offered.select(*keys, "_rate").distinct()
    wanted = requests.withColumn("_floor", finite_pos(content) - tol)
    out = asof(wanted, offered, keys, "_floor", "_rate", [], forward=True, prefix="_up_")
    top = offered.groupBy(*keys).agg(F.max("_rate").alias("_top"))
    out = join_on(out, top, keys)
    pick = F.when(F.col("_floor").isNotNull(), F.coalesce("_up_time", "_top"))
    return out.withColumn("target_rate", pick).drop("_floor", "_up_time", "_top")


def _level(width: Column, height: Column) -> Column:
    """The grid whose cells, ``2^level`` wide, are just as large as the rectangle: it touches two of them each way."""
    return F.ceil(F.log2(F.greatest(width, height))).cast("int")


def grid_cells(rects: DataFrame, levels: Column) -> DataFrame:
    """A row for each cell of each of the grids ``levels`` (structs with a ``level``) that a rectangle touches: ``_at``,
    ``_cx``, ``_cy``.  At the rectangle's own level and above that is at most four cells a level, whatever its size."""
    def cells(lo: str, length: str) -> Column:
        size = F.pow(F.lit(2.0), F.col("_at.level"))
        return F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(lo) + F.col(length)) / size)))

    return rects.withColumn("_at", F.explode(levels)).withColumn("_cx", cells("x", "w")).withColumn("_cy", cells("y", "h"))


def _at_levels(levels: Sequence[int], keep, tag: int) -> Column:
    """The grids among ``levels`` that ``keep`` picks, as structs for ``grid_cells``."""
    every = F.array(*map(F.lit, levels)).cast("array<int>")
    return F.transform(F.filter(every, keep), lambda x: F.struct(x.alias("level"), F.lit(tag).alias("tag")))


def largest_overlap(windows: DataFrame, displays: DataFrame, keys: Sequence[str] = (),
                    window_id: str = "window_id") -> DataFrame:
    """Display with the largest common area for each window; null without any.

    A tie goes to the display that holds the window's centre, then to the lower display id.  Sizes and places are finite.

    Rectangles of any size meet in a quadtree: each lies in at most four cells of its own level, and a pair meets in the
    larger one's cells, once.  The smaller ones are dealt to the levels that the other table has; these are
    counted first, at most one for each binary exponent.  Of equal displays only the lowest id can win, so work grows with
    the different places of displays that a window touches, not with the displays.
    """
    def shown(df: DataFrame) -> DataFrame:
        finite = F.lit(True)
        for c in ("x", "y", "w", "h"):
            finite = finite & (F.abs(F.col(c).cast("double")) < float("inf"))
        return df.filter(finite & (F.col("w") > 0) & (F.col("h") > 0)).withColumn("_own", _level(F.col("w"), F.col("h")))

    def present(df: DataFrame) -> list[int]:
        return sorted(r["_own"] for r in df.select("_own").distinct().collect())

    own = lambda tag: F.array(F.struct(F.col("_own").alias("level"), F.lit(tag).alias("tag")))
    seen = shown(windows)
    d = shown(displays).groupBy(*keys, "x", "y", "w", "h", "_own").agg(F.min("display_id").alias("display_id"))
    # Tag 0: the window is the larger one or as large; tag 1: the display is.
    seen_cells = grid_cells(seen, F.concat(own(0), _at_levels(present(d), lambda x: x > F.col("_own"), 1)))
    d = grid_cells(d, F.concat(own(1), _at_levels(present(seen), lambda x: x >= F.col("_own"), 0)))
    d = d.select(*keys, "_at", "_cx", "_cy", "display_id", *[F.col(c).alias(f"d{c}") for c in ("x", "y", "w", "h")])
    pairs = join_on(seen_cells, d, [*keys, "_at", "_cx", "_cy"], "inner")
    left, top = F.greatest("x", "dx"), F.greatest("y", "dy")
    wide = F.least(F.col("x") + F.col("w"), F.col("dx") + F.col("dw")) - left
    high = F.least(F.col("y") + F.col("h"), F.col("dy") + F.col("dh")) - top
    # A pair meets in every cell its overlap touches; keep the cell of the overlap's corner.
    size = F.pow(F.lit(2.0), F.col("_at.level"))
    home = (F.floor(left / size) == F.col("_cx")) & (F.floor(top / size) == F.col("_cy"))
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    central = ((cx >= F.col("dx")) & (cx < F.col("dx") + F.col("dw"))
               & (cy >= F.col("dy")) & (cy < F.col("dy") + F.col("dh")))
    best = (
        pairs.filter((wide > 0) & (high > 0) & home)
        .groupBy(*keys, window_id)
        .agg(F.max_by("display_id", F.struct((wide * high).alias("a"), central.alias("c"),
                                             (-F.col("display_id")).alias("i"))).alias("display_id"))
    )
    return join_on(windows, best, [*keys, window_id])


def _grams(name: Column, n: int) -> Column:
    """The distinct parts of ``n`` characters."""
    parts = F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substr(name, i, F.lit(n)))
    return F.when(F.length(name) >= n, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def names_inside(parts: DataFrame, wholes: DataFrame, keys: Sequence[str], q: int = 3) -> DataFrame:
    """Pairs (keys, ``part``, ``whole``) of different or equal names, where one contains the other; empty names have none.

    ``parts`` and ``wholes`` have keys and a ``name``.  The wholes are indexed by their grams of up to ``q`` characters,
    a number in proportion to their length.  A part looks only under its own rarest gram of ``q`` characters (all of
    it, if shorter), and what it finds there is compared in full.
    """
    index = wholes.select(*keys, F.col("name").alias("whole")).distinct()
    index = index.withColumn("_gram", F.explode(F.concat(*[_grams(F.col("whole"), n) for n in range(1, q + 1)])))
    found = index.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    asked = parts.select(*keys, F.col("name").alias("part")).distinct()
    asked = asked.withColumn("_gram", F.explode(F.when(F.length("part") >= q, _grams(F.col("part"), q)).otherwise(F.array("part"))))
    rarest = (join_on(asked.filter("part <> ''"), found, [*keys, "_gram"]).groupBy(*keys, "part")
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_least")))
    rarest = rarest.filter("_least.n > 0").select(*keys, "part", F.col("_least.gram").alias("_gram"))
    met = join_on(rarest, index, [*keys, "_gram"], "inner")
    return met.filter(F.contains("whole", "part")).select(*keys, "part", "whole")


def pair_devices(video: DataFrame, audio: DataFrame, keys: Sequence[str] = ("host_id",)) -> DataFrame:
    """Audio device for each video device: saved choice, equal name, then a name inside the other.

    ``video``: keys, ``video_id``, ``name``, ``saved`` (null, ``off`` or an audio id).  ``audio``:
    keys, ``audio_id``, ``name``, ``transport``, ``rank`` (catalogue order).  Names inside
    others are found by ``names_inside``.
    """
    lower = F.lower("name")
    first = F.min(F.struct("rank", "audio_id"))
    by_name = audio.groupBy(*keys, "name").agg(first.alias("_equal"))
    usb = audio.filter(F.col("transport") == "usb").withColumn("_low", lower)
    usb = usb.groupBy(*keys, "_low").agg(first.alias("_a"))
    names, offered = video.select(*keys, lower.alias("name")).distinct(), usb.select(*keys, F.col("_low").alias("name"))
    inside = names_inside(offered, names, keys).select(*keys, F.col("whole").alias("_own"), F.col("part").alias("_low"))
    around = names_inside(names, offered, keys).select(*keys, F.col("part").alias("_own"), F.col("whole").alias("_low"))
    near = join_on(inside.unionByName(around), usb, [*keys, "_low"], "inner").drop("_low").withColumnRenamed("_own", "_low")
    near = near.groupBy(*keys, "_low").agg(F.min("_a").alias("_near"))
    out = join_on(video.withColumn("_low", lower), by_name, [*keys, "name"])
    out = join_on(out, near, [*keys, "_low"])
    ids = audio.select(*keys, F.col("audio_id").alias("saved")).distinct().withColumn("_present", F.lit(True))
    out = join_on(out, ids, [*keys, "saved"])
    auto = F.coalesce("_equal.audio_id", "_near.audio_id")
    pick = F.when(F.col("saved").isNull(), auto).when(F.col("_present"), F.col("saved"))
    how = (F.when(F.col("saved") == "off", "off").when(F.col("saved").isNotNull(),
                                                       F.when(F.col("_present"), "saved").otherwise("saved_missing"))
           .when(F.col("_equal").isNotNull(), "equal_name")
           .when(F.col("_near").isNotNull(), "contained_name").otherwise("none"))
    return out.withColumn("paired_audio", pick).withColumn("paired_by", how).drop(
        "_low", "_equal", "_near", "_present")


def current_only(df: DataFrame, owners: DataFrame, keys: Sequence[str] = ("stream_id", "epoch")) -> DataFrame:
    """Rows that belong to their owner's current generation."""
    return join_on(df, owners.select(*keys).distinct(), keys, "left_semi")


def owned_at(df: DataFrame, validity: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Rows inside their owner's validity span ``[start, end)``; an open end is null."""
    out = asof(df, validity, keys, at, start, [end], prefix="_own_")
    inside = F.col("_own_time").isNotNull() & (
        F.col(f"_own_{end}").isNull() | (F.col(at) < F.col(f"_own_{end}")))
    return out.filter(inside).drop("_own_time", f"_own_{end}")


def available_mode(requested: Column, supported: Column) -> Column:
    """Requested mode when supported, else the first supported fallback, else ``off``."""
    fallback = F.get(F.filter(F.array(*map(F.lit, MODE_FALLBACK)),
                              lambda m: F.array_contains(supported, m)), F.lit(0))
    return F.when((requested != "off") & F.array_contains(supported, requested), requested).otherwise(
        F.coalesce(fallback, F.lit("off")))


def label_preset(settings: DataFrame, presets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Name of the preset whose columns all equal the settings, else ``custom``."""
    named = presets.groupBy(*columns).agg(F.min("preset").alias("_preset"))
    out = join_on(settings, named, columns)
    return out.withColumn("preset", F.coalesce("_preset", F.lit("custom"))).drop("_preset")


def format_catalogue(formats: DataFrame, keys: Sequence[str] = ("device_id",)) -> DataFrame:
    """One row per size: rate bounds, number of ranges, and the representative format.

    The representative has the highest rate (to 1e-5); among equals the last NV12 one, else the
    first.  ``formats`` has one row per format with ``rates`` as an array of ``lo``/``hi``.
    """
    usable = formats.filter((F.col("width") > 0) & (F.col("height") > 0) & (F.size("rates") > 0))
    top = F.array_max(F.transform("rates", lambda r: r["hi"]))
    low = F.array_min(F.transform("rates", lambda r: r["lo"]))
    native = F.col("pixel_format") == "420v"
    rank = F.struct(F.round(top * 1e5).alias("t"), native.alias("n"),
                    F.when(native, F.col("format_idx")).otherwise(-F.col("format_idx")).alias("i"))
    return usable.groupBy(*keys, "width", "height").agg(
        F.max_by("format_idx", rank).alias("format_idx"),
        F.min(F.round(low)).cast("int").alias("min_fps"), F.max(F.round(top)).cast("int").alias("max_fps"),
        F.sum(F.size("rates")).alias("n_ranges"))


def format_ranges(formats: DataFrame, keys: Sequence[str] = ("device_id",)) -> DataFrame:
    """The ranges of each catalogue size as rows, in the order ``format_idx``, ``pos``."""
    usable = formats.filter((F.col("width") > 0) & (F.col("height") > 0))
    return usable.select(*keys, "width", "height", "format_idx", F.posexplode("rates").alias("pos", "r")).select(
        *keys, "width", "height", "format_idx", "pos", "r.lo", "r.hi")


def order_by_area(df: DataFrame) -> DataFrame:
    """Catalogue order: largest picture first."""
    return df.orderBy((F.col("width").cast("long") * F.col("height")).desc(), "width", "height")


def advertised_rates(ranges: DataFrame, keys: Sequence[str] = ("device_id",)) -> DataFrame:
    """Distinct rates offered per key, from rows with ``lo`` and ``hi``; 0 stands for automatic."""
    points = ranges.select(*keys, F.explode(advertised_points("lo", "hi")).alias("rate"))
    auto = ranges.select(*keys, F.lit(0.0).alias("rate"))
    return points.unionByName(auto).distinct()


def union_rates(*frames: DataFrame, rate: str = "rate") -> DataFrame:
    """Distinct valid rates of several lists."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.filter(finite_pos(rate).isNotNull()).distinct()


def collapse_aliases(rates: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop one of each alias pair that is offered whole: the whole rate, unless it is selected.

    ``rates``: keys, ``rate`` (distinct).  ``selected``: keys, ``selected`` (one row per key).
    """
    flags = [F.max(F.col("rate") == v).alias(f"_has{i}_{j}")
             for i, pair in enumerate(ALIASES) for j, v in enumerate(pair)]
    known = join_on(rates.groupBy(*keys).agg(*flags), selected, keys)
    out = join_on(rates, known, keys)
    drop = F.lit(False)
    for i, (fraction, whole) in enumerate(ALIASES):
        both = F.col(f"_has{i}_0") & F.col(f"_has{i}_1")
        loser = F.when(F.col("selected") == whole, fraction).otherwise(whole)
        drop = drop | (both & (F.col("rate") == loser))
    return out.filter(~drop).drop(*[f"_has{i}_{j}" for i in range(len(ALIASES)) for j in (0, 1)])


def rate_shortcuts(rates: DataFrame, selected: DataFrame, keys: Sequence[str] = ("device_id",),
                   limit: int = MAX_SHORTCUTS) -> DataFrame:
    """At most four useful rates per key: selected, 30, 50, 60, the highest from 90, then upward."""
    limit = min(max(limit, 0), MAX_SHORTCUTS)
    kept = collapse_aliases(union_rates(rates.select(*keys, "rate")), selected, keys)
    tops = kept.groupBy(*keys).agg(F.max(F.when(F.col("rate") >= HIGH_RATE, F.col("rate"))).alias("_top"))
    rate = F.col("rate")
    order = (F.when(rate == F.col("selected"), 0).when(rate.isin(*ALIASES[0]), 1).when(rate == 50, 2)
             .when(rate.isin(*ALIASES[1]), 3).when(rate == F.col("_top"), 4).otherwise(5))
    ranked = join_on(kept, tops, keys).withColumn("_order", order)
    window = Window.partitionBy(*keys).orderBy("_order", "rate")
    return (ranked.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= limit)
            .select(*keys, "rate"))


def window_catalogue(windows: DataFrame, exclude: str | None = None,
                     blocked: Sequence[str] = SYSTEM_OWNERS) -> DataFrame:
    """Windows worth offering, labelled, sorted by owner and label."""
    owner_id = F.col("owner_id")
    shown = ~F.coalesce(owner_id.isin(list(blocked)), F.lit(False))
    if exclude is not None:
        shown = shown & ~owner_id.eqNullSafe(F.lit(exclude))
    big = (F.col("w") >= MIN_WINDOW[0]) & (F.col("h") >= MIN_WINDOW[1])
    named = F.coalesce(F.length("owner") > 0, F.lit(False))
    title = F.when(F.length("title") > 0, F.col("title")).otherwise(F.col("owner"))
    label = F.concat(title, F.lit(" — "), F.col("owner"))
    return (windows.filter(shown & big & named).withColumn("label", label)
            .withColumn("width", F.round("w").cast("int")).withColumn("height", F.round("h").cast("int"))
            .orderBy("owner", "label", "window_id"))


def auto_devices(devices: DataFrame, preferred: DataFrame, keys: Sequence[str] = ("host_id",)) -> DataFrame:
    """Automatic choice per host among external USB devices: the saved one, else the first by rank."""
    usable = devices.filter(F.col("external") & (F.col("transport") == "usb"))
    out = join_on(usable, preferred, keys)
    saved = F.coalesce(F.col("device_id") == F.col("preferred_id"), F.lit(False))
    return out.groupBy(*keys).agg(
        F.min_by("device_id", F.struct((~saved).alias("s"), F.col("rank"))).alias("device_id"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, with the number of older rows it replaced as ``dropped``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"),
        (F.count("*") - 1).alias("dropped")).select(*keys, "_row.*", "dropped")
