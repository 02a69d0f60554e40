"""Column helpers for picture sizes, aspect and layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadencekit.functions.rates import _col, finite, finite_pos

# Long-edge cap of each mode.
MODE_CAPS = {"efficient": 1280, "balanced": 1280, "quality": 1920, "flow": 1920}
# Rungs of the working-size ladder, downward and upward.
RUNGS_DOWN = (1280, 960, 854)
RUNGS_UP = (640, 854, 960, 1280)
# Long edge of each processing target.
TARGET_EDGES = {"1080p": 1920.0, "2K": 2560.0, "4K": 3840.0}
# Pixel formats with the plane count they must have.
LAYOUTS = {"420v": 2, "420f": 2, "BGRA": 0}
FAST_CONTENT = 40.0


def _mode_cap(mode: Column) -> Column:
    cap = F.lit(None).cast("int")
    for name, edge in MODE_CAPS.items():
        cap = F.when(mode == name, edge).otherwise(cap)
    return cap


def ceiling(mode: Column | str, rate: Column | str) -> Column:
    """Long-edge ceiling of a mode; above 40 fps two modes step down."""
    mode, fast = _col(mode), F.coalesce(finite(rate) > FAST_CONTENT, F.lit(False))
    cap = _mode_cap(mode)
    return (F.when((mode == "efficient") & fast, F.least(cap, F.lit(960)))
            .when((mode == "flow") & fast, F.least(cap, F.lit(1280))).otherwise(cap))


def target_size(width: Column | str, height: Column | str, mode: Column | str,
                rate: Column | str, max_edge: Column | None = None) -> Column:
    """Working size: aspect kept, both axes floored to even, never enlarged; null if too small."""
    width, height, mode = _col(width), _col(height), _col(mode)
    long_edge = F.greatest(width, height)
    fast = F.coalesce(finite(rate) > FAST_CONTENT, F.lit(False))
    cap = _mode_cap(mode)
    cap = (F.when((mode == "efficient") & fast, F.least(cap, F.lit(960)))
           .when((mode == "flow") & fast & (long_edge > 1920), F.least(cap, F.lit(1280)))
           .otherwise(cap))
    if max_edge is not None:
        cap = F.when(max_edge.isNull(), cap).when(max_edge >= 2, F.least(cap, max_edge))
    scale = F.least(F.lit(1.0), cap.cast("double") / long_edge)
    out_w = (F.floor(width * scale / 2) * 2).cast("int")
    out_h = (F.floor(height * scale / 2) * 2).cast("int")
    ok = (width >= 2) & (height >= 2) & cap.isNotNull() & (out_w >= 2) & (out_h >= 2)
    return F.when(ok, F.struct(out_w.alias("width"), out_h.alias("height")))


def rung_down(edge: Column | str) -> Column:
    """Next smaller working size, or null at the bottom."""
    edge = _col(edge)
    return F.get(F.filter(F.array(*map(F.lit, RUNGS_DOWN)), lambda r: r < edge), F.lit(0))


def rung_up(edge: Column | str) -> Column:
    """Next larger working size, or null at the top."""
    edge = _col(edge)
    return F.get(F.filter(F.array(*map(F.lit, RUNGS_UP)), lambda r: r > edge), F.lit(0))


def pixel_size(width: Column | str, height: Column | str, scale: Column | str,
               max_w: int = 3840) -> Column:
    """Logical to pixel size: scale at least 1, width capped, both axes even and at least 2; 0 if invalid."""
    width, height = finite_pos(width), finite_pos(height)
    factor = F.greatest(F.lit(1.0), F.coalesce(finite(scale), F.lit(1.0)))
    factor = F.least(factor, F.lit(float(max_w)) / width)

    def even(c: Column) -> Column:
        size = F.greatest(F.lit(2), (F.floor(c / 2) * 2).cast("int"))
        return F.when(width.isNotNull() & height.isNotNull(), size).otherwise(F.lit(0))

    return F.struct(even(width * factor).alias("width"), even(height * factor).alias("height"))


def processing_edge(target: Column | str, screen: Column | str, source: Column | str,
                    visible: Column | str, low_latency: Column | str) -> Column:
    """Processing long edge of a target; low latency stops at the visible edge."""
    target, screen, source = _col(target), _col(screen), _col(source).cast("double")
    wanted = source
    for name, edge in TARGET_EDGES.items():
        wanted = F.when(target == name, edge).otherwise(wanted)
    wanted = F.when(target == "screen", F.coalesce(screen.cast("double"), source)).otherwise(wanted)
    wanted = F.when(_col(low_latency), F.least(wanted, _col(visible).cast("double"))).otherwise(wanted)
    return F.greatest(source, wanted)


def aspect_scale(mode: Column | str, sw: Column | str, sh: Column | str,
                 dw: Column | str, dh: Column | str) -> Column:
    """Scale on each axis: ``fit`` the smaller ratio, ``fill`` the larger, ``stretch`` each its own."""
    mode = _col(mode)
    rx = _col(dw).cast("double") / _col(sw)
    ry = _col(dh).cast("double") / _col(sh)
    one = F.when(mode == "fit", F.least(rx, ry)).when(mode == "fill", F.greatest(rx, ry))
    return F.struct(F.coalesce(one, rx).alias("x"), F.coalesce(one, ry).alias("y"))


def supported_layout(pixel_format: Column | str, planes: Column | str) -> Column:
    """True for the pixel formats, with their plane counts, that can be compared."""
    ok = F.lit(False)
    for name, count in LAYOUTS.items():
        ok = ok | ((_col(pixel_format) == name) & (_col(planes) == count))
    return F.coalesce(ok, F.lit(False))


def recordable(running: Column | str, width: Column | str, height: Column | str) -> Column:
    return F.coalesce(_col(running) & (_col(width) >= 2) & (_col(height) >= 2), F.lit(False))
