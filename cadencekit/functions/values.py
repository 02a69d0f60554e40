"""Column helpers for levels, codes and blended values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadencekit.functions.rates import _col

# Level floor in dB and the shown text for an unreadable code.
SILENCE_DB = -80.0
NO_CODE = "—"


def db_to_level(channels: Column | str) -> Column:
    """Loudest channel in dB as a level in [0, 1]."""
    peak = F.array_max(_col(channels))
    return F.when(peak <= SILENCE_DB, 0.0).otherwise(
        F.least(F.lit(1.0), F.pow(F.lit(10.0), peak / 20)))


def fourcc(c: Column | str) -> Column:
    """Four-character text of a packed code; a byte outside ASCII gives a dash."""
    c = _col(c).cast("long")
    parts = [F.shiftright(c, s).bitwiseAND(255) for s in (24, 16, 8, 0)]
    ascii_only = F.greatest(*parts) < 128
    return F.when(ascii_only, F.concat(*[F.chr(p) for p in parts])).otherwise(NO_CODE)


def mix(a: Column | str, b: Column | str, t: Column | str) -> Column:
    """Linear blend; ``t <= 0`` is exactly ``a`` and ``t >= 1`` exactly ``b``."""
    a, b, t = _col(a), _col(b), _col(t)
    return F.when(t <= 0, a).when(t >= 1, b).otherwise(a * (1 - t) + b * t)


def mix_arrays(a: Column | str, b: Column | str, t: Column | str) -> Column:
    """Element-wise ``mix`` of two arrays of doubles."""
    a, b, t = _col(a), _col(b), _col(t)
    blended = F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)
    return F.when(t <= 0, a).when(t >= 1, b).otherwise(blended)


def smoothstep(lo: float, hi: float, x: Column | str) -> Column:
    """Cubic ramp from 0 at ``lo`` to 1 at ``hi`` (``lo`` may be above ``hi``)."""
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_col(x) - lo) / (hi - lo)))
    return u * u * (3 - 2 * u)


def rational_ns(value: Column | str, scale: Column | str) -> Column:
    """Nanoseconds of ``value / scale`` seconds, rounded half away from zero; null if invalid.

    Whole seconds and the rest are kept apart, so nothing leaves the exact range of a long.
    """
    value, scale = _col(value).cast("long"), _col(scale).cast("long")
    rest = F.pmod(value, scale)
    whole = F.round((value - rest) / scale).cast("long")
    ns = whole * F.lit(1_000_000_000) + F.round(rest * F.lit(1e9) / scale).cast("long")
    return F.when(scale > 0, ns)
