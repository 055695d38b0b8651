"""Clamps, ramps and ring helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c


def clamp(x, lo, hi) -> Column:
    """``x`` held inside [lo, hi]; null stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, _c(lo)), _c(hi)))


def lerp(a, b, t) -> Column:
    return _c(a) + (_c(b) - _c(a)) * _c(t)


def smoothstep(a, b, x) -> Column:
    t = clamp((_c(x) - _c(a)) / (_c(b) - _c(a)), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def linear_fade(d, near, far) -> Column:
    """1 up to ``near``, 0 from ``far`` on, linear between."""
    return 1.0 - clamp((_c(d) - _c(near)) / (_c(far) - _c(near)), 0.0, 1.0)


def slab_bounds(floor, ceil, default_floor=0.0, default_ceil=1524.0, cap=10000.0) -> Column:
    """struct(lo, hi): a missing bound replaces both by the defaults, the top is
    capped, and a slab without height gets one metre."""
    floor, ceil = _c(floor), _c(ceil)
    missing = floor.isNull() | ceil.isNull()
    lo = F.when(missing, F.lit(default_floor)).otherwise(floor)
    hi = F.least(F.when(missing, F.lit(default_ceil)).otherwise(ceil), F.lit(cap))
    return F.struct(lo.alias("lo"), F.when(hi <= lo, lo + 1.0).otherwise(hi).alias("hi"))


def log_area_ramp(area, lo: float, full: float) -> Column:
    """Smooth intensity of a contributing area on a log scale."""
    a = F.greatest(_c(area), F.lit(1e-6))
    t = (F.log10(a) - F.log10(F.lit(lo))) / (F.log10(F.lit(full)) - F.log10(F.lit(lo)))
    t = clamp(t, 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def ramp_lookup(x, stops: list[tuple[float, float]]) -> Column:
    """Piecewise-linear table lookup, clamped at both ends."""
    x = _c(x)
    out = F.when(x <= stops[0][0], F.lit(float(stops[0][1])))
    for (x0, y0), (x1, y1) in zip(stops, stops[1:]):
        out = out.when(x <= x1, y0 + (y1 - y0) * ((x - x0) / (x1 - x0)))
    return out.otherwise(F.lit(float(stops[-1][1])))


def hypsometric(h, sea: float, lo: float, hi: float, contrast: float, pivot: float, split: float) -> Column:
    """Two-stage normalisation: depths fill [0, split] with shallow water
    stretched (power 0.4), land fills [split, 1] with a linear contrast."""
    h = _c(h)
    depth = 1.0 - clamp((h - lo) / max(sea - lo, 1e-4), 0.0, 1.0)
    below = (1.0 - F.pow(depth, F.lit(0.4))) * split
    land = clamp(0.5 + (clamp((h - sea) / max(hi - sea, 1e-4), 0.0, 1.0) - pivot) * contrast, 0.0, 1.0)
    return F.when(h < sea, below).otherwise(split + land * (1.0 - split))


def reservoir_level(full, floor, dam_h, ratio) -> Column:
    """Water level for a fill ratio. The usable drop is the dam height, or 15 %
    of the full level without one; the result stays in [floor, full]."""
    full = _c(full)
    drop = F.coalesce(_c(dam_h), full * 0.15)
    return F.least(full, F.greatest(_c(floor), full - (1.0 - _c(ratio)) * drop))


def ring_tolerance(diag, fraction: float, floor: float, cap: float) -> Column:
    return clamp(_c(diag) * fraction, floor, cap)


def metres_to_scaled(h, datum, k: float, exaggeration: float) -> Column:
    return (_c(h) - _c(datum)) * (k * exaggeration)


def ring_open(pts) -> Column:
    """Drop the repeated last vertex of a closed ring array."""
    p = _c(pts)
    n = F.size(p)
    closed = (n >= 2) & (F.element_at(p, 1) == F.element_at(p, -1))
    return F.when(closed, F.slice(p, F.lit(1), n - 1)).otherwise(p)


def ring_close(pts) -> Column:
    """Append the first vertex of an open ring array."""
    o = ring_open(pts)
    return F.concat(o, F.slice(o, 1, 1))
