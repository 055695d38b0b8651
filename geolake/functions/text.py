"""Attribute parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

# Tower height in metres per voltage class.
TOWER_HEIGHT_M = {0: 25, 1: 40, 2: 55}
# Kilovolt limits of the classes.
CLASS_1_KV = 100.0
CLASS_2_KV = 300.0
FEET_PER_METRE = 3.28084


def terrarium_decode(r, g, b, nodata: str = "threshold") -> Column:
    """Height from colour channels. ``threshold`` zeroes values below -100 m,
    ``black`` zeroes pure black pixels only."""
    r, g, b = _c(r), _c(g), _c(b)
    v = r * 256.0 + g + b / 256.0 - 32768.0
    if nodata == "threshold":
        return F.when(v < -100.0, F.lit(0.0)).otherwise(v)
    return F.when((r == 0) & (g == 0) & (b == 0), F.lit(0.0)).otherwise(v)


def voltage_class(c) -> Column:
    """Highest entry of a ';' list of volts: 0, 1 or 2. Unparseable entries are
    skipped; an empty list is class 0."""
    kv = F.array_max(F.transform(F.split(_c(c), ";"), lambda s: F.trim(s).try_cast("double"))) / 1000.0
    return F.when(kv >= CLASS_2_KV, 2).when(kv >= CLASS_1_KV, 1).otherwise(0)


def parse_capacity_mw(c) -> Column:
    """Number with an explicit MW or kW unit, in MW; null otherwise."""
    pat = r"(?i)([\d.]+)\s*(MW|KW)"
    num = F.regexp_extract(_c(c), pat, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(_c(c), pat, 2))
    return F.round(F.when(unit == "MW", num).when(unit == "KW", num / 1000.0), 3)


def tower_height(vclass) -> Column:
    out = None
    for k, v in TOWER_HEIGHT_M.items():
        out = F.when(_c(vclass) == k, v) if out is None else out.when(_c(vclass) == k, v)
    return out


def strip_prefix(c, prefix: str) -> Column:
    return F.replace(_c(c), F.lit(prefix), F.lit(""))


def try_float(c) -> Column:
    """Number of a text column, null when malformed."""
    return F.trim(_c(c)).try_cast("double")


def feature_card(name, elev, lon, lat) -> list[Column]:
    """Display columns of a point: label, whole metres, feet, position."""
    metres = F.round(_c(elev)).cast("long")
    return [
        F.concat_ws(" ", _c(name), metres.cast("string")).alias("label"),
        metres.alias("elev_m"),
        F.round(_c(elev) * FEET_PER_METRE).cast("long").alias("feet"),
        F.format_string("%.4f, %.4f", _c(lat), _c(lon)).alias("grid_ref"),
    ]
