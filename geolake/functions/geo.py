"""Map projections and distances."""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE_PX = 256
EARTH_R_M = 6371000.0
# Web-mercator metres per pixel at zoom 0 and the world-unit anchor
# (56 world units across 768 pixels of zoom 12).
MPP0 = 156543.03392
ANCHOR_UNITS = 56.0
ANCHOR_PX = 768.0
ANCHOR_ZOOM = 12


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def lonlat_to_pixel(lon, lat, z: int) -> tuple[Column, Column]:
    """Fractional global pixel coordinates at zoom ``z``."""
    size = float(2**z * TILE_PX)
    r = F.radians(_c(lat))
    gx = (_c(lon) + 180.0) / 360.0 * size
    gy = (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * size
    return gx, gy


def lonlat_to_tile(lon, lat, z: int) -> Column:
    """struct(tx, ty, px, py); pixel indices never exceed 255."""
    gx, gy = lonlat_to_pixel(lon, lat, z)

    def split(g):
        t = F.floor(g / TILE_PX)
        p = F.least(F.floor(g - t * TILE_PX), F.lit(TILE_PX - 1))
        return t.cast("long"), p.cast("long")

    tx, px = split(gx)
    ty, py = split(gy)
    return F.struct(tx.alias("tx"), ty.alias("ty"), px.alias("px"), py.alias("py"))


def pixel_to_lonlat(gx, gy, z: int) -> tuple[Column, Column]:
    size = float(2**z * TILE_PX)
    lon = _c(gx) / size * 360.0 - 180.0
    lat = F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * _c(gy) / size))))
    return lon, lat


def pixel_to_3857(gx, gy, z: int) -> tuple[Column, Column]:
    mpp, half = MPP0 / 2**z, TILE_PX / 2 * MPP0
    return _c(gx) * mpp - half, half - _c(gy) * mpp


def projection(lat0: float, lon0: float, zoom: int) -> SimpleNamespace:
    """Constants of the local plane anchored at (lat0, lon0)."""
    n = 2**zoom
    r = math.radians(lat0)
    cos0 = math.cos(r)
    k = ANCHOR_UNITS / (ANCHOR_PX * (MPP0 / 2**ANCHOR_ZOOM) * cos0)
    upp = MPP0 / n * cos0 * k
    return SimpleNamespace(
        lat0=lat0,
        lon0=lon0,
        zoom=zoom,
        k=k,
        units_per_pixel=upp,
        tile_size=TILE_PX * upp,
        ox=(lon0 + 180.0) / 360.0 * n * TILE_PX,
        oy=(1.0 - math.log(math.tan(r) + 1.0 / cos0) / math.pi) / 2.0 * n * TILE_PX,
    )


def lonlat_to_world(lon, lat, proj) -> tuple[Column, Column]:
    gx, gy = lonlat_to_pixel(lon, lat, proj.zoom)
    return (gx - proj.ox) * proj.units_per_pixel, (gy - proj.oy) * proj.units_per_pixel


def world_to_pixel(x, z, proj) -> tuple[Column, Column]:
    return proj.ox + _c(x) / proj.units_per_pixel, proj.oy + _c(z) / proj.units_per_pixel


def world_to_lonlat(x, z, proj) -> tuple[Column, Column]:
    gx, gy = world_to_pixel(x, z, proj)
    return pixel_to_lonlat(gx, gy, proj.zoom)


def tile_center_world(tx, ty, proj) -> tuple[Column, Column]:
    x = ((_c(tx) + 0.5) * TILE_PX - proj.ox) * proj.units_per_pixel
    z = ((_c(ty) + 0.5) * TILE_PX - proj.oy) * proj.units_per_pixel
    return x, z


def lonlat_to_tm2(lon, lat) -> tuple[Column, Column]:
    """Transverse Mercator, central meridian 121 E, scale 0.9999 (EPSG:3826)."""
    a, b = 6378137.0, 6356752.314245  # fixed values, with the series below: major axis, and the minor axis of the WGS84 ellipsoid
    k0, false_easting, lon0 = 0.9999, 250000.0, math.radians(121.0)
    e2 = 1.0 - (b * b) / (a * a)
    ep2 = e2 / (1.0 - e2)
    n = (a - b) / (a + b)
    # meridian-arc series, third order in n
    arc = (
        a * (1 - n + 5 * n**2 / 4 * (1 - n) + 81 * n**4 / 64 * (1 - n)),
        3 * a * n / 2 * (1 - n - 7 * n**2 / 8 * (1 - n) + 55 * n**4 / 64),
        15 * a * n**2 / 16 * (1 - n + 3 * n**2 / 4 * (1 - n)),
        35 * a * n**3 / 48 * (1 - n + 11 * n**2 / 16),
        315 * a * n**4 / 51 * (1 - n),
    )
    phi = F.radians(_c(lat))
    p = F.radians(_c(lon)) - lon0
    s, c = F.sin(phi), F.cos(phi)
    to = lambda x, k: F.pow(x, F.lit(float(k)))
    t2 = to(F.tan(phi), 2)
    nu = a / F.sqrt(1.0 - e2 * to(s, 2))
    meridian = (
        arc[0] * phi
        - arc[1] * F.sin(2 * phi)
        + arc[2] * F.sin(4 * phi)
        - arc[3] * F.sin(6 * phi)
        + arc[4] * F.sin(8 * phi)
    )
    north = (
        meridian * k0
        + k0 / 2 * nu * s * c * to(p, 2)
        + k0 / 24 * nu * s * to(c, 3) * (5.0 - t2 + 9 * ep2 * to(c, 2) + 4 * ep2 * ep2 * to(c, 4)) * to(p, 4)
    )
    east = k0 * nu * c * p + k0 / 6 * nu * to(c, 3) * (1.0 - t2 + ep2 * to(c, 2)) * to(p, 3) + false_easting
    return east, north


def _hav(lon1, lat1, lon2, lat2) -> Column:
    la1, la2 = _c(lat1), _c(lat2)
    dp = F.radians(la2 - la1) / 2.0
    dl = F.radians(_c(lon2) - _c(lon1)) / 2.0
    return F.sin(dp) * F.sin(dp) + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * F.sin(dl) * F.sin(dl)


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres, arc-sine form."""
    return 2.0 * EARTH_R_M * F.asin(F.sqrt(_hav(lon1, lat1, lon2, lat2)))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle kilometres, two-argument arc-tangent form."""
    h = _hav(lon1, lat1, lon2, lat2)
    return EARTH_R_M / 1000.0 * 2.0 * F.atan2(F.sqrt(h), F.sqrt(1.0 - h))


def in_bbox(lon, lat, bbox, margin: float = 0.0) -> Column:
    """Inclusive test against (min_lon, min_lat, max_lon, max_lat)."""
    x0, y0, x1, y1 = bbox
    return _c(lon).between(x0 - margin, x1 + margin) & _c(lat).between(y0 - margin, y1 + margin)


def bbox_center(bbox) -> tuple[float, float]:
    x0, y0, x1, y1 = bbox
    return (x0 + x1) / 2.0, (y0 + y1) / 2.0


def round_coord(c, dp: int = 5) -> Column:
    return F.round(_c(c), dp)
