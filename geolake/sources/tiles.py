"""Tile index arithmetic on plain numbers (query parameters)."""

from __future__ import annotations

import math


def tile_x(lon: float, z: int) -> int:
    return math.floor((lon + 180.0) / 360.0 * 2**z)


def tile_y(lat: float, z: int) -> int:
    r = math.radians(lat)
    return math.floor((1.0 - math.log(math.tan(r) + 1.0 / math.cos(r)) / math.pi) / 2.0 * 2**z)


def tile_range(z: int, bbox: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """(tx0, tx1, ty0, ty1) of (min_lon, min_lat, max_lon, max_lat)."""
    x0, y0, x1, y1 = bbox
    return tile_x(x0, z), tile_x(x1, z), tile_y(y1, z), tile_y(y0, z)
