"""Column functions: pure expressions that stay inside code generation."""

from .clock import date_key, day_seconds, hms_to_sec, sec_to_hhmm, service_elapsed
from .geo import (
    haversine_km,
    haversine_m,
    in_bbox,
    lonlat_to_pixel,
    lonlat_to_tile,
    lonlat_to_tm2,
    lonlat_to_world,
    pixel_to_3857,
    pixel_to_lonlat,
    projection,
    round_coord,
    tile_center_world,
    world_to_lonlat,
    world_to_pixel,
)
from .shape import (
    clamp,
    hypsometric,
    lerp,
    linear_fade,
    log_area_ramp,
    metres_to_scaled,
    ramp_lookup,
    reservoir_level,
    ring_close,
    ring_open,
    ring_tolerance,
    slab_bounds,
    smoothstep,
)
from .text import (
    feature_card,
    parse_capacity_mw,
    strip_prefix,
    terrarium_decode,
    tower_height,
    try_float,
    voltage_class,
)

__all__ = [n for n in dir() if not n.startswith("_")]
