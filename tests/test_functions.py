import math

import pytest
from pyspark.sql import functions as F

from geolake import functions as G
from geolake.functions.text import TOWER_HEIGHT_M


def one(spark, col, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("161000;69000", 1), ("345000", 2), ("69000", 0), ("", 0), ("n/a;161000", 1), (" 300000 ; x", 2)],
)
def test_voltage_class(spark, text, want):
    assert one(spark, G.voltage_class("v"), v=text) == want


def test_voltage_class_null(spark):
    assert spark.sql("select cast(null as string) as v").select(G.voltage_class("v")).first()[0] == 0


@pytest.mark.parametrize("text, want", [("2.3 MW", 2.3), ("660kW", 0.66), ("600", None), ("yes", None), ("3MW offshore", 3.0)])
def test_capacity(spark, text, want):
    assert one(spark, G.parse_capacity_mw("v"), v=text) == want


def test_slab_bounds(spark):
    df = spark.sql("select * from values (1, 100D, 500D), (2, null, 500D), (3, 100D, null), (4, 20D, 20000D), (5, 900D, 300D) as t(i, f, c)")
    got = {r.i: (r.s.lo, r.s.hi) for r in df.select("i", G.slab_bounds("f", "c").alias("s")).collect()}
    assert got == {1: (100, 500), 2: (0, 1524), 3: (0, 1524), 4: (20, 10000), 5: (900, 901)}


def test_clock(spark):
    assert one(spark, G.hms_to_sec("v"), v="23:59:30") == 86370
    assert one(spark, G.hms_to_sec("v"), v="07:05") == 25500
    assert one(spark, G.hms_to_sec("v"), v="oops") is None
    assert one(spark, G.sec_to_hhmm("v"), v=86400 + 65) == "00:01"
    # 2024-01-01 16:00 UTC is midnight of the next day in UTC+8
    assert one(spark, G.date_key("t"), t=1704124800) == "2024-01-02"
    assert one(spark, G.day_seconds("t"), t=1704124800) == 0
    assert one(spark, G.service_elapsed("t", "d"), t=100, d=86000) == 500


def test_clamp_keeps_null(spark):
    assert spark.sql("select cast(null as double) as v").select(G.clamp("v", 0.0, 1.0)).first()[0] is None


def test_projection_round_trip(spark):
    p = G.projection(23.7, 121.0, 12)
    x, z = G.lonlat_to_world(F.lit(120.5), F.lit(24.1), p)
    lon, lat = G.world_to_lonlat(x, z, p)
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert r.lon == pytest.approx(120.5, abs=1e-9) and r.lat == pytest.approx(24.1, abs=1e-9)


def test_tm2_central_meridian(spark):
    x, y = G.lonlat_to_tm2(F.lit(121.0), F.lit(24.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(250000.0, abs=1e-6)
    # meridian arc by the usual degree series, times the scale
    arc = 111132.954 * 24 - 16038.509 * math.sin(math.radians(48)) + 16.833 * math.sin(math.radians(96)) - 0.022 * math.sin(math.radians(144))
    assert r.y == pytest.approx(0.9999 * arc, abs=0.5)


def test_haversine_forms_agree(spark):
    r = spark.range(1).select(G.haversine_m(F.lit(120.0), F.lit(23.0), F.lit(121.0), F.lit(24.0)).alias("m"), G.haversine_km(F.lit(120.0), F.lit(23.0), F.lit(121.0), F.lit(24.0)).alias("k")).first()
    assert r.m / 1000 == pytest.approx(r.k, rel=1e-12)


def test_hypsometric_meets_at_sea_level(spark):
    f = lambda h: one(spark, G.hypsometric("h", 0.0, -7000.0, 3952.0, 1.0, 0.5, 0.3), h=h)
    assert f(-7000.0) == pytest.approx(0.0) and f(-1e-9) == pytest.approx(0.3, abs=1e-4)
    assert f(0.0) == pytest.approx(0.3) and f(3952.0) == pytest.approx(1.0)


def test_reservoir_level(spark):
    df = spark.sql("select * from values (100D, 80D, 50D, 0D), (100D, 80D, null, 0.5D), (100D, 99D, 10D, 1D) as t(f, l, d, r)")
    got = [r[0] for r in df.select(G.reservoir_level("f", "l", "d", "r")).collect()]
    assert got == [80.0, pytest.approx(92.5), 100.0]


def test_rounding_of_halves(spark):
    # coordinates round half up, grid nodes half to even
    assert one(spark, G.round_coord("v", 0), v=2.5) == 3.0
    assert one(spark, F.rint("v"), v=2.5) == 2.0


def test_tower_heights(spark):
    assert {k: one(spark, G.tower_height("v"), v=k) for k in TOWER_HEIGHT_M} == TOWER_HEIGHT_M


def test_smoothstep_and_ramp(spark):
    assert one(spark, G.smoothstep(0.0, 2.0, "v"), v=1.0) == pytest.approx(0.5)
    assert one(spark, G.ramp_lookup("v", [(0.0, 1.0), (10.0, 3.0)]), v=5.0) == pytest.approx(2.0)
    assert one(spark, G.log_area_ramp("v", 0.1, 45.0), v=math.sqrt(4.5)) == pytest.approx(0.5)
