import math
import random

import pytest
from pyspark.sql import functions as F

from geolake.operators import geometry as geo


def ring(ox, oy, size, turn=1):
    pts = [(ox, oy), (ox + size, oy), (ox + size, oy + size), (ox, oy + size)]
    return pts if turn > 0 else pts[::-1]


def rings_df(spark, rings):
    rows = [(1, r, i, float(x), float(y)) for r, pts in enumerate(rings) for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "feature_id long, ring_id long, seq long, x double, y double")


EXT_A, HOLE_A, HOLE_SAME, EXT_B = ring(0, 0, 2000), ring(500, 500, 1000, -1), ring(500, 500, 1000), ring(5000, 0, 500)


@pytest.mark.parametrize(
    "rings, want, polygons",
    [
        ([EXT_A, HOLE_A], 3_000_000, 1),
        ([EXT_A[::-1], HOLE_A[::-1]], 3_000_000, 1),  # the convention is relative
        ([EXT_A, HOLE_A, EXT_B], 3_250_000, 2),
        ([EXT_A, HOLE_SAME], 5_000_000, 2),  # same turn: a second polygon, not a hole
    ],
)
def test_ring_grouping(spark, rings, want, polygons):
    r = geo.polygon_area(geo.plane_areas(rings_df(spark, rings), ["feature_id", "ring_id"])).first()
    assert r.net_area == pytest.approx(want, abs=1e-6) and r.polygons == polygons


def naive_dp(pts, tol):
    def dist(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        l2 = dx * dx + dy * dy
        t = 0.0 if l2 == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / l2))
        return math.sqrt((p[0] - (a[0] + t * dx)) ** 2 + (p[1] - (a[1] + t * dy)) ** 2)

    keep = {0, len(pts) - 1}
    todo = [(0, len(pts) - 1)]
    while todo:
        s, e = todo.pop()
        best = max(((dist(pts[i], pts[s], pts[e]), -i) for i in range(s + 1, e)), default=(0, 0))
        if best[0] > tol:
            keep.add(-best[1])
            todo += [(s, -best[1]), (-best[1], e)]
    return sorted(keep)


@pytest.mark.parametrize("long_line", [200_000, 3])
def test_simplify_both_paths(spark, long_line):
    rnd = random.Random(4)
    lines = {k: [(i + rnd.uniform(-0.2, 0.2), rnd.uniform(-1, 1)) for i in range(n)] for k, n in ((1, 2), (2, 3), (3, 60), (4, 25))}
    lines[5] = [(0.0, 0.0), (1.0, 1.0), (0.0, 2.0), (-1.0, 1.0), (0.0, 0.0)]  # closed
    df = spark.createDataFrame([(k, i, x, y) for k, p in lines.items() for i, (x, y) in enumerate(p)], "part_id long, seq long, lon double, lat double")
    for tol in (0.05, 0.6):
        got = {}
        for r in geo.simplify(df, tol, long_line=long_line).collect():
            got.setdefault(r.part_id, []).append(r.seq)
        assert {k: sorted(v) for k, v in got.items()} == {k: naive_dp(p, tol) for k, p in lines.items()}


def test_simplified_line_stays_within_tolerance(spark):
    rnd = random.Random(8)
    pts = [(i * 0.1, math.sin(i / 5) + rnd.uniform(-0.05, 0.05)) for i in range(200)]
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(pts)], "part_id long, seq long, lon double, lat double")
    kept = sorted(r.seq for r in geo.simplify(df, 0.1).collect())
    assert kept[0] == 0 and kept[-1] == 199
    for a, b in zip(kept, kept[1:]):
        for i in range(a + 1, b):
            (x0, y0), (x1, y1), (x, y) = pts[a], pts[b], pts[i]
            t = max(0, min(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2)))
            assert math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)) <= 0.1 + 1e-12


def test_tiny_rings_stay_whole(spark):
    df = spark.createDataFrame([(1, i, 121 + x * 1e-6, 23 + y * 1e-6) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 0)])], "feature_id long, seq long, lon double, lat double")
    assert geo.simplify_scaled(df, 470.0, 80.0, 0.05, "feature_id").count() == 4


def test_slices_cover_the_reach(spark):
    # 5 km x 200 m strip: six slabs whose areas add up to the whole
    lon = 121.0
    dlon = 5000 / (math.radians(1) * 6371000 * math.cos(math.radians(23)))
    dlat = 200 / (math.radians(1) * 6371000)
    pts = [(lon, 23.0), (lon + dlon / 2, 23.0), (lon + dlon, 23.0), (lon + dlon, 23 + dlat), (lon + dlon / 2, 23 + dlat), (lon, 23 + dlat)]
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(pts)], "feature_id long, seq long, lon double, lat double")
    s = geo.slice_reaches(df, "feature_id").groupBy("slice_id").agg(F.first("area_m2").alias("a")).collect()
    assert len(s) == 6
    assert sum(r.a for r in s) == pytest.approx(1_000_000, rel=1e-3)


def test_point_at_ends(spark):
    v = spark.createDataFrame([(1, 0, 121.0, 23.0, 0.0), (1, 1, 121.01, 23.0, 10.0), (1, 2, 121.03, 23.0, 40.0)], "part_id long, seq long, lon double, lat double, elev double")
    q = spark.createDataFrame([(1, -0.5), (1, 0.0), (1, 0.5), (1, 1.0), (1, 7.0)], "part_id long, ratio double")
    got = {r.ratio: r for r in geo.point_at(q, v).collect()}
    assert got[-0.5].lon == got[0.0].lon == 121.0
    assert got[1.0].lon == got[7.0].lon == pytest.approx(121.03)
    assert got[0.5].lon == pytest.approx(121.015, abs=1e-5) and got[0.5].elev == pytest.approx(17.5, abs=0.02)


def test_point_at_keeps_lines_off_the_driver(spark):
    """Lines that look small beside many ratios but make many segments: the job must not
    need a copy of them all in one place."""
    v = spark.range(1000).selectExpr("id as part_id", "explode(sequence(0L, 19L)) as seq").selectExpr(
        "part_id", "seq", "121 + part_id * 1e-3 as lon", "23 + seq * 1e-3 as lat", "cast(seq as double) as elev")
    q = spark.range(100_000).selectExpr("id", "id % 1000 as part_id", "cast(floor(id / 1000) as bigint) / 99e0 as ratio")
    name = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(name)
    spark.conf.set(name, "1m")
    try:
        p = geo.point_at(q, v)
        off = F.greatest(F.abs(p.lon - 121 - p.part_id * 1e-3), F.abs(p.lat - 23 - p.ratio * 19e-3), F.abs(p.elev - p.ratio * 19))
        got = p.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max(off).alias("off")).first()
    finally:
        spark.conf.set(name, before)
    assert got.n == got.ids == 100_000 and got.off < 0.01


def test_short_lines_share_their_steps(monkeypatch):
    """Many short lines of one batch are one step, and every one gets its own values."""
    import numpy as np
    import pandas as pd

    rng = random.Random(5)
    lines = [[(round(rng.random(), 2), round(rng.random(), 2)) for _ in range(rng.randint(1, 12))] for _ in range(400)]
    rows = pd.DataFrame([(k, x, y, 0.05) for k, pts in enumerate(lines) for x, y in pts], columns=["k", "_x", "_y", "_tol"])
    calls, real = [], geo._importance_np
    monkeypatch.setattr(geo, "_importance_np", lambda *a: calls.append(1) or real(*a))
    half = len(rows) // 2
    got = pd.concat(geo._lines_np(["k"])(iter([rows[:half], rows[half:]])))
    assert len(calls) <= 3 and len(got) == len(rows)
    for k, pts in enumerate(lines):
        imp = got[got["k"] == k]["importance"].to_numpy()
        for tol in (0.05, 0.2):
            assert [i for i, v in enumerate(imp > tol) if v] == naive_dp(pts, tol), (k, tol)
        assert np.isinf(imp[0]) and np.isinf(imp[-1])
