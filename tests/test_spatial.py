import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolake.operators import spatial


def cloud(n, seed, dup=0):
    rnd = random.Random(seed)
    pts = [(i, rnd.uniform(0, 4), rnd.uniform(0, 4)) for i in range(n)]
    return pts + [(n + i, 1.0, 1.0) for i in range(dup)]


@pytest.mark.parametrize("leaf", [20_000, 6])
def test_gather_near_with_crowds_and_copies(spark, leaf):
    pts, cap, r = cloud(250, 2, dup=120), 5, 1.3
    cs = [(0, 1.0, 1.0), (1, 2.2, 2.9), (2, 3.9, 0.1), (3, 9.0, 9.0)]
    got = {}
    out = spatial.gather_near(spark.createDataFrame(cs, "center_id long, x double, y double"), spark.createDataFrame(pts, "point_id long, x double, y double"), r, cap, leaf_rows=leaf)
    for row in out.collect():
        got.setdefault(row.center_id, []).append((row["rank"], row.point_id))
    for c, x, y in cs:
        d = sorted(((px - x) * (px - x) + (py - y) * (py - y), i) for i, px, py in pts)
        want = [i for dd, i in d if dd <= r * r][:cap]
        assert [i for _, i in sorted(got.get(c, []))] == want


@pytest.mark.parametrize("limit", [None, 4])
def test_spread_pick_is_the_greedy(spark, limit):
    rnd = random.Random(6)
    rows = [(g, i, rnd.uniform(0, 5), rnd.uniform(0, 5), float(rnd.randrange(40))) for g in (1, 2) for i in range(120)]
    rows += [(1, 1000 + i, 2.0, 2.0, 50.0) for i in range(50)]
    df = spark.createDataFrame(rows, "g long, id long, x double, y double, h double")
    got = {(r.g, r.id) for r in spatial.spread_pick(df, "g", "id", F.col("h"), 1.0, limit).collect()}
    want = set()
    for g in (1, 2):
        kept = []
        for _, i, x, y, h in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[4], r[1])):
            if all((x - a) ** 2 + (y - b) ** 2 >= 1.0 for _, a, b in kept):
                kept.append((i, x, y))
        want |= {(g, k[0]) for k in kept[:limit]}
    assert got == want


def test_nearest_of_another_chain_among_copies(spark):
    rows = [(1, i, 120.0, 23.0) for i in range(30)] + [(7, 0, 120.0, 23.0), (9, 0, 120.0, 23.0), (5, 0, 120.0001, 23.0)]
    v = spark.createDataFrame(rows, "chain long, seq long, lon double, lat double")
    left = spark.createDataFrame([(100, 1, 120.0, 23.0), (200, 7, 120.0, 23.0)], "end_id long, chain long, lon double, lat double")
    got = {r.end_id: r.near_chain for r in spatial.nearest_within(left, v, 20.0).collect()}
    assert got == {100: 7, 200: 1}


def test_point_in_concave_ring(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]
    rings = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(ring)], "ring long, seq long, lon double, lat double")
    pts = [(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 0.2, 3.0), (4, 5.0, 1.0), (5, 3.8, 3.0)]
    df = spark.createDataFrame(pts, "p long, lon double, lat double")
    got = sorted(r.p for r in spatial.points_in_polygons(df, rings, "p", "ring", 0.7).collect())
    assert got == [1, 3, 5]


def test_vote_falls_back_only_for_orphans(spark):
    zone = lambda z, x: [(z, i, x + dx, dy) for i, (dx, dy) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)])]
    polys = spark.createDataFrame(zone(1, 0.0) + zone(2, 3.0), "zone_id long, seq long, lon double, lat double")
    attrs = spark.createDataFrame([(1, "one", 2), (2, "two", 3)], "zone_id long, name string, kind int")
    s = spark.createDataFrame([(1, 10, 0.5, 0.5), (2, 10, 4.2, 0.5), (3, 20, 4.2, 0.5), (4, 30, 9.0, 9.0)], "sample_id long, chain long, lon double, lat double")
    got = {r.chain: (r.name, r.kind, r.pass_no) for r in spatial.tag_by_vote(s, polys, attrs, "chain", 0.01, 0.3, 0.5).collect()}
    assert got == {10: ("one", 2, 1), 20: ("two", 3, 2), 30: (None, 6, 0)}


@pytest.mark.parametrize("cell", [0.1, 0.7, 3.0, 50.0])
def test_polygon_index_is_the_even_odd_rule(spark, cell):
    """Wild rings, wide ones, vertices and points on cell borders."""
    rnd = random.Random(int(cell * 10))
    rings, ends = [], {}
    for r in range(8):
        n = rnd.choice([3, 4, 9, 40])
        wide = rnd.choice([1.0, 6.0, 12.0])
        pick = (lambda: rnd.randrange(-10, 11) * cell * wide / 12) if r % 2 else (lambda: rnd.uniform(-wide, wide))
        ends[r] = [(pick(), pick()) for _ in range(n)]
        rings += [(r, k, x, y) for k, (x, y) in enumerate(ends[r])]
    pts = [(rnd.uniform(-13, 13), rnd.uniform(-13, 13)) for _ in range(300)] + [(rnd.randrange(-10, 11) * cell, rnd.randrange(-10, 11) * cell) for _ in range(150)]
    pts += [v for vs in ends.values() for v in vs]

    def inside(p, vs):
        n = 0
        for (x0, y0), (x1, y1) in zip(vs, vs[1:] + vs[:1], strict=True):
            if (y0 > p[1]) != (y1 > p[1]) and p[0] < (x1 - x0) * (p[1] - y0) / (y1 - y0) + x0:
                n += 1
        return n % 2 == 1

    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "p long, lon double, lat double")
    rs = spark.createDataFrame(rings, "ring long, seq long, lon double, lat double")
    got = sorted((r.p, r.ring) for r in spatial.points_in_polygons(df, rs, "p", "ring", cell).collect())
    assert got == sorted((i, r) for i, p in enumerate(pts) for r, vs in ends.items() if inside(p, vs))


@pytest.mark.parametrize("held", [1, 8])
def test_peaks_without_meeting_all_points(spark, monkeypatch, held):
    """One by one from the highest down, though heights crowd together and tie; no table
    of all points around every centre is made."""

    def whole(*a, **k):
        raise AssertionError("all points around a centre are compared")

    monkeypatch.setattr(spatial, "spread_pick", whole)
    monkeypatch.setattr(spatial, "PEAKS_HELD", held, raising=False)
    rng = np.random.default_rng(held)
    x, y = rng.uniform(0, 2, 900).round(2), rng.uniform(0, 2, 900).round(2)
    elev = (100 - 20 * np.hypot(x - 1, y - 1)).round(0)
    pts = [(i, float(x[i]), float(y[i]), float(elev[i])) for i in range(900)]
    centers = [(0, 1.0, 1.0), (1, 0.2, 0.3), (2, 1.9, 1.1), (3, 9.0, 9.0)]
    want = set()
    for c, cx, cy in centers:
        got = []
        for i, px, py, e in sorted(pts, key=lambda p: (-p[3], p[0])):
            if e >= 75 and (px - cx) * (px - cx) + (py - cy) * (py - cy) <= 0.25 and len(got) < 6:
                if all((px - a) * (px - a) + (py - b) * (py - b) >= 0.04 for _, a, b in got):
                    got.append((i, px, py))
        want |= {(c, g[0]) for g in got}
    found = spatial.select_peaks(
        spark.createDataFrame(pts, "point_id long, x double, y double, elev double"), spark.createDataFrame(centers, "center_id long, x double, y double"), 0.5, 0.2, 6, 75.0
    )
    assert {(r.center_id, r.point_id) for r in found.collect()} == want


def brute_lines(points, lines, max_m):
    """All segments, one by one, in projected metres."""
    best = {}
    for st, px, py in points:
        for line, vs in lines.items():
            total = sum(float(np.hypot(b[0] - a[0], b[1] - a[1])) for a, b in zip(vs, vs[1:]))
            cum = 0.0
            for k, ((ax, ay), (bx, by)) in enumerate(zip(vs, vs[1:])):
                n = (bx - ax) ** 2 + (by - ay) ** 2
                t = 0.0 if n == 0 else min(max(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n, 0.0), 1.0)
                d = float(np.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))))
                if d < max_m and (st, line) not in best or d < best.get((st, line), (max_m,))[0] - 1e-9:
                    best[st, line] = (d, (cum + t * n**0.5) / total if total else 0.0)
                cum += n**0.5
    return best


@pytest.mark.parametrize("crowd", [50_000, 4])
def test_locate_on_lines_without_pairs_of_segments(spark, monkeypatch, crowd):
    from geolake.functions.geo import lonlat_to_tm2

    monkeypatch.setattr(spatial, "CROWD", crowd)
    rnd = random.Random(5)
    spots = [(f"s{i % 50}", 121 + rnd.uniform(0, 0.04), 23 + rnd.uniform(0, 0.04)) for i in range(60)]  # ten stations stand twice
    lines = [(p, k, 121 + p * 0.004 + k * 0.001 * (p % 3), 23 + rnd.uniform(0, 0.04)) for p in range(8) for k in range(9)]
    st = spark.createDataFrame(spots, "station string, lon double, lat double")
    vs = spark.createDataFrame(lines, "part_id long, seq long, lon double, lat double")
    x, y = lonlat_to_tm2("lon", "lat")
    plain = {}
    for r in vs.select("part_id", x.alias("x"), y.alias("y")).orderBy("part_id", "seq").collect():
        plain.setdefault(r.part_id, []).append((r.x, r.y))
    want = brute_lines([tuple(r) for r in st.select("station", x, y).collect()], plain, 800.0)
    out = spatial.locate_on_lines(st, vs, 800.0)
    got = {(r.station, r.part_id): (r.dist_m, r.ratio) for r in out.collect()}
    assert got.keys() == want.keys() and len(got) == out.count()
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    # of stations that stand once nothing is shuffled behind the cells
    once = spatial.locate_on_lines(st.dropDuplicates(["station"]), vs, 800.0)
    plan = once._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan.split("FlatMapCoGroups")[0]


def test_gather_splits_crowds_by_default(spark):
    import inspect

    pts, cap, r = cloud(900, 4), 3, 1.5
    cs = [(i, 0.4 * i, 4 - 0.4 * i) for i in range(11)]
    leaf = inspect.signature(spatial.gather_near).parameters["leaf_rows"].default
    assert leaf <= 100  # 900 points in nine cells are split
    out = spatial.gather_near(spark.createDataFrame(cs, "center_id long, x double, y double"), spark.createDataFrame(pts, "point_id long, x double, y double"), r, cap)
    got = {(o.center_id, o["rank"]): o.point_id for o in out.collect()}
    for c, x, y in cs:
        d = sorted(((px - x) * (px - x) + (py - y) * (py - y), i) for i, px, py in pts)
        assert [got.get((c, k + 1)) for k in range(cap)] == [i for dd, i in d if dd <= r * r][:cap]


@pytest.mark.parametrize("full,crowd", [(1_000, 50_000), (2, 5)])
def test_pick_in_widening_cells(spark, monkeypatch, full, crowd):
    monkeypatch.setattr(spatial, "FULL", full)
    monkeypatch.setattr(spatial, "CROWD", crowd)
    rnd = random.Random(9)
    pts = [("sites", 1, i, rnd.uniform(0, 3), rnd.uniform(0, 3)) for i in range(60)] + [("sites", 1, 100 + i, 1.0, 1.0) for i in range(20)]
    segs = [("lines", 2, i % 30, x, y, x + rnd.uniform(-0.1, 0.1), y + rnd.uniform(-0.1, 0.1)) for i in range(60) for x, y in [(rnd.uniform(0, 1.5), rnd.uniform(0, 3))]]
    segs += [("lines", 2, 50, 0.5, 0.5, 0.5, 0.5)]
    qs = [(i, rnd.uniform(-0.5, 3.5), rnd.uniform(-0.5, 3.5)) for i in range(120)] + [(500, 0.5, 0.5), (501, 1.0, 1.0)]
    tol = 0.32
    out = spatial.pick(
        spark.createDataFrame(pts, "layer string, priority int, feature_id long, x double, y double"),
        spark.createDataFrame(segs, "layer string, priority int, feature_id long, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(qs, "query_id long, x double, y double"), tol,
    )
    got = {r.query_id: (r.layer, r.feature_id, r.dist) for r in out.collect()}
    want = {}
    for k, px, py in qs:
        all_ = [(l, p, f, x, y, x, y) for l, p, f, x, y in pts] + segs
        best = []
        for layer, prio, f, ax, ay, bx, by in all_:
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = 0.0 if n == 0 else min(max(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n, 0.0), 1.0)
            dist = math.sqrt((px - (ax + t * (bx - ax))) ** 2 + (py - (ay + t * (by - ay))) ** 2)
            if dist <= tol:
                best.append((-prio, dist, f, layer))
        if best:
            _, dist, f, layer = min(best)
            want[k] = (layer, f, dist)
    assert got.keys() == want.keys() and out.count() == len(want)
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-12 for k in want)


def test_points_are_counted_in_their_cells_by_many_tasks(spark):
    ring = [(1, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (0.9, 0.0), (0.9, 0.9), (0.0, 0.9), (0.0, 0.0)])]
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.95, 0.5)], "p long, lon double, lat double")
    out = spatial.points_in_polygons(pts, spark.createDataFrame(ring, "r long, seq long, lon double, lat double"), "p", "r", 1.0)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(x) for x in out.collect()] == [(1, 1)]
