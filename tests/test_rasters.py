import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolake.operators import geometry as geo
from geolake.operators import hydrology as hyd
from geolake.operators import raster, sampling
from geolake.sources import readers

D = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def frame(spark, a, name="v"):
    h, w = a.shape
    return spark.createDataFrame([(x, y, float(a[y, x])) for y in range(h) for x in range(w)], f"gx long, gy long, {name} double")


def dense(df, shape, col):
    out = np.full(shape, np.nan)
    for r in df.select("gx", "gy", col).collect():
        out[r.gy, r.gx] = r[col]
    return out


def flood(z, eps):
    h, w = z.shape
    f = np.full(z.shape, np.inf)
    heap = []
    for y in range(h):
        for x in range(w):
            if x in (0, w - 1) or y in (0, h - 1):
                f[y, x] = z[y, x]
                heapq.heappush(heap, (f[y, x], x, y))
    done = set()
    while heap:
        e, x, y = heapq.heappop(heap)
        if (x, y) in done:
            continue
        done.add((x, y))
        for dx, dy in D:
            nx, ny = x + dx, y + dy
            if 0 <= nx < w and 0 <= ny < h and (nx, ny) not in done:
                v = max(z[ny, nx], e + eps)
                if v < f[ny, nx]:
                    f[ny, nx] = v
                    heapq.heappush(heap, (v, nx, ny))
    return f


@pytest.mark.parametrize("block", [4, 64])
def test_fill_depressions(spark, block):
    z = np.random.default_rng(block).integers(0, 30, (13, 11)).astype(float)
    got = dense(hyd.fill_depressions(frame(spark, z), 1e-3, block), z.shape, "filled")
    np.testing.assert_allclose(got, flood(z, 1e-3), rtol=0, atol=1e-12)


def test_five_by_five_basin(spark):
    z = np.full((5, 5), 9.0)
    z[2, 2], z[2, 0] = 1.0, 5.0
    z[2, 1] = 4.0
    f = dense(hyd.fill_depressions(frame(spark, z), 0.1, 3), z.shape, "filled")
    assert f[2, 1] == pytest.approx(5.1) and f[2, 2] == pytest.approx(5.2)


def test_accumulation_adds_up(spark):
    z = np.random.default_rng(2).random((12, 9)) * 50
    filled = hyd.fill_depressions(frame(spark, z), 1e-3, 5).select("gx", "gy", F.col("filled").alias("v"))
    rec = raster.d8(filled, 10.0, 4)
    acc = hyd.accumulate(rec)
    small = {(r.gx, r.gy): r.acc for r in hyd.accumulate(rec, 3).collect()}
    out = acc.where("rx = gx and ry = gy").agg(F.sum("acc")).first()[0]
    assert out == z.size
    # against a walk from every cell
    to = {(r.gx, r.gy): (r.rx, r.ry) for r in rec.collect()}
    n = dict.fromkeys(to, 0)
    for c in to:
        while True:
            n[c] += 1
            if to[c] == c:
                break
            c = to[c]
    assert {(r.gx, r.gy): r.acc for r in acc.collect()} == n == small


@pytest.mark.parametrize("block", [4, 64])
def test_mfd(spark, block):
    z = np.random.default_rng(7).random((9, 10)) * 20
    got = dense(hyd.accumulate_mfd(frame(spark, z, "filled"), 4.0, 2.0, block), z.shape, "acc")
    acc = np.ones(z.shape)
    for i in np.argsort(-z, axis=None):
        y, x = divmod(int(i), z.shape[1])
        ws = []
        for dx, dy in D:
            nx, ny = x + dx, y + dy
            if 0 <= nx < z.shape[1] and 0 <= ny < z.shape[0] and z[ny, nx] < z[y, x]:
                ws.append((((z[y, x] - z[ny, nx]) / (2.0 * (math.sqrt(2) if dx and dy else 1))) ** 4.0, nx, ny))
        s = sum(w for w, *_ in ws)
        for w, nx, ny in ws:
            acc[ny, nx] += acc[y, x] * w / s
    np.testing.assert_allclose(got, acc, rtol=1e-9)


def regions(on, steps):
    lab, n = {}, 0
    for y, x in zip(*np.nonzero(on)):
        if (x, y) in lab:
            continue
        todo = [(x, y)]
        lab[(x, y)] = n
        while todo:
            a, b = todo.pop()
            for dx, dy in steps:
                c = (a + dx, b + dy)
                if 0 <= c[1] < on.shape[0] and 0 <= c[0] < on.shape[1] and on[c[1], c[0]] and c not in lab:
                    lab[c] = n
                    todo.append(c)
        n += 1
    return lab


@pytest.mark.parametrize("conn", [4, 8])
@pytest.mark.parametrize("block", [4, 64])
def test_regions(spark, conn, block):
    on = np.random.default_rng(conn).random((14, 15)) < 0.55
    df = frame(spark, on.astype(float)).where("v = 1")
    got = {(r.gx, r.gy): r.region for r in hyd.label_regions(df, conn, block).collect()}
    want = regions(on, D if conn == 8 else [d for d in D if 0 in d])
    assert got.keys() == want.keys()
    assert len(set(zip(got.values(), (want[c] for c in got)))) == len(set(want.values())) == len(set(got.values()))


def test_polygonize_area_and_holes(spark):
    on = np.zeros((8, 8), bool)
    on[1:6, 1:6] = True
    on[3, 3] = False
    on[6, 6] = True  # touches at a corner: same region with 8 neighbours
    r = hyd.polygonize(frame(spark, on.astype(float)).where("v = 1"), 4).cache()
    a = geo.plane_areas(r.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")}), ["region", "ring_id"]).collect()
    assert len({x.region for x in a}) == 1
    assert sorted(x.signed for x in a) == [-1.0, 26.0]


def test_pool_truncates_ragged_edge(spark):
    a = np.arange(35, dtype=float).reshape(5, 7)
    got = {(r.gx, r.gy): r.v for r in raster.block_pool(frame(spark, a), 2).collect()}
    assert got == {(x, y): a[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].max() for x in range(3) for y in range(2)}


@pytest.mark.parametrize("block", [3, 64])
def test_blur_keeps_mass_with_mirrored_edges(spark, block):
    a = np.random.default_rng(1).random((6, 5))
    got = dense(raster.blur(frame(spark, a), 1.2, block=block), a.shape, "v")
    w = raster.gaussian_weights(1.2)
    r = len(w) // 2

    def one(v, axis):
        p = np.take(v, [(i if i < v.shape[axis] else 2 * v.shape[axis] - 1 - i) for i in ((k % (2 * v.shape[axis])) for k in range(-r, v.shape[axis] + r))], axis)
        return np.apply_along_axis(lambda q: np.convolve(q, w, "valid"), axis, p)

    np.testing.assert_allclose(got, one(one(a, 0), 1), rtol=1e-12)
    assert got.sum() == pytest.approx(a.sum())


def test_neighbours_across_blocks_and_gaps(spark):
    a = np.arange(48, dtype=float).reshape(6, 8)
    df = frame(spark, a).where("not (gx = 3 and gy = 2)")
    for r in raster.neighbours(df, "v", 2).collect():
        for nm, (dx, dy) in zip(raster.NAMES, raster.STEPS):
            x, y = r.gx + dx, r.gy + dy
            inside = 0 <= x < 8 and 0 <= y < 6 and (x, y) != (3, 2)
            assert r[nm] == (a[y, x] if inside else None), (r.gx, r.gy, nm)


def test_wide_voids_settle(spark):
    """A void strip between a low and a high rim becomes an even slope."""
    from geolake.operators import hydrology

    w, h = 400, 3
    rows = [(x, y, 0.0 if x == 0 else 1000.0 if x == w else -1.0) for x in range(w + 1) for y in range(h)]
    cells = spark.createDataFrame(rows, "gx long, gy long, v double")
    voids = cells.where("v = -1").select("gx", "gy", F.lit(1).cast("long").alias("region"))
    got = hydrology.fill_voids(cells, voids, block=32).collect()
    assert max(abs(r.v - 1000.0 * r.gx / w) for r in got) < 1e-3


def test_settled_voids_are_registered(spark):
    """The registered query gives the heights at which every void cell is the mean of its neighbours."""
    import __spark_entry__ as entry
    from geolake.plans.fixtures import Tables

    sf = "/root/testdata/sf0.01"
    got = {(r.gx, r.gy): r.v for r in entry.queries()["r8_fill_voids_settled"](spark, sf).collect()}
    was = {(r.gx, r.gy): r.v for r in Tables(spark, sf).cells.collect()}
    changed = [c for c in was if got[c] != was[c]]
    assert len(got) == len(was) and len(changed) > 0
    for x, y in changed:
        near = [got[c] for c in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)) if c in got]
        assert abs(got[x, y] - np.mean(near)) < 1e-5


def _broad():
    """A void of 40 x 30 cells with a bay: heights, places, and the solution of its equations."""
    w, h = 44, 34
    v = np.fromfunction(lambda y, x: 20.0 * x + 5.0 * y + 300 * np.sin(y / 5), (h, w))
    void = np.zeros((h, w), bool)
    void[2:32, 2:42] = True
    void[2:20, 15:22] = False
    at = {c: i for i, c in enumerate(zip(*np.nonzero(void), strict=True))}
    a, b = np.eye(len(at)) * 4, np.zeros(len(at))
    for (y, x), i in at.items():
        for c in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if c in at:
                a[i, at[c]] = -1
            else:
                b[i] += v[c]
    return v, at, np.linalg.solve(a, b)


@pytest.mark.parametrize(("block", "direct", "tol"), [(32, 1 << 18, 1e-3), (16, 400, 20.0)])
def test_broad_voids_against_the_equations(spark, block, direct, tol):
    """Whole, and by cycles over blocks with a coarse system."""
    from geolake.operators import voids as solver

    v, at, want = _broad()
    cells = frame(spark, v)
    rows = [(int(x), int(y), 1) for y, x in at] + [(1, 33, 2), (0, 0, 3), (1, 0, 3)]
    voids = spark.createDataFrame(rows, "gx long, gy long, region long")
    got = {(r.gy, r.gx): r.v for r in solver.heights(cells, voids, tol, block, direct).collect()}
    assert max(abs(got[c] - want[i]) for c, i in at.items()) < tol
    assert got[33, 1] == pytest.approx((v[33, 0] + v[33, 2] + v[32, 1]) / 3)
    assert abs(got[0, 0] - (got[0, 1] + v[1, 0]) / 2) < tol and len(got) == len(rows)


def test_void_without_rim(spark):
    from geolake.operators import voids as solver

    alone = spark.createDataFrame([(x, 0, 5) for x in range(9)], "gx long, gy long, region long")
    none = spark.createDataFrame([], "gx long, gy long, v double")
    for direct in (100, 3):
        assert [r.v for r in solver.heights(none, alone, direct_cells=direct).collect()] == [0.0] * 9
    assert solver.heights(none, alone.limit(0)).collect() == []


def test_blur_tells_gaps_and_takes_an_empty_grid(spark):
    full = spark.range(30).selectExpr("id % 6 as gx", "floor(id / 6) as gy", "cast(id as double) as v")
    with pytest.raises(ValueError, match="do not fill"):
        raster.blur(full.where("gx <> 3 or gy <> 2"), 1.0)
    with pytest.raises(ValueError, match="do not fill"):
        raster.blur(full.union(full.where("gx = 1 and gy = 1")), 1.0)
    assert raster.blur(full.where("false"), 1.0).count() == 0 and raster.blur(full, 1.0).count() == 30


def test_outlines_left_of_and_above_zero(spark):
    def rings(dx, dy):
        cells = spark.createDataFrame([(x + dx, y + dy) for x, y in [(0, 0), (1, 0), (1, 1), (2, 2)]], "gx long, gy long")
        return {(r.x - dx, r.y - dy, r.seq) for r in hyd.polygonize(cells).collect()}

    assert rings(0, 0) == rings(-50, -7) and len(rings(0, 0)) == 10
    with pytest.raises(Exception, match="outlines need cells"):
        rings(1 << 28, 0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("align", ["corner", "center"])
def test_parent_taps_are_not_broadcast(spark, align):
    """The taps are many times the tiles they come from, which the optimizer does not see."""
    coarse = spark.range(64).selectExpr("id % 8 as gx", "id div 8 as gy", "cast(id as double) as v")
    wanted = spark.createDataFrame([(0, 0), (1, 1)], "tx long, ty long")
    got = sampling.fill_from_parent(wanted, coarse.where("gx < 0"), coarse, 8, align)
    assert "SortMergeJoin [cx" in plan_of(got)
    assert got.count() == 128


def test_stored_pixels_are_not_broadcast(spark):
    cells = spark.range(2).selectExpr("3 as z", "id as tx", "0L as ty", "1 - id as px", "2 * (1 - id) as py", "id * 2 + 5d as v")
    got = readers.scan_tile_range(cells, 3, (0, 1, 0, 0), 4)
    assert "BroadcastHashJoin" not in plan_of(got)
    assert got.count() == 32 and got.agg(F.sum("v")).first()[0] == 12.0


def test_taps_of_a_small_file_are_added_up_by_many_tasks(spark):
    from geolake.operators import sampling

    pts = spark.range(0, 40, 1, 1).select(F.col("id").alias("k"), (F.col("id") % 7 + 0.25).alias("x"), (F.col("id") % 5 + 0.75).alias("y"))
    cells = spark.range(80).select((F.col("id") % 8).alias("gx"), F.floor(F.col("id") / 8).cast("long").alias("gy"), F.col("id").cast("double").alias("v"))
    out = sampling.bilinear_at(pts, cells, "k", F.col("x"), F.col("y"))
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().sparkPlan().toString()
    assert out.count() == 40
