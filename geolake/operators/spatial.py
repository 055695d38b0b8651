"""Spatial joins on a grid-cell key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.geo import haversine_m, lonlat_to_tile, lonlat_to_tm2
from ..functions.shape import clamp
from ..session import cut
from .aggs import majority
from .geometry import ring_edges
from .ordered import _cols
from .windows import arc_ratio, top_n, to_segments

ROWS_MET = 5e6  # rows of a join that one task counts
RING3 = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1)]


def _cell(c, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("long")


def _cells_between(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(_cell(lo, size), _cell(hi, size))


def _explode_offsets(df: DataFrame, cx: str, cy: str, reach: int = 1) -> DataFrame:
    """A copy of each row for every cell within ``reach`` of (cx, cy)."""
    span = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))
    return (
        df.select("*", F.explode(span).alias("_i")).select("*", F.explode(span).alias("_j"))
        .withColumns({cx: F.col(cx) + F.col("_i"), cy: F.col(cy) + F.col("_j")}).drop("_i", "_j")
    )


# ------------------------------------------------------------- point in polygon
def _right_of(px, py, clamped: bool = False) -> Column:
    """The edge crosses the latitude ``py`` east of ``px``: one count of the even-odd rule.
    ``clamped``: rounding takes the crossing to no place beyond the edge's ends."""
    x = F.try_divide((F.col("lon1") - F.col("lon0")) * (py - F.col("lat0")), F.col("lat1") - F.col("lat0")) + F.col("lon0")
    if clamped:
        x = F.greatest(F.least(x, F.greatest("lon0", "lon1")), F.least("lon0", "lon1"))
    return ((F.col("lat0") > py) != (F.col("lat1") > py)) & F.coalesce(px < x, F.lit(False))


def _edge_cells(edges: DataFrame, cell: float) -> DataFrame:
    """Edges with the cells (_cx, _cy) that they pass, a hair's breadth more included."""
    low, high = F.least("lat0", "lat1"), F.greatest("lat0", "lat1")
    west, east = F.least("lon0", "lon1"), F.greatest("lon0", "lon1")
    hair = 1e-9 * (F.greatest(F.abs(west), F.abs(east), F.abs(low), F.abs(high)) + cell)
    e = edges.withColumns({"_low": low, "_high": high, "_west": west, "_east": east, "_hair": hair})
    e = e.withColumn("_cy", F.explode(_cells_between(F.col("_low") - F.col("_hair"), F.col("_high") + F.col("_hair"), cell)))

    def at(y: Column) -> Column:
        x = F.col("lon0") + F.try_divide((F.col("lon1") - F.col("lon0")) * (y - F.col("lat0")), F.col("lat1") - F.col("lat0"))
        return F.coalesce(x, F.col("_west"))

    ya = F.least(F.greatest("_low", F.col("_cy") * cell - F.col("_hair")), F.col("_high"))
    yb = F.greatest(F.least("_high", (F.col("_cy") + 1) * cell + F.col("_hair")), F.col("_low"))
    flat = F.col("_high") - F.col("_low") <= 4 * F.col("_hair")
    xa = F.when(flat, F.col("_west")).otherwise(F.greatest("_west", F.least(at(ya), at(yb)))) - F.col("_hair")
    xb = F.when(flat, F.col("_east")).otherwise(F.least("_east", F.greatest(at(ya), at(yb)))) + F.col("_hair")
    e = e.withColumn("_cx", F.explode(_cells_between(xa, xb, cell)))
    return e.drop("_low", "_high", "_west", "_east", "_hair")


def polygon_index(edges: DataFrame, ring_key, cell: float) -> tuple[DataFrame, DataFrame]:
    """What a point needs to know of rings, by cell. The first table has the edges in
    each cell (_cx, _cy), with ``_odd``: whether the cell's south-east corner lies
    inside. The second has the cells inside that no edge passes, as runs of a row cut
    into aligned pieces of 1, 2, 4, ... cells (_level, _cx, _cy): a wide ring is a few
    pieces a row, not all of its cells."""
    rk = _cols(ring_key)
    met = _edge_cells(edges.where("lat0 <> lat1 or lon0 <> lon1").select(*rk, "lon0", "lat0", "lon1", "lat1"), cell)
    # where edges cross the south side of a row, and the last corner west of that
    rows = edges.where("lat0 <> lat1").select("*", F.explode(_cells_between(F.least("lat0", "lat1") - cell, F.greatest("lat0", "lat1") + cell, cell)).alias("_cy"))
    y = F.col("_cy") * cell
    x = (F.col("lon1") - F.col("lon0")) * (y - F.col("lat0")) / (F.col("lat1") - F.col("lat0")) + F.col("lon0")
    x = F.greatest(F.least(x, F.greatest("lon0", "lon1")), F.least("lon0", "lon1"))
    rows = rows.where((F.col("lat0") > y) != (F.col("lat1") > y)).withColumn("_x", x)
    c = _cell("_x", cell)
    corner = F.when((c + 1) * cell < F.col("_x"), c).when(c * cell < F.col("_x"), c - 1).otherwise(c - 2)
    events = rows.select(*rk, "_cy", corner.alias("_cx"), F.lit(1).alias("_n"), F.lit(0).alias("_kind"))
    cells = met.select(*rk, "_cy", "_cx").distinct()
    asked = cells.select("*", F.lit(0).alias("_n"), F.lit(1).alias("_kind"))
    before = cells.select(*rk, "_cy", (F.col("_cx") - 1).alias("_cx"), F.lit(0).alias("_n"), F.lit(2).alias("_kind"))
    east = Window.partitionBy(*rk, "_cy").orderBy(F.desc("_cx")).rangeBetween(Window.unboundedPreceding, 0)
    known = events.unionByName(asked).unionByName(before).withColumn("_odd", F.sum("_n").over(east) % 2 == 1)
    corners = known.where("_kind = 1").select(*rk, "_cx", "_cy", "_odd")
    held = met.join(corners, [*rk, "_cx", "_cy"])
    # the cells between two neighbouring ones with edges
    row = Window.partitionBy(*rk, "_cy").orderBy("_cx")
    gaps = known.where("_kind = 2").select(*rk, "_cy", "_cx", "_odd", (F.lag("_cx").over(row) + 2).alias("_from"))
    gaps = gaps.where("_odd and _from <= _cx").withColumn("_level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_cx") - F.col("_from") + 1)).cast("int"))))
    size = F.pow(F.lit(2.0), F.col("_level"))
    a, b = F.ceil(F.col("_from") / size).cast("long"), (F.floor((F.col("_cx") + 1) / size) - 1).cast("long")
    ends = F.array(F.when((a % 2 != 0) & (a <= b), a), F.when((b % 2 == 0) & (a <= b), b))
    full = gaps.select(*rk, "_cy", "_level", F.explode(ends).alias("_at")).where("_at is not null")
    return held, full.select(*rk, "_level", F.col("_at").alias("_cx"), "_cy")


def points_in_polygons(points: DataFrame, rings: DataFrame, point_key: str, ring_key, cell: float) -> DataFrame:
    """(point, ring) pairs whose point is inside by the even-odd rule, counted eastwards.

    A point meets the edges of its own cell only, however many a ring has. The edges
    east of the cell are counted through the cell's south-east corner: on the way from
    the point east to the cell's side and south along it, only edges in the cell can
    change the count. Half-open comparisons are those of the plain rule, so points on
    edges and corners fall as they do there."""
    rk = _cols(ring_key)
    edges, full = polygon_index(ring_edges(rings, rk), rk, cell)
    p = points.select(point_key, F.col("lon").alias("_px"), F.col("lat").alias("_py"))
    p = p.withColumns({"_cx": _cell("_px", cell), "_cy": _cell("_py", cell)})
    side, south = (F.col("_cx") + 1) * cell, F.col("_cy") * cell
    px, py = F.col("_px"), F.col("_py")
    upper = F.when(F.col("lon0") > F.col("lon1"), F.col("lat0")).otherwise(F.col("lat1"))
    across = (F.col("lon0") > side) != (F.col("lon1") > side)
    # an edge across the side: whether its eastern end lies above, and whether it is counted there
    turns = across & (((upper > py) != (upper > south)) != (_right_of(side, py, True) != _right_of(side, south, True)))
    n = (_right_of(px, py) != _right_of(side, py, True)).cast("int") + turns.cast("int")
    # a point and a ring meet in one cell: counted there, in tasks by number of rows met
    edges = cut(edges)
    at = ["_cx", "_cy"]
    met = p.groupBy(*at).agg(F.count("*").cast("double").alias("_a")).join(edges.groupBy(*at).agg(F.count("*").alias("_b")), at)
    met = met.agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0.0
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(met / ROWS_MET) + 1, 20_000))
    dealt = p.repartition(tasks, *at).join(edges.repartition(tasks, *at).hint("merge"), at)
    near = dealt.groupBy(*at, point_key, *rk).agg((F.sum(n) + F.first(F.col("_odd").cast("int"))).alias("_n"))
    near = near.where("_n % 2 = 1").select(point_key, *rk)
    # runs are no longer than the widest ring
    widest = rings.groupBy(*rk).agg((F.max(_cell("lon", cell)) - F.min(_cell("lon", cell))).alias("_w")).agg(F.max("_w")).first()[0] or 0
    if widest < 2:
        return near
    levels = range(int(widest).bit_length())
    q = p.select(point_key, F.explode(F.array(*[F.lit(n) for n in levels])).alias("_level"), F.col("_cx").alias("_c"), "_cy")
    q = q.withColumn("_cx", F.floor(F.col("_c") / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    return near.unionByName(q.join(full.hint("merge"), ["_level", "_cx", "_cy"]).select(point_key, *rk))


def _segment_distance(px, py, x0, y0, x1, y1) -> tuple[Column, Column]:
    """(distance, clamped position 0..1) from a point to a segment."""
    dx, dy = x1 - x0, y1 - y0
    len2 = F.pow(dx, F.lit(2.0)) + F.pow(dy, F.lit(2.0))
    # try_divide: a segment without length has position 0
    t = F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, len2), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    two = F.lit(2.0)
    return F.sqrt(F.pow(px - (x0 + t * dx), two) + F.pow(py - (y0 + t * dy), two)), t


def polygons_near(points: DataFrame, rings: DataFrame, point_key: str, ring_key, tol: float, cell: float) -> DataFrame:
    """(point, ring) pairs with the point inside or within ``tol`` degrees."""
    rk = _cols(ring_key)
    inside = points_in_polygons(points, rings, point_key, rk, cell)
    e = ring_edges(rings, rk)
    lo = lambda a: F.least(f"{a}0", f"{a}1") - tol
    hi = lambda a: F.greatest(f"{a}0", f"{a}1") + tol
    e = e.select("*", F.explode(_cells_between(lo("lon"), hi("lon"), cell)).alias("_cx")).select(
        "*", F.explode(_cells_between(lo("lat"), hi("lat"), cell)).alias("_cy")
    )
    p = points.select(point_key, F.col("lon").alias("_px"), F.col("lat").alias("_py"))
    p = p.withColumns({"_cx": _cell("_px", cell), "_cy": _cell("_py", cell)})
    d, _ = _segment_distance(F.col("_px"), F.col("_py"), *[F.col(c) for c in ("lon0", "lat0", "lon1", "lat1")])
    near = p.join(e, ["_cx", "_cy"]).where(d <= tol).select(point_key, *rk)
    return inside.unionByName(near).distinct()


def tag_by_vote(samples: DataFrame, polygons: DataFrame, attrs: DataFrame, group: str, tol: float, fallback_tol: float, cell: float, default_kind: int = 6) -> DataFrame:
    """Most voted (name, kind) of the polygons near each group's samples. Groups
    without a vote get a second pass with the wider tolerance; what is still
    without one gets ``default_kind``. ``samples`` holds sample_id, group, lon,
    lat; ``polygons`` ring vertices by zone_id; ``attrs`` zone_id, name, kind."""
    own = samples.select("sample_id", group)

    def votes(s: DataFrame, t: float) -> DataFrame:
        hits = polygons_near(s, polygons, "sample_id", "zone_id", t, cell)
        v = hits.join(own, "sample_id").join(attrs.select("zone_id", "kind", "name"), "zone_id")
        return majority(v, group, ["kind", "name"])

    tight = cut(votes(samples, tol).withColumn("pass_no", F.lit(1)))
    orphans = samples.join(tight.select(group), group, "left_anti")
    wide = votes(orphans, fallback_tol).withColumn("pass_no", F.lit(2))
    tagged = tight.unionByName(wide)
    return (
        samples.select(group).distinct().join(tagged, group, "left")
        .withColumns({"kind": F.coalesce("kind", F.lit(default_kind)), "pass_no": F.coalesce("pass_no", F.lit(0)), "votes": F.coalesce("votes", F.lit(0))})
    )


# ------------------------------------------------------------------ nearest things
def nearest_within(left: DataFrame, right: DataFrame, r_m: float, left_key: str = "end_id", chain: str = "chain", cell: float = 0.0003) -> DataFrame:
    """Nearest right vertex of another chain, closer than ``r_m`` metres, over
    the 3 x 3 neighbouring grid cells. Ties go to the lowest chain, then vertex.

    Copies at one exact spot are folded to two chains first (the lowest and the
    next different one): no other copy can ever be the answer."""
    spot = right.groupBy("lon", "lat", chain).agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("lon", "lat").orderBy(chain)
    spot = spot.withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    r = spot.select(
        F.col(chain).alias("near_chain"), F.col("seq").alias("near_seq"), F.col("lon").alias("near_lon"), F.col("lat").alias("near_lat"),
        _grid("lon", cell).alias("_cx"), _grid("lat", cell).alias("_cy"),
    )
    q = _explode_offsets(left.select(left_key, chain, "lon", "lat", _grid("lon", cell).alias("_cx"), _grid("lat", cell).alias("_cy")), "_cx", "_cy")
    d = haversine_m("lon", "lat", "near_lon", "near_lat")
    j = q.join(r, ["_cx", "_cy"]).where(F.col("near_chain") != F.col(chain)).withColumn("dist_m", d).where(F.col("dist_m") < r_m)
    best = F.min_by(F.struct("near_chain", "near_seq", "near_lon", "near_lat", "dist_m"), F.struct("dist_m", "near_chain", "near_seq"))
    return j.groupBy(left_key).agg(best.alias("_b")).select(left_key, "_b.*")


def _grid(c: str, cell: float) -> Column:
    return (F.col(c) / cell).cast("long")


CROWD = 50_000  # rows of a side above which a cell's work is dealt over several tasks
PAIRS_HELD = 1 << 18  # distances a task holds at once
FULL = 1_000  # segments of a cell that are met in one pass rather than as joined rows


def _deal(p: DataFrame, s: DataFrame, point_cols, line_key: str):
    """Rows of both sides grouped by cell (_cx, _cy), to be met in one task each; a cell
    with a crowd on a side is cut by points and by lines (_i, _j)."""
    size = p.groupBy("_cx", "_cy").agg(F.count("*").alias("_np")).join(s.groupBy("_cx", "_cy").agg(F.count("*").alias("_ns")), ["_cx", "_cy"])
    size = cut(size)
    work = size.agg(F.sum(F.col("_np").cast("double") * F.col("_ns"))).first()[0] or 0.0
    crowd = size.where((F.col("_np") > CROWD) | (F.col("_ns") > CROWD))
    crowd = crowd.select("_cx", "_cy", F.ceil(F.col("_np") / CROWD).alias("_a"), F.ceil(F.col("_ns") / CROWD).alias("_b"))
    if crowd.isEmpty():
        p, s = (d.withColumns({"_i": F.lit(0).cast("long"), "_j": F.lit(0).cast("long")}) for d in (p, s))
    else:
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
        one = lambda n, *c: F.coalesce(F.pmod(F.xxhash64(*c), n), F.lit(0).cast("long"))
        p = p.join(crowd, ["_cx", "_cy"], "left").withColumns({"_i": one(F.col("_a"), *point_cols), "_j": every(F.col("_b"))}).drop("_a", "_b")
        s = s.join(crowd, ["_cx", "_cy"], "left").withColumns({"_j": one(F.col("_b"), line_key), "_i": every(F.col("_a"))}).drop("_a", "_b")
    keys = ["_cx", "_cy", "_i", "_j"]
    # little to read, much to compare: tasks by number of distances, not by bytes
    tasks = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(work / 2e8) + 1, 20_000))
    return [d.repartition(tasks, *keys).groupBy(*keys) for d in (p, s)]


def locate_on_lines(points: DataFrame, vertices: DataFrame, max_m: float, point_key: str = "station", line_key: str = "part_id") -> DataFrame:
    """Nearest position of each point on each line within ``max_m`` projected
    metres: dist_m, ratio and length_m. The first segment wins ties.

    A point lies in one cell, and all segments near it are dealt to that cell: the best
    segment of a line is found there, so no pair of a point and a segment is ever
    shuffled. Crowded cells are cut by points and by lines."""
    x, y = lonlat_to_tm2("lon", "lat")
    v = arc_ratio(vertices.select(line_key, "seq", "lon", "lat"), line_key)
    s = to_segments(v.select(line_key, "seq", "x", "y", "cum_m", "length_m"), line_key, ("x", "y", "cum_m"))
    s = cut(s.select(line_key, "seq", "x0", "y0", "x1", "y1", "cum_m0", "cum_m1", "length_m"))
    lo = lambda a: F.least(f"{a}0", f"{a}1") - max_m
    hi = lambda a: F.greatest(f"{a}0", f"{a}1") + max_m
    cell = max_m * 2
    s = s.select("*", F.explode(_cells_between(lo("x"), hi("x"), cell)).alias("_cx")).select(
        "*", F.explode(_cells_between(lo("y"), hi("y"), cell)).alias("_cy")
    )
    p = points.select(point_key, x.alias("_px"), y.alias("_py")).withColumns({"_cx": _cell("_px", cell), "_cy": _cell("_py", cell)})
    p, s = _deal(p, s, [point_key, "_px", "_py"], line_key)
    out = T.StructType([T.StructField(c, t) for c, t in [(point_key, points.schema[point_key].dataType), (line_key, vertices.schema[line_key].dataType)]])
    out = out.add("seq", vertices.schema["seq"].dataType).add("dist_m", "double").add("ratio", "double").add("length_m", "double")
    j = p.cogroup(s).applyInArrow(_best_segments(max_m, point_key, line_key), out)
    if not points.groupBy(point_key).count().where("count > 1").isEmpty():  # one key at several places
        best = F.min_by(F.struct("dist_m", "ratio", "length_m"), F.struct("dist_m", "seq"))
        return j.groupBy(point_key, line_key).agg(best.alias("_b")).select(point_key, line_key, "_b.*")
    return j.drop("seq")


def _best_segments(max_m: float, point_key: str, line_key: str):
    """The task of a cell: for its points and lines the first nearest segment."""

    def best(pts, segs):
        import numpy as np
        import pyarrow as pa

        segs = segs.sort_by([(line_key, "ascending"), ("seq", "ascending")])
        num = lambda t, c: t[c].to_numpy().astype("float64")
        px, py = num(pts, "_px"), num(pts, "_py")
        x0, y0, x1, y1, c0, c1, length = (num(segs, c) for c in ("x0", "y0", "x1", "y1", "cum_m0", "cum_m1", "length_m"))
        n = len(x0)
        names = [point_key, line_key, "seq", "dist_m", "ratio", "length_m"]
        who, seg, dist, arc = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0)], [np.zeros(0)]
        if n and len(px):
            line = segs[line_key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1])
            sizes = np.diff(np.append(starts, n))
            dx, dy, at = x1 - x0, y1 - y0, np.arange(n)
            len2 = dx * dx + dy * dy
            step = max(1, PAIRS_HELD // n)
            for i in range(0, len(px), step):
                qx, qy = px[i : i + step, None], py[i : i + step, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(len2 == 0, 0.0, ((qx - x0) * dx + (qy - y0) * dy) / len2)
                t = np.minimum(np.maximum(t, 0.0), 1.0)
                ex, ey = qx - (x0 + t * dx), qy - (y0 + t * dy)
                d = np.sqrt(ex * ex + ey * ey)
                low = np.fmin.reduceat(d, starts, axis=1)
                a, b = np.nonzero(low < max_m)
                if not len(a):
                    continue
                first = np.minimum.reduceat(np.where(d == np.repeat(low, sizes, axis=1), at, n), starts, axis=1)[a, b]
                who.append(a + i)
                seg.append(first)
                dist.append(low[a, b])
                arc.append(c0[first] + t[a, first] * (c1[first] - c0[first]))
        who, seg, dist, arc = (np.concatenate(c) for c in (who, seg, dist, arc))
        whole = length[seg]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(whole <= 0, 0.0, arc / whole)
        cols = [pts[point_key].take(pa.array(who)), segs[line_key].take(pa.array(seg)), segs["seq"].take(pa.array(seg))]
        return pa.Table.from_arrays([*cols, pa.chunked_array([dist]), pa.chunked_array([ratio]), pa.chunked_array([whole])], names=names)

    return best


def build_tracks(stations: DataFrame, vertices: DataFrame, max_m: float = 800.0) -> DataFrame:
    """Linear-reference table: stations closer than ``max_m`` to each part."""
    t = locate_on_lines(stations, vertices, max_m)
    return t.select("part_id", "station", F.round("ratio", 4).alias("ratio"), F.round("dist_m", 1).alias("dist_m"), F.round("length_m", 1).alias("length_m"))


# --------------------------------------------------------------------- top-k near
def gather_near(centers: DataFrame, points: DataFrame, r: float, cap: int, center_key: str = "center_id", point_key: str = "point_id", leaf_rows: int = 64) -> DataFrame:
    """The ``cap`` nearest points within ``r`` of each centre in the plane (x, y);
    ties go to the lower key.

    Exact and safe in crowded places: copies at one spot are folded to ``cap``
    rows; crowded cells are split in four, level by level, and a centre only
    descends into cells that can still hold one of its nearest (bounded by the
    counts of cells lying wholly nearer). Leaves are small, so a centre meets about as
    many points however many there are."""
    wspot = Window.partitionBy("x", "y").orderBy(point_key)
    p = points.select(point_key, "x", "y").withColumn("_k", F.row_number().over(wspot)).where(F.col("_k") <= cap).drop("_k")
    leaf_rows = max(leaf_rows, cap)
    # few bytes a centre, much work: tasks by number of centres
    tasks = max(int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions")), centers.count() // 4_000 + 1)

    def keyed(df: DataFrame, level: int) -> DataFrame:
        side = r / 2**level
        return df.withColumns({"_cx": _cell("x", side), "_cy": _cell("y", side)})

    front = _explode_offsets(keyed(centers.select(center_key, "x", "y"), 0), "_cx", "_cy")
    rest, out, level = p, [], 0
    while True:
        side = r / 2**level
        here = keyed(rest, level)
        counts = here.groupBy("_cx", "_cy").agg(F.count("*").alias("_n"))
        crowded = counts.where(F.col("_n") > leaf_rows).select("_cx", "_cy", F.lit(True).alias("_split"))
        more = level < 30 and not crowded.isEmpty()
        x0, y0 = F.col("_cx") * side, F.col("_cy") * side
        near_x = F.greatest(x0 - F.col("x"), F.col("x") - x0 - side, F.lit(0.0))
        near_y = F.greatest(y0 - F.col("y"), F.col("y") - y0 - side, F.lit(0.0))
        far_x, far_y = F.greatest(F.abs(F.col("x") - x0), F.abs(F.col("x") - x0 - side)), F.greatest(F.abs(F.col("y") - y0), F.abs(F.col("y") - y0 - side))
        f = front.withColumn("_min2", near_x * near_x + near_y * near_y).where(F.col("_min2") <= r * r)
        if not more:
            out.append(_near_pairs(f.repartition(tasks, "_cx", "_cy"), here, r, cap, center_key, point_key))
            break
        f = f.withColumn("_max2", far_x * far_x + far_y * far_y).join(counts, ["_cx", "_cy"])
        w = Window.partitionBy(center_key).orderBy("_max2").rowsBetween(Window.unboundedPreceding, 0)
        f = f.withColumn("_cum", F.sum("_n").over(w))
        bound = f.where(F.col("_cum") >= cap).groupBy(center_key).agg(F.min("_max2").alias("_u"))
        f = f.join(bound, center_key, "left").where(F.col("_min2") <= F.coalesce("_u", F.lit(r * r)))
        f = cut(f.join(crowded, ["_cx", "_cy"], "left").select(center_key, "x", "y", "_cx", "_cy", "_split"))
        here = here.join(crowded, ["_cx", "_cy"], "left")
        out.append(_near_pairs(f.where("_split is null").repartition(tasks, "_cx", "_cy"), here.where("_split is null"), r, cap, center_key, point_key))
        rest = cut(here.where("_split").select(point_key, "x", "y"))
        kid = F.explode(F.array(F.lit(0), F.lit(1)))
        front = f.where("_split").select("*", kid.alias("_i")).select("*", kid.alias("_j"))
        front = front.select(center_key, "x", "y", (F.col("_cx") * 2 + F.col("_i")).alias("_cx"), (F.col("_cy") * 2 + F.col("_j")).alias("_cy"))
        level += 1
    pairs = out[0]
    for o in out[1:]:
        pairs = pairs.unionByName(o)
    return top_n(pairs, center_key, ["d2", point_key], cap)


def _near_pairs(front, here, r, cap, center_key, point_key):
    q = here.select(point_key, F.col("x").alias("_qx"), F.col("y").alias("_qy"), "_cx", "_cy")
    dx, dy = F.col("_qx") - F.col("x"), F.col("_qy") - F.col("y")
    j = front.join(q, ["_cx", "_cy"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= r * r)
    return top_n(j.select(center_key, point_key, "d2"), center_key, ["d2", point_key], cap).drop("rank")


def pick(points: DataFrame, segments: DataFrame, queries: DataFrame, tol: float, query_key: str = "query_id") -> DataFrame:
    """Nearest feature within ``tol`` per query; a later layer (higher
    ``priority``) wins over any earlier one. ``points`` hold layer, priority,
    feature_id, x, y; ``segments`` x0, y0, x1, y1 instead.

    Queries look around in widening cells: one that finds a feature of the highest
    priority within a cell's side is settled, so crowded places are never met whole."""
    feat = ["layer", "priority", "feature_id"]
    # copies of one spot in one layer: only the lowest feature can be picked
    pts = points.groupBy("layer", "priority", "x", "y").agg(F.min("feature_id").alias("feature_id"))
    a = pts.select(*feat, F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    every = cut(a.unionByName(segments.select(*feat, "x0", "y0", "x1", "y1")))
    top = every.agg(F.max("priority")).first()[0]
    todo = queries.select(query_key, F.col("x").alias("_px"), F.col("y").alias("_py"))
    out = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), *[every.schema[c] for c in feat]]).add("dist", "double")
    best = F.min_by(F.struct(*feat, "dist"), F.struct((-F.col("priority")).alias("p"), "dist", "feature_id"))
    done = None
    d, _ = _segment_distance(F.col("_px"), F.col("_py"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    for r in (tol / 16, tol):
        lo = lambda c: F.least(f"{c}0", f"{c}1") - r  # noqa: B023, E731
        hi = lambda c: F.greatest(f"{c}0", f"{c}1") + r  # noqa: B023, E731
        s = every.select("*", F.explode(_cells_between(lo("x"), hi("x"), r)).alias("_cx")).select(
            "*", F.explode(_cells_between(lo("y"), hi("y"), r)).alias("_cy")
        )
        q = todo.withColumns({"_cx": _cell("_px", r), "_cy": _cell("_py", r)})
        if r < tol:  # many cells with little in each: a plain join, but for the full ones
            full = cut(s.groupBy("_cx", "_cy").agg(F.count("*").alias("_n")).where(F.col("_n") > FULL).select("_cx", "_cy"))
            # the optimizer does not see how many cells a segment has: it would broadcast them all
            tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), q.count() // 50_000 + 1)
            few = q.join(full, ["_cx", "_cy"], "left_anti").repartition(tasks, "_cx", "_cy").join(s.hint("merge"), ["_cx", "_cy"]).withColumn("dist", d).where(F.col("dist") <= r)
            q, s = (side.join(full, ["_cx", "_cy"], "left_semi") for side in (q, s))
        q, s = _deal(q, s, [query_key, "_px", "_py"], "feature_id")
        j = q.cogroup(s).applyInArrow(_best_features(r, query_key), out)
        if r < tol:
            j = j.unionByName(few.select(*j.columns))
        j = cut(j.groupBy(query_key).agg(best.alias("_b")).select(query_key, "_b.*"))
        if r == tol:
            return j if done is None else done.unionByName(j)
        found = j.where(F.col("priority") == F.lit(top))
        done = found if done is None else done.unionByName(found)
        todo = cut(todo.join(found.select(query_key), query_key, "left_anti"))


def _best_features(r: float, query_key: str):
    """The task of a cell: for its queries the nearest feature of the highest priority."""

    def best(queries, segs):
        import numpy as np
        import pyarrow as pa

        segs = segs.sort_by([("priority", "descending"), ("feature_id", "ascending"), ("layer", "ascending")])
        num = lambda t, c: t[c].to_numpy().astype("float64")
        px, py = num(queries, "_px"), num(queries, "_py")
        x0, y0, x1, y1 = (num(segs, c) for c in ("x0", "y0", "x1", "y1"))
        n = len(x0)
        who, seg, dist = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0)]
        if n and len(px):
            rank = segs["priority"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(rank)) + 1])
            ends = np.append(starts[1:], n)
            dx, dy = x1 - x0, y1 - y0
            len2 = dx * dx + dy * dy
            step = max(1, PAIRS_HELD // n)
            for i in range(0, len(px), step):
                qx, qy = px[i : i + step, None], py[i : i + step, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(len2 == 0, 0.0, ((qx - x0) * dx + (qy - y0) * dy) / len2)
                t = np.minimum(np.maximum(t, 0.0), 1.0)
                ex, ey = qx - (x0 + t * dx), qy - (y0 + t * dy)
                d = np.sqrt(ex * ex + ey * ey)
                d = np.where(d <= r, d, np.inf)
                left = np.arange(len(qx))
                for a, b in zip(starts, ends):  # the highest priority first
                    at = d[left, a:b].argmin(axis=1) + a
                    low = d[left, at]
                    hit = low <= r
                    who.append(left[hit] + i)
                    seg.append(at[hit])
                    dist.append(low[hit])
                    left = left[~hit]
        who, seg, dist = (np.concatenate(c) for c in (who, seg, dist))
        cols = [queries[query_key].take(pa.array(who)), *[segs[c].take(pa.array(seg)) for c in ("layer", "priority", "feature_id")]]
        return pa.Table.from_arrays([*cols, pa.chunked_array([dist])], names=[query_key, "layer", "priority", "feature_id", "dist"])

    return best


def assign_tiles(df: DataFrame, z: int, kind: str = "point") -> DataFrame:
    """Rows with the tiles they touch by their box: points (lon, lat), segments
    (lon0, lat0, lon1, lat1) or boxes (min_lon, min_lat, max_lon, max_lat)."""
    if kind == "point":
        k = lonlat_to_tile("lon", "lat", z)
        return df.select("*", k["tx"].alias("tx"), k["ty"].alias("ty"))
    if kind == "segment":
        x0, x1 = F.least("lon0", "lon1"), F.greatest("lon0", "lon1")
        y0, y1 = F.least("lat0", "lat1"), F.greatest("lat0", "lat1")
    else:
        x0, x1, y0, y1 = F.col("min_lon"), F.col("max_lon"), F.col("min_lat"), F.col("max_lat")
    a, b = lonlat_to_tile(x0, y1, z), lonlat_to_tile(x1, y0, z)
    return df.select("*", F.explode(F.sequence(a["tx"], b["tx"])).alias("tx"), a["ty"].alias("_a"), b["ty"].alias("_b")).select(
        *df.columns, "tx", F.explode(F.sequence("_a", "_b")).alias("ty")
    )


def tile_neighbourhood(points: DataFrame, z: int, radius: int = 1) -> DataFrame:
    """Distinct tiles within ``radius`` of the points' tiles."""
    t = assign_tiles(points.select("lon", "lat"), z).select("tx", "ty").distinct()
    return _explode_offsets(t, "tx", "ty", radius).distinct()


def cap_nearest(tiles: DataFrame, n: int, part, order) -> DataFrame:
    return top_n(tiles, part, order, n)


# ----------------------------------------------------------------- greedy selection
def spread_pick(cands: DataFrame, group: str, ident: str, rank: Column, min_sep: float, limit: int | None = None) -> DataFrame:
    """Greedy selection in descending ``rank`` (a double; ties by lower
    ``ident``) keeping picks at least ``min_sep`` apart in (x, y), at most
    ``limit`` per group.

    Rounds pick every candidate that has no better candidate nearby: exactly
    those the one-by-one greedy would take. Two points in one cell of side
    min_sep / sqrt 2 exclude each other, so only the best of each cell can be
    picked, and all comparisons are one cell-best against rows: linear in the
    candidates however crowded a cell is."""
    side = min_sep / 2**0.5 * 0.999999
    cols = [group, ident, "x", "y", "_r"]
    live = cut(cands.withColumn("_r", rank.cast("double")).select(*cols).withColumns({"_cx": _cell("x", side), "_cy": _cell("y", side)}))
    picked = None
    better = (F.col("_r") > F.col("_br")) | ((F.col("_r") == F.col("_br")) & (F.col(ident) < F.col("_bid")))
    close = (F.col("x") - F.col("_bx")) * (F.col("x") - F.col("_bx")) + (F.col("y") - F.col("_by")) * (F.col("y") - F.col("_by")) < min_sep * min_sep
    while True:
        top = live.groupBy(group, "_cx", "_cy").agg(F.max_by(F.struct(ident, "x", "y", "_r"), F.struct("_r", (-F.col(ident)).alias("i"))).alias("b"))
        best = top.select(group, "_cx", "_cy", F.col(f"b.{ident}").alias("_bid"), F.col("b.x").alias("_bx"), F.col("b.y").alias("_by"), F.col("b._r").alias("_br"))
        spread = cut(_explode_offsets(best, "_cx", "_cy", 2))
        met = live.join(spread, [group, "_cx", "_cy"]).where(close)
        beaten = met.where(better & (F.col(ident) != F.col("_bid"))).select(group, F.col("_bid").alias(ident)).distinct()
        new = cut(best.select(group, F.col("_bid").alias(ident), F.col("_bx").alias("x"), F.col("_by").alias("y"), F.col("_br").alias("_r")).join(beaten, [group, ident], "left_anti"))
        picked = new if picked is None else cut(picked.unionByName(new))
        gone = live.join(spread.join(new.select(group, F.col(ident).alias("_bid")), [group, "_bid"], "left_semi"), [group, "_cx", "_cy"]).where(close)
        left = live.join(gone.select(group, ident).distinct(), [group, ident], "left_anti")
        if limit is not None:
            # a group is settled once `limit` picks rank above all that is left
            edge = top_n(picked, group, [F.desc("_r"), ident], limit).groupBy(group).agg(F.count("*").alias("_n"), F.min("_r").alias("_lo"))
            left = left.join(edge, group, "left").where((F.coalesce("_n", F.lit(0)) < limit) | (F.col("_r") >= F.col("_lo"))).drop("_n", "_lo")
        live = cut(left)
        if live.isEmpty():
            break
    if limit is None:
        return picked.withColumnRenamed("_r", "score")
    return top_n(picked, group, [F.desc("_r"), ident], limit).withColumnRenamed("_r", "score")


PEAKS_HELD = 8  # best points of a cell that a centre sees in the first round


def select_peaks(points: DataFrame, centers: DataFrame, radius: float, min_sep: float, limit: int = 15, min_elev: float = 0.0, point_key: str = "point_id") -> DataFrame:
    """Highest points within ``radius`` of each centre, thinned to ``min_sep``: the
    one-by-one choice from the highest down, ties to the lower key, at most ``limit``.

    A round shows a centre the best few points of each cell. Where a cell holds more, the
    first one left out ends the choice, unless a pick rules out the whole cell. Centres
    that ended short of ``limit`` choose anew among twice as many of cells half as wide,
    until cells hold no more than is shown: no centre meets all points around it."""
    order = F.struct(F.col("elev").alias("r"), (-F.col(point_key)).alias("i"), "x", "y")
    # of points at one spot only the first can be chosen
    spots = points.where(F.col("elev") >= min_elev).withColumn("elev", F.col("elev").cast("double"))
    if min_sep > 0:
        spots = spots.groupBy("x", "y").agg(F.max(F.struct(F.col("elev").alias("r"), (-F.col(point_key)).alias("i"))).alias("b")).select("b.r", "b.i", "x", "y")
    else:
        spots = spots.select(order.alias("b")).select("b.*")
    spots = cut(spots)
    # few bytes a centre, much work: by number, or all would stand in one partition
    todo = centers.select("center_id", F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    todo = cut(todo.repartition(int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "center_id"))
    side, held, out = max(min_sep / 2**0.5, radius / 4) * 0.999999, PEAKS_HELD, None
    row = "struct<r:double,i:bigint,x:double,y:double>"
    while True:
        s = spots.withColumns({"_cx": _cell("x", side), "_cy": _cell("y", side)})
        best = Window.partitionBy("_cx", "_cy").orderBy(F.desc("r"), F.desc("i"))
        s = s.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= held + 1)
        # the row beyond the shown ones is the bar of its cell
        seen = F.collect_list(F.struct("r", "i", "x", "y", (F.col("_k") > held).alias("bar"), "_cx", "_cy")).alias("_s")
        cells = cut(s.groupBy("_cx", "_cy").agg(seen))
        near = lambda c, at: F.greatest(F.col(f"_c{c}") * side - F.col(at), F.col(at) - (F.col(f"_c{c}") + 1) * side, F.lit(0.0))
        c = todo.select("*", F.explode(_cells_between(F.col("_x") - radius, F.col("_x") + radius, side)).alias("_cx"))
        c = c.select("*", F.explode(_cells_between(F.col("_y") - radius, F.col("_y") + radius, side)).alias("_cy"))
        c = c.where(near("x", "_x") * near("x", "_x") + near("y", "_y") * near("y", "_y") <= (radius * (1 + 1e-9)) ** 2)
        inside = lambda g: (g["x"] - F.col("_x")) * (g["x"] - F.col("_x")) + (g["y"] - F.col("_y")) * (g["y"] - F.col("_y")) <= radius * radius
        shown = F.filter("_s", lambda g: g["bar"] | inside(g))
        # the optimizer does not see how many cells a centre has: it would broadcast them all
        c = c.join(cells.hint("merge"), ["_cx", "_cy"]).withColumn("_s", shown).where(F.size("_s") > 0)
        c = c.groupBy("center_id", "_x", "_y").agg(F.sort_array(F.flatten(F.collect_list("_s")), False).alias("_s"))

        def gap(lo, v):
            return F.greatest(v - lo * side, (lo + 1) * side - v)

        def ruled_out(got, g):  # the whole cell lies nearer than min_sep to a pick
            return F.exists(got, lambda b: gap(g["_cx"], b["x"]) * gap(g["_cx"], b["x"]) + gap(g["_cy"], b["y"]) * gap(g["_cy"], b["y"]) < min_sep * min_sep * (1 - 1e-9))

        def beside(got, g):
            return F.exists(got, lambda b: (g["x"] - b["x"]) * (g["x"] - b["x"]) + (g["y"] - b["y"]) * (g["y"] - b["y"]) < min_sep * min_sep)

        def step(acc, g):
            got = acc["got"]
            over = acc["open"] | (F.size(got) >= limit)
            ends = g["bar"] & ~ruled_out(got, g)
            taken = F.concat(got, F.array(F.struct(g["r"].alias("r"), g["i"].alias("i"), g["x"].alias("x"), g["y"].alias("y"))))
            new = F.when(over | g["bar"] | beside(got, g), got).otherwise(taken)
            return F.struct(new.alias("got"), F.when(over, acc["open"]).otherwise(ends).alias("open"))

        start = F.struct(F.array().cast(f"array<{row}>").alias("got"), F.lit(False).alias("open"))
        c = cut(c.select("center_id", "_x", "_y", F.aggregate("_s", start, step).alias("_a")))
        picks = c.where(~F.col("_a.open")).select("center_id", F.explode("_a.got").alias("p"))
        picks = picks.select("center_id", (-F.col("p.i")).alias(point_key), "p.x", "p.y", F.col("p.r").alias("score"))
        out = picks if out is None else out.unionByName(picks)
        todo = c.where("_a.open").select("center_id", "_x", "_y")
        if todo.isEmpty():
            return out
        side, held = side / 2, held * 2
