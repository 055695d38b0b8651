"""Lines and rings: metrics, simplification, clipping, grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine_m, lonlat_to_tm2
from ..functions.shape import clamp, ring_tolerance
from ..session import cut
from .ordered import SLICE, _cols, group_stats, know_layout, running_sum, shift
from .windows import arc_ratio, axis_position, by_seq, to_segments

R_M = 6371000.0


# ---------------------------------------------------------------- ring metrics
def ring_edges(ring_vertices: DataFrame, key, carry=("lon", "lat"), stats: dict[str, Column] | None = None) -> DataFrame:
    """Edges of open or closed rings, the closing edge included. Carried columns
    get suffixes 0 and 1; a repeated last vertex gives one edge of length 0.
    ``stats`` adds per-ring aggregates to every edge."""
    key = _cols(key)
    v = by_seq(ring_vertices.select(*key, "seq", *carry), key)
    sliced = SLICE in v.columns
    if sliced:
        first = {"_f": F.min_by(F.struct(*carry), "seq")}
        v = group_stats(v, key, first | (stats or {}))
    else:
        w = Window.partitionBy(*key).orderBy("seq")
        v = v.withColumn("_f", F.first(F.struct(*carry)).over(w))
        v = group_stats(v, key, stats or {})
    v = shift(v, key, "seq", {f"_nx_{c}": (c, 1) for c in carry} | {"_nx": ("seq", 1)})
    last = F.col("_nx").isNull()
    return v.select(
        *key,
        "seq",
        *[F.col(c).alias(f"{c}0") for c in carry],
        *[F.when(last, F.col(f"_f.{c}")).otherwise(F.col(f"_nx_{c}")).alias(f"{c}1") for c in carry],
        *(stats or {}),
    )


def _local(c: str, o: str, scale: Column | None = None) -> Column:
    m = F.radians(F.col(c) - F.col(o)) * R_M
    return m if scale is None else m * scale


def ring_metrics(ring_vertices: DataFrame, key, planar: bool = False) -> DataFrame:
    """signed_m2, area_m2, perimeter_m and mean width per ring. Coordinates are
    taken relative to the ring's own corner, which leaves the area unchanged and
    keeps its digits."""
    key = _cols(key)
    if planar:
        x, y = lonlat_to_tm2("lon", "lat")
        v = ring_vertices.withColumns({"_x": x, "_y": y})
        e = ring_edges(v, key, ("_x", "_y"), {"_ox": F.min("_x"), "_oy": F.min("_y")})
        x0, y0, x1, y1 = (F.col(a) - F.col(b) for a, b in (("_x0", "_ox"), ("_y0", "_oy"), ("_x1", "_ox"), ("_y1", "_oy")))
        length = F.hypot(x1 - x0, y1 - y0)
    else:
        e = ring_edges(ring_vertices, key, ("lon", "lat"), {"_ox": F.min("lon"), "_oy": F.min("lat"), "_k": F.avg("lat")})
        k = F.cos(F.radians("_k"))
        x0, y0, x1, y1 = _local("lon0", "_ox", k), _local("lat0", "_oy"), _local("lon1", "_ox", k), _local("lat1", "_oy")
        length = haversine_m("lon0", "lat0", "lon1", "lat1")
    m = e.groupBy(*key).agg((F.sum(x0 * y1 - x1 * y0) / 2).alias("signed_m2"), F.sum(length).alias("perimeter_m"))
    area = F.abs("signed_m2")
    width = F.when(F.col("perimeter_m") > 0, 2 * area / F.col("perimeter_m")).otherwise(F.lit(0.0))
    return m.withColumns({"area_m2": area, "width_m": width})


def largest_ring(ring_vertices: DataFrame, feature: str, ring) -> DataFrame:
    """Vertices of the largest ring per feature; the first ring wins ties."""
    key = [feature, *_cols(ring)]
    m = ring_metrics(ring_vertices, key)
    rank = F.struct((-F.col("area_m2")).alias("a"), *_cols(ring))
    best = m.groupBy(feature).agg(F.min_by(F.struct(*_cols(ring), "area_m2"), rank).alias("_b")).select(feature, "_b.*")
    return ring_vertices.join(best, key)


def plane_areas(ring_vertices: DataFrame, key, x: str = "x", y: str = "y") -> DataFrame:
    """Signed area per ring in its own plane."""
    e = ring_edges(ring_vertices, key, (x, y))
    return e.groupBy(*_cols(key)).agg((F.sum(F.col(f"{x}0") * F.col(f"{y}1") - F.col(f"{x}1") * F.col(f"{y}0")) / 2).alias("signed"))


def group_rings(areas: DataFrame, feature: str = "feature_id", ring: str = "ring_id") -> DataFrame:
    """Flat ring list to polygons: a ring turning like the feature's first ring
    opens a polygon, one turning the other way is a hole of the current one.
    Rings of zero area are skipped."""
    r = areas.where(F.col("signed") != 0)
    lead = r.groupBy(feature).agg(F.min_by(F.signum("signed"), ring).alias("_sign"))
    r = r.join(lead, feature).withColumn("is_exterior", F.signum("signed") == F.col("_sign"))
    r = running_sum(by_seq(r, feature, ring), feature, ring, {"poly_id": F.col("is_exterior").cast("long")})
    return r.drop("_sign", SLICE)


def polygon_area(areas: DataFrame, feature: str = "feature_id", ring: str = "ring_id") -> DataFrame:
    """Exterior minus holes per feature."""
    g = group_rings(areas, feature, ring)
    a = F.abs("signed")
    return g.groupBy(feature).agg(
        F.sum(F.when(F.col("is_exterior"), a).otherwise(-a)).alias("net_area"), F.max("poly_id").alias("polygons")
    )


# --------------------------------------------------------------- simplification
def _importance_np(x: np.ndarray, y: np.ndarray, floor: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Split distance of each vertex, capped by the splits above it, for lines one
    after another that begin at ``starts``. A vertex survives a tolerance exactly when
    this value exceeds it. Segments whose largest distance is not above ``floor`` (a
    value per vertex) are left unexplored (value 0). All segments of a level are
    split together: short lines cost no step of their own."""
    imp = np.zeros(len(x))
    s, e = starts, np.append(starts[1:], len(x)) - 1
    imp[s] = imp[e] = np.inf
    cap = np.full(len(s), np.inf)
    while True:
        more = e - s >= 2
        s, e, cap = s[more], e[more], cap[more]
        if not len(s):
            return imp
        size = e - s - 1
        first = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(s)), size)
        at = np.arange(len(seg)) + (s + 1 - first)[seg]
        px, py, x0, y0 = x[at], y[at], x[s][seg], y[s][seg]
        dx, dy = x[e] - x[s], y[e] - y[s]
        len2 = dx * dx + dy * dy
        dx, dy, len2 = dx[seg], dy[seg], np.where(len2 == 0, 1.0, len2)[seg]
        t = np.clip(((px - x0) * dx + (py - y0) * dy) / len2, 0.0, 1.0)
        ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
        d = np.sqrt(ex * ex + ey * ey)
        far = np.maximum.reduceat(d, first)
        hit = np.flatnonzero((d == far[seg]) & (far > floor[s])[seg])
        if not len(hit):
            return imp
        hit = hit[np.append(True, np.diff(seg[hit]) > 0)]  # the first maximum of each
        g, m = seg[hit], at[hit]
        cap = np.minimum(cap[g], far[g])
        imp[m] = cap
        s, e, cap = np.append(s[g], m), np.append(m, e[g]), np.append(cap, cap)


def _lines_np(keys: list[str]):
    """Arrow function over rows sorted by line and vertex; whole lines are handed
    to the numpy pass, many at once, however the batches fall."""

    def changes(pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf) - 1, dtype=bool)
        for c in keys:
            k = pdf[c].to_numpy()
            change |= k[1:] != k[:-1]
        return np.flatnonzero(change) + 1

    def flush(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        starts = np.append(0, changes(pdf))
        return pdf.assign(importance=_importance_np(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), pdf["_tol"].to_numpy(), starts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last line, which may go on
        for pdf in batches:
            if not len(pdf):
                continue
            goes_on = bool(held) and not any(held[-1][c].iloc[-1] != pdf[c].iloc[0] for c in keys)
            at = changes(pdf)
            if goes_on and not len(at):
                held.append(pdf)
                continue
            last = int(at[-1]) if len(at) else 0
            done = held + ([pdf.iloc[:last]] if last else [])
            if done:
                yield flush(done)
            held = [pdf.iloc[last:]]
        if held:
            yield flush(held)

    return run


def _importance_rounds(v: DataFrame, key: list[str]) -> DataFrame:
    """The same values for very long lines, one round per split level. Every
    open vertex carries its segment's ends; a round is one aggregation and one
    join, and no line is ever held by one task."""
    ends = v.groupBy(*key).agg(
        F.min_by(F.struct("seq", "_x", "_y"), "seq").alias("_a"), F.max_by(F.struct("seq", "_x", "_y"), "seq").alias("_b")
    )
    j = v.join(ends, key).withColumn("_cap", F.lit(float("inf")))
    edge = (F.col("seq") == F.col("_a.seq")) | (F.col("seq") == F.col("_b.seq"))
    base = list(v.columns)
    result = cut(j.where(edge).select(*base, F.lit(float("inf")).alias("importance")))
    open_ = cut(j.where(~edge))
    while not open_.isEmpty():
        dx, dy = F.col("_b._x") - F.col("_a._x"), F.col("_b._y") - F.col("_a._y")
        len2 = dx * dx + dy * dy
        px, py = F.col("_x") - F.col("_a._x"), F.col("_y") - F.col("_a._y")
        t = F.when(len2 == 0, F.lit(0.0)).otherwise(clamp((px * dx + py * dy) / F.nullif(len2, F.lit(0.0)), 0.0, 1.0))
        ex, ey = F.col("_x") - (F.col("_a._x") + t * dx), F.col("_y") - (F.col("_a._y") + t * dy)
        d = open_.withColumn("_d", F.sqrt(ex * ex + ey * ey)).withColumn("_s", F.col("_a.seq"))
        far = d.groupBy(*key, "_s").agg(
            F.max_by(F.struct("seq", "_x", "_y", "_d", "_tol"), F.struct("_d", (-F.col("seq")).alias("q"))).alias("_m")
        )
        far = far.where(F.col("_m._d") > F.col("_m._tol"))
        hit = cut(d.join(far, [*key, "_s"]).withColumn("_cap", F.least("_cap", "_m._d")))
        kept = hit.where(F.col("seq") == F.col("_m.seq")).select(*base, F.col("_cap").alias("importance"))
        result = cut(result.unionByName(kept))
        mid = F.struct(F.col("_m.seq").alias("seq"), F.col("_m._x").alias("_x"), F.col("_m._y").alias("_y"))
        left = F.col("seq") < F.col("_m.seq")
        open_ = cut(
            hit.where(F.col("seq") != F.col("_m.seq"))
            .withColumns({"_a2": F.when(left, F.col("_a")).otherwise(mid), "_b2": F.when(left, mid).otherwise(F.col("_b"))})
            .select(*base, F.col("_a2").alias("_a"), F.col("_b2").alias("_b"), "_cap")
        )
    return result


def importance(vertices: DataFrame, key="part_id", tol: Column | float = 0.0, xy: tuple = ("lon", "lat"), long_line: int = 200_000) -> DataFrame:
    """Douglas-Peucker split distance per vertex (``importance``); values not
    above ``tol`` are omitted. Ends get infinity. The first maximum splits."""
    key = _cols(key)
    t = tol if isinstance(tol, Column) else F.lit(float(tol))
    c = [F.col(q) if isinstance(q, str) else q for q in xy]
    v = vertices.withColumns({"_x": c[0].cast("double"), "_y": c[1].cast("double"), "_tol": t.cast("double")})
    cols = list(v.columns)
    size = v.groupBy(*key).agg(F.count("*").alias("_n"))
    long_keys = size.where(F.col("_n") > long_line).select(*key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.schema.fields) + ", importance double"
    if long_keys.isEmpty():
        short, rounds = v, None
    else:
        short = v.join(long_keys, key, "left_anti").select(*cols)
        rounds = _importance_rounds(v.join(long_keys, key, "left_semi").select(*cols), key)
    out = short.repartition(*key).sortWithinPartitions(*key, "seq").mapInPandas(_lines_np(key), fields)
    out = out.where(F.col("importance") > F.col("_tol"))
    if rounds is not None:
        out = out.unionByName(rounds)
    return out.drop("_x", "_y", "_tol")


def simplify(vertices: DataFrame, tol: Column | float, key="part_id", xy: tuple = ("lon", "lat"), **kw) -> DataFrame:
    """Kept vertices; ``tol`` may be a column that is constant per line."""
    return importance(vertices, key, tol, xy, **kw).drop("importance")


def simplify_scaled(ring_vertices: DataFrame, cap: float, floor: float, frac: float, key, min_vertices: int = 5, **kw) -> DataFrame:
    """Simplification in projected metres with a tolerance scaled to the
    diagonal of each ring; tiny rings stay as they are."""
    key = _cols(key)
    x, y = lonlat_to_tm2("lon", "lat")
    v = ring_vertices.withColumns({"_mx": x, "_my": y})
    diag = F.hypot(F.max("_mx") - F.min("_mx"), F.max("_my") - F.min("_my"))
    t = v.groupBy(*key).agg(diag.alias("_diag"), F.count("*").alias("_n"))
    t = t.select(*key, F.when(F.col("_n") < min_vertices, F.lit(-1.0)).otherwise(ring_tolerance("_diag", frac, floor, cap)).alias("_t"))
    out = importance(v.join(t, key), key, F.col("_t"), (F.col("_mx"), F.col("_my")), **kw)
    # with the negative tolerance of a tiny ring every vertex has importance >= 0
    return out.drop("importance", "_mx", "_my", "_t")


def budget_tolerances(start: float = 1e-4, growth: float = 1.8, cap: float = 0.02) -> list[float]:
    out = [start]
    while out[-1] < cap:
        out.append(out[-1] * growth)
    return out


def simplify_to_budget(pings: DataFrame, budget: int, group: str, key, tolerances: list[float] | None = None, **kw):
    """(kept rows, report). Smallest tolerance per group whose payload fits the
    byte budget, else the last one. One pass gives every vertex the largest
    tolerance it survives, so all tolerances are sized by one aggregation."""
    tol = tolerances or budget_tolerances()
    imp = importance(pings, [group, *_cols(key)], tol[0], **kw)
    level = F.size(F.filter(F.array(*[F.lit(x) for x in tol]), lambda x: x < F.col("importance")))
    text = F.concat_ws(",", F.round("lat", 6).cast("string"), F.round("lon", 6).cast("string"), F.col("t").cast("string"))
    imp = cut(imp.withColumns({"_level": level, "_bytes": F.length(text) + 3}))  # used for the sizes, the report and the rows
    sizes = imp.groupBy(group, "_level").agg(F.sum("_bytes").alias("_b"), F.count("*").alias("_c"))
    # level L survives tolerances 0..L-1
    per = sizes.select(group, F.explode(F.sequence(F.lit(0), F.col("_level") - 1)).alias("k"), "_b", "_c")
    per = per.groupBy(group, "k").agg(F.sum("_b").alias("bytes"), F.sum("_c").alias("points"))
    row = F.struct("k", "bytes", "points")
    fits = F.min_by(row, F.when(F.col("bytes") <= budget, F.col("k")))
    pick = per.groupBy(group).agg(F.coalesce(fits, F.max_by(row, "k")).alias("_p")).select(group, "_p.*")
    pick = pick.withColumn("tol", F.element_at(F.array(*[F.lit(x) for x in tol]), F.col("k") + 1))
    kept = imp.join(pick.select(group, "k"), group).where(F.col("_level") > F.col("k")).drop("_level", "_bytes", "importance", "k")
    return kept, pick


# --------------------------------------------------------------------- clipping
def _slab_emit(edges: DataFrame, keep: list[str]) -> DataFrame:
    """Vertices of the rings clipped to ``lo <= t <= hi``. An edge contributes its
    inside start and its crossings with the two borders, in edge direction; that
    is what clipping one border after the other yields."""
    t0, t1, lo, hi = (F.col(c) for c in ("t0", "t1", "lo", "hi"))

    def cross(b):
        hit = ((t0 < b) != (t1 < b)) if b is lo else ((t0 <= b) != (t1 <= b))
        a = (b - t0) / F.nullif(t1 - t0, F.lit(0.0))
        pt = F.struct(
            (F.col("lon0") + a * (F.col("lon1") - F.col("lon0"))).alias("lon"),
            (F.col("lat0") + a * (F.col("lat1") - F.col("lat0"))).alias("lat"),
            a.alias("a"),
        )
        return F.when(hit, pt)

    start = F.when((t0 >= lo) & (t0 <= hi), F.struct(F.col("lon0").alias("lon"), F.col("lat0").alias("lat"), F.lit(-1.0).alias("a")))
    pts = F.array_sort(
        F.transform(
            F.filter(F.array(start, cross(lo), cross(hi)), lambda p: p.isNotNull()),
            lambda p: F.struct(p["a"].alias("a"), p["lon"].alias("lon"), p["lat"].alias("lat")),
        )
    )
    return edges.select(*keep, "seq", F.posexplode(pts).alias("_i", "_p")).select(
        *keep, (F.col("seq") * 3 + F.col("_i")).cast("long").alias("seq"), F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat")
    )


def clip_slab(ring_vertices: DataFrame, t: Column, lo: float, hi: float, key) -> DataFrame:
    """Open rings clipped to a slab of ``t`` (linear in lon and lat)."""
    key = _cols(key)
    e = ring_edges(ring_vertices.withColumn("t", t), key, ("lon", "lat", "t"))
    return _slab_emit(e.withColumns({"lo": F.lit(lo), "hi": F.lit(hi)}), key)


def slice_reaches(ring_vertices: DataFrame, key, length_m: float = 900.0, min_area_m2: float = 500.0) -> DataFrame:
    """Long open rings cut across their main direction into equal slabs of about
    ``length_m``; ``slice_id`` -1 marks rings left whole. An edge only meets the
    slabs it spans."""
    key = _cols(key)
    ring_vertices = know_layout(ring_vertices, key)
    v = axis_position(by_seq(ring_vertices, key), key).withColumn("t", F.col("along")).drop(SLICE)
    e = ring_edges(v, key, ("lon", "lat", "t"), {"_t0": F.min("t"), "_t1": F.max("t")})
    n = F.greatest(F.lit(1), F.rint((F.col("_t1") - F.col("_t0")) / length_m)).cast("long")
    e = e.withColumn("_n", n).withColumn("_step", (F.col("_t1") - F.col("_t0")) / F.col("_n")).where("_n > 1")
    at = lambda q: F.floor((q - F.col("_t0")) / F.col("_step"))
    a = F.greatest(at(F.least("t0", "t1")) - 1, F.lit(0))
    b = F.least(at(F.greatest("t0", "t1")) + 1, F.col("_n") - 1)
    e = e.withColumn("slice_id", F.explode(F.sequence(a, b)))
    last = F.col("slice_id") == F.col("_n") - 1
    lo = F.col("_t0") + F.col("_step") * F.col("slice_id") - 1e-6
    hi = F.col("_t0") + F.col("_step") * (F.col("slice_id") + 1) + F.when(last, 1e-6).otherwise(0.0)
    piece = [*key, "slice_id"]
    pieces = _slab_emit(e.withColumns({"lo": lo, "hi": hi}), piece)
    m = _closed_area(pieces, piece).where((F.col("_np") >= 3) & (F.col("area_m2") > min_area_m2))
    pieces = pieces.join(m.select(*piece, "area_m2"), piece)
    whole = ring_vertices.join(m.select(*key).distinct(), key, "left_anti")
    whole = whole.join(_closed_area(whole, key).select(*key, "area_m2"), key)
    whole = whole.withColumn("slice_id", F.lit(-1).cast("long"))
    cols = [*piece, "seq", "lon", "lat", "area_m2"]
    return pieces.select(*cols).unionByName(whole.select(*cols))


def _closed_area(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Area of open rings in local metres at the mean latitude of the closed ring."""
    stats = {"_np": F.count("*"), "_sl": F.sum("lat"), "_l0": F.min_by("lat", "seq"), "_ox": F.min("lon"), "_oy": F.min("lat")}
    e = ring_edges(pieces, key, ("lon", "lat"), stats)
    k = F.cos(F.radians((F.col("_sl") + F.col("_l0")) / (F.col("_np") + 1)))
    x0, y0, x1, y1 = _local("lon0", "_ox", k), _local("lat0", "_oy"), _local("lon1", "_ox", k), _local("lat1", "_oy")
    return e.groupBy(*key).agg(F.max("_np").alias("_np"), F.abs(F.sum(x0 * y1 - x1 * y0) / 2).alias("area_m2"))


def open_rings(ring_vertices: DataFrame, key) -> DataFrame:
    """Drop the repeated last vertex of closed rings, row by row."""
    key = _cols(key)
    pos = F.struct("lon", "lat")
    e = group_stats(
        by_seq(ring_vertices, key),
        key,
        {"_a": F.min_by(pos, "seq"), "_b": F.max_by(pos, "seq"), "_last": F.max("seq"), "_n": F.count("*")},
    )
    again = (F.col("_n") >= 2) & (F.col("_a") == F.col("_b")) & (F.col("seq") == F.col("_last"))
    return e.where(~again).drop("_a", "_b", "_last", "_n", SLICE)


def keep_holes(hole_vertices: DataFrame, min_m2: float, tol: float, key, **kw) -> DataFrame:
    """Open hole rings of at least ``min_m2``, simplified; rings left with fewer
    than three vertices are dropped."""
    key = _cols(key)
    v = open_rings(know_layout(hole_vertices, key), key)
    m = _closed_area(v, key).where((F.col("_np") >= 3) & (F.col("area_m2") >= min_m2)).select(*key)
    s = simplify(v.join(m, key, "left_semi"), tol, key, **kw)
    n = s.groupBy(*key).agg(F.count("*").alias("_c")).where("_c >= 3").select(*key)
    return s.join(n, key, "left_semi")


# ------------------------------------------------------------- linear referencing
def point_at(ratios: DataFrame, vertices: DataFrame, key="part_id") -> DataFrame:
    """Position at ``ratio`` (clamped) along each line; rows of ``ratios`` without
    a line are dropped. ``vertices`` may already carry ratio and length_m."""
    key = _cols(key)
    v = vertices if "ratio" in vertices.columns else arc_ratio(vertices, key)
    carry = [c for c in ("lon", "lat", "elev") if c in v.columns]
    s = to_segments(v.select(*key, "seq", F.col("ratio").alias("_r"), "length_m", *carry), key, ("_r", *carry))
    # segments of one line share a bucket of ratio, so a query meets few of them
    buckets = 64
    b = lambda c: F.least(F.floor(c * buckets), F.lit(buckets - 1)).cast("long")
    s = s.where(F.col("_r1") > F.col("_r0")).withColumn("_b", F.explode(F.sequence(b(F.col("_r0")), b(F.col("_r1")))))
    q = ratios.withColumn("_q", clamp("ratio", 0.0, 1.0))
    q = q.withColumn("_b", b(F.col("_q")))
    last = (F.col("_r1") >= 1.0) & (F.col("_q") >= 1.0)
    # sizes are guessed from the lines' files, of which one row makes many segments,
    # so the optimizer would send all of them to the driver; in order both sides spill
    j = q.join(s.hint("merge"), [*key, "_b"]).where(((F.col("_q") >= F.col("_r0")) & (F.col("_q") < F.col("_r1"))) | last)
    t = (F.col("_q") - F.col("_r0")) / (F.col("_r1") - F.col("_r0"))
    keep = [c for c in ratios.columns]
    return j.select(*keep, "length_m", *[(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * t).alias(c) for c in carry])
