"""Ordered operators over trajectories and vertices (W1-W13, S4 shapes)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine_km, haversine_m, in_bbox
from ..functions.shape import clamp
from ..session import cut
from .ordered import SLICE, _cols, group_stats, hot_slices, row_number, running_sum, shift

KM_PER_DEG_LAT = 111.0  # fixed values of the flat-earth metric
KM_PER_DEG_LON = 101.0
KM_PER_NM = 1.852
SEQ_SLICE = 65536
TIME_SLICE = 60
R_M = 6371000.0


def by_seq(df: DataFrame, keys, seq: str = "seq") -> DataFrame:
    """Slice hot lines by vertex index."""
    return hot_slices(df, keys, F.floor(F.col(seq) / SEQ_SLICE) + 1)


def by_time(df: DataFrame, keys, t: str = "t") -> DataFrame:
    """Slice hot trajectories by minute."""
    return hot_slices(df, keys, F.floor(F.col(t) / TIME_SLICE) + 1)


def _dist_km(metric: str, lon1, lat1, lon2, lat2) -> Column:
    if metric == "haversine":
        return haversine_km(lon1, lat1, lon2, lat2)
    dy = (F.col(lat2) - F.col(lat1)) * KM_PER_DEG_LAT
    dx = (F.col(lon2) - F.col(lon1)) * KM_PER_DEG_LON
    return F.hypot(dy, dx)


def ping_speed(pings: DataFrame, metric: str = "haversine") -> DataFrame:
    """Knots since the previous report; 0 without elapsed time, null at the start."""
    p = shift(
        by_time(pings, "entity_id"),
        "entity_id",
        ["t", "ping_id"],
        {"lon0": ("lon", -1), "lat0": ("lat", -1), "t0": ("t", -1)},
    ).drop(SLICE)
    hours = (F.col("t") - F.col("t0")) / 3600.0
    kn = _dist_km(metric, "lon0", "lat0", "lon", "lat") / hours / KM_PER_NM
    knots = F.when(F.col("t0").isNull(), F.lit(None).cast("double")).when(hours <= 0, F.lit(0.0)).otherwise(kn)
    return p.withColumn("knots", knots).drop("lon0", "lat0", "t0")


def _knots_np(metric: str, lon1, lat1, t1, lon2, lat2, t2):
    dt = (np.asarray(t2, dtype="float64") - t1) / 3600.0
    if metric == "haversine":
        a1, a2 = np.radians(lat1), np.radians(lat2)
        h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
        d = 2 * 6371.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
    else:
        d = np.hypot((np.subtract(lat2, lat1)) * KM_PER_DEG_LAT, (np.subtract(lon2, lon1)) * KM_PER_DEG_LON)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(dt <= 0, 0.0, d / np.where(dt == 0, 1.0, dt) / KM_PER_NM)


def _keep_sorted(metric: str, limit: float, pos: np.ndarray, entry: tuple | None) -> np.ndarray:
    """Keep flags of one run of reports (lon, lat, t rows in order). Steps that
    pass against their direct predecessor need no loop; only the stretch after a
    violation is walked until a report passes again."""
    n = len(pos)
    keep = np.ones(n, dtype=bool)
    lon, lat, t = pos[:, 0], pos[:, 1], pos[:, 2]
    fast = np.zeros(n, dtype=bool)
    fast[1:] = _knots_np(metric, lon[:-1], lat[:-1], t[:-1], lon[1:], lat[1:], t[1:]) > limit
    if entry is not None:
        fast[0] = bool(_knots_np(metric, entry[0], entry[1], entry[2], lon[0], lat[0], t[0]) > limit)
    bad = np.flatnonzero(fast)
    i = 0
    for b in bad:
        if b < i:
            continue
        last = pos[b - 1] if b > 0 else np.array(entry)
        j = b
        while j < n:
            hop = min(n, j + 256)
            ok = np.flatnonzero(_knots_np(metric, last[0], last[1], last[2], lon[j:hop], lat[j:hop], t[j:hop]) <= limit)
            if len(ok):
                keep[j : j + ok[0]] = False
                j += ok[0]
                break
            keep[j:hop] = False
            j = hop
        i = j + 1
    return keep


RUN_COLS = ["lon", "lat", "t"]


def _enough(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Kept rows of entities with at least ``least`` of them, from flagged rows sorted by
    entity. An entity's first rows wait until there are enough, ``least`` - 1 at most."""
    waiting, owner, had = None, None, 0
    for pdf in batches:
        rows = pdf[pdf["kept"]].drop(columns="kept")
        if not len(rows):
            continue
        if waiting is not None:
            rows = pd.concat([waiting, rows])
        ids = rows["entity_id"].to_numpy()
        n = rows.groupby("entity_id", sort=False)["entity_id"].transform("size").to_numpy()
        if had:
            n = n + had * (ids == owner)
        fine = n >= least
        held = ~fine & (ids == ids[-1])  # the last entity may go on
        had = int(n[-1]) if fine[-1] else 0
        owner, waiting = ids[-1], rows[held] if held.any() else None
        yield rows[fine]


def _fold(metric: str, limit: float, keys: list[str]):
    """Arrow function over rows sorted by run and time; a run may span batches,
    so its last kept position is carried along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev_key, last = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            kcols = [pdf[c].to_numpy() for c in keys]
            n = len(pdf)
            change = np.zeros(n - 1, dtype=bool)
            for c in kcols:
                change |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1, [n]])
            keep = np.zeros(len(pdf), dtype=bool)
            pos = pdf[RUN_COLS].to_numpy(dtype="float64")
            ent = pdf[["e_lon", "e_lat", "e_t"]].to_numpy(dtype="float64")
            for s, e in zip(starts, starts[1:]):
                key = tuple(c[s] for c in kcols)
                if key != prev_key:
                    last = None if np.isnan(ent[s, 2]) else tuple(ent[s])
                flags = _keep_sorted(metric, limit, pos[s:e], last)
                keep[s:e] = flags
                kept = np.flatnonzero(flags)
                if len(kept):
                    last = tuple(pos[s + kept[-1]])
                prev_key = key
            pdf = pdf.assign(kept=keep)
            yield pdf

    return run


def _fold_frame(rows: DataFrame, metric: str, limit: float) -> DataFrame:
    """Rows with e_lon, e_lat, e_t (state before their run) and ``_run``."""
    keys = ["entity_id", "_run"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return _noted(_in_order(rows).mapInPandas(_fold(metric, limit, keys), ", ".join(fields) + ", kept boolean"), rows)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("entity_id", "_run").sortWithinPartitions("entity_id", "_run", "t", "ping_id")


def _noted(df: DataFrame, like: DataFrame) -> DataFrame:
    """What is known of the entities' sizes, which a Python step forgets; it only drops rows."""
    return df.withMetadata("entity_id", like.schema["entity_id"].metadata)


def flag_speed_anomalies(pings: DataFrame, limit: float = 40.0, metric: str = "haversine") -> DataFrame:
    """Every report with ``kept``: false when its speed from the last kept report
    of the entity exceeds ``limit`` knots. Reports without elapsed time are kept.

    An ordinary entity is one run. A hot entity is cut into slices that are
    folded side by side, each from a guess of the last kept report before it.
    Where the guess proves wrong, a run of slices is folded again from the true
    report; runs grow fourfold per round, so even a day-long outage heals in a
    few rounds. The loop ends when every slice started from the true exit of the
    slices before it: the result is that of the one-by-one filter.
    """
    rows = by_time(pings, "entity_id")
    if SLICE not in rows.columns:
        none = [F.lit(None).cast("double").alias(c) for c in ("e_lon", "e_lat", "e_t")]
        out = _fold_frame(rows.select("*", F.lit(0).cast("long").alias("_run"), *none), metric, limit)
        return out.drop("_run", "e_lon", "e_lat", "e_t")

    # an ordinary entity is one slice here, so any number will do
    rows = rows.withColumn(SLICE, F.coalesce(SLICE, F.lit(0).cast("long")))
    cols, sk = rows.columns, ["entity_id", SLICE]
    order = F.struct("t", "ping_id")
    at = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("t").cast("double").alias("s"))
    w = Window.partitionBy("entity_id").orderBy(SLICE)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def entries(ends: DataFrame) -> DataFrame:
        """State before a slice: the exit of the nearest earlier slice that kept a report."""
        return ends.select(*sk, F.last("exit", ignorenulls=True).over(before).alias("entry"), F.row_number().over(w).alias("k"))

    def fold(plan: DataFrame) -> DataFrame:
        """``plan``: slices to fold with their run and the run's entry."""
        j = rows.join(plan, sk)
        j = j.select(*cols, "_run", F.col("entry.x").alias("e_lon"), F.col("entry.y").alias("e_lat"), F.col("entry.s").alias("e_t"))
        return _fold_frame(j, metric, limit).select(*cols, "kept")

    used = cut(entries(rows.groupBy(*sk).agg(F.max_by(at, order).alias("exit"))).withColumn("settled", F.lit(False)))
    flagged = cut(fold(used.select(*sk, F.col(SLICE).alias("_run"), "entry")))
    reach = 2
    while True:
        exits = flagged.groupBy(*sk).agg(F.max_by(F.when(F.col("kept"), at), F.when(F.col("kept"), order)).alias("exit"))
        now = entries(exits).join(used.select(*sk, F.col("entry").alias("old"), "settled"), sk)
        now = cut(now.withColumn("wrong", ~F.col("settled") & ~F.col("entry").eqNullSafe(F.col("old"))))
        if now.where("wrong").isEmpty():
            return flagged.drop(SLICE)
        start = F.last(F.when(F.col("wrong"), F.struct("k", F.col(SLICE).alias("run"), "entry")), ignorenulls=True).over(w)
        now = now.withColumn("st", start).withColumn("redo", F.coalesce(F.col("k") - F.col("st.k") < reach, F.lit(False)))
        plan = cut(now.where("redo").select(*sk, F.col("st.run").alias("_run"), F.col("st.entry").alias("entry")))
        again = fold(plan)
        flagged = cut(flagged.join(plan.select(*sk), sk, "left_anti").unionByName(again))
        # inside a run the state is handed on by the fold itself
        used = cut(now.select(*sk, "entry", (F.col("redo") & ~F.col("wrong")).alias("settled")))
        reach *= 4


def drop_speed_anomalies(pings: DataFrame, limit: float = 40.0, metric: str = "haversine", min_points: int = 2) -> DataFrame:
    """Kept reports of entities that retain at least ``min_points`` of them. Without hot
    entities they are counted where they are filtered: one scan, one shuffle."""
    rows = by_time(pings, "entity_id")
    if SLICE not in rows.columns:
        cols = rows.columns
        none = [F.lit(None).cast("double").alias(c) for c in ("e_lon", "e_lat", "e_t")]
        rows = rows.select("*", F.lit(0).cast("long").alias("_run"), *none)
        fold = _fold(metric, limit, ["entity_id", "_run"])
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return _noted(_in_order(rows).mapInPandas(lambda batches: _enough(fold(batches), min_points), fields), rows).select(*cols)
    kept = flag_speed_anomalies(pings, limit, metric).where("kept").drop("kept")
    big = kept.groupBy("entity_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_points).select("entity_id")
    return kept.join(big, "entity_id", "left_semi")


def arc_ratio(vertices: DataFrame, key="part_id", metric=None) -> DataFrame:
    """Cumulative length and 0..1 ratio per vertex. ``metric`` is a pair of
    coordinate functions (default: projected metres)."""
    from ..functions.geo import lonlat_to_tm2

    key = _cols(key)
    x, y = (metric or lonlat_to_tm2)("lon", "lat")
    v = by_seq(vertices, key).withColumns({"x": x, "y": y})
    v = shift(v, key, "seq", {"_x0": ("x", -1), "_y0": ("y", -1)})
    step = F.coalesce(F.hypot(F.col("x") - F.col("_x0"), F.col("y") - F.col("_y0")), F.lit(0.0))
    v = running_sum(v.withColumn("_step", step), key, "seq", {"cum_m": "_step"})
    out = group_stats(v, key, {"length_m": F.max("cum_m")})
    ratio = F.when(F.col("length_m") > 0, F.col("cum_m") / F.col("length_m")).otherwise(F.lit(0.0))
    return out.withColumn("ratio", ratio).drop("_x0", "_y0", "_step", SLICE)


def to_segments(vertices: DataFrame, key="part_id", carry=("lon", "lat")) -> DataFrame:
    """Consecutive vertex pairs: carried columns get suffixes 0 and 1."""
    key = _cols(key)
    v = shift(by_seq(vertices, key), key, "seq", {f"{c}1": (c, 1) for c in carry} | {"_seq1": ("seq", 1)})
    out = v.where(F.col("_seq1").isNotNull())
    for c in carry:
        out = out.withColumnRenamed(c, f"{c}0")
    return out.drop("_seq1", SLICE)


def line_length(vertices: DataFrame, key="part_id", planar: bool = False, out: str = "length_m") -> DataFrame:
    """Sum of segment lengths: great-circle metres, or projected metres."""
    from ..functions.geo import lonlat_to_tm2

    key = _cols(key)
    s = to_segments(vertices.select(*key, "seq", "lon", "lat"), key)
    if planar:
        xa, ya = lonlat_to_tm2("lon0", "lat0")
        xb, yb = lonlat_to_tm2("lon1", "lat1")
        d = F.hypot(xb - xa, yb - ya)
    else:
        d = haversine_m("lon0", "lat0", "lon1", "lat1")
    return s.groupBy(*key).agg(F.sum(d).alias(out))


def ring_roll_min(ring_vertices: DataFrame, key, value: str, radius: int = 2, floor: float = -3.0, out: str = "rolled") -> DataFrame:
    """Circular rolling minimum along open rings. The first and last ``radius``
    vertices are repeated beyond the other end; the window then needs no wrap."""
    key = _cols(key)
    v = group_stats(by_seq(ring_vertices, key), key, {"_n": F.count("*")}).drop(SLICE)
    # a ring shorter than the window repeats as often as the window needs
    turns = F.expr(f"transform(sequence(-ceil({radius} / _n), ceil({radius} / _n)), k -> k * _n + seq)")
    padded = v.withColumn("_pos", F.explode(F.filter(turns, lambda p: (p >= -radius) & (p < F.col("_n") + radius))))
    padded = hot_slices(padded, key, F.floor(F.col("_pos") / SEQ_SLICE) + 1)
    if SLICE in padded.columns:
        # offsets beyond one row across slice borders: neighbours by equi-join
        near = padded.select(*key, F.explode(F.sequence(F.col("_pos") - radius, F.col("_pos") + radius)).alias("_pos"), F.col(value).alias("_near"))
        low = near.groupBy(*key, "_pos").agg(F.min("_near").alias("_m"))
        got = padded.where((F.col("_pos") >= 0) & (F.col("_pos") < F.col("_n"))).join(low, [*key, "_pos"])
    else:
        w = Window.partitionBy(*key).orderBy("_pos").rowsBetween(-radius, radius)
        got = padded.withColumn("_m", F.min(value).over(w)).where((F.col("_pos") >= 0) & (F.col("_pos") < F.col("_n")))
    return got.withColumn(out, F.greatest(F.col("_m"), F.lit(floor))).drop("_m", "_pos", "_n", SLICE)


def profile_envelope(profile: DataFrame, key, radius: int, passes: int = 3, value: str = "ground") -> DataFrame:
    """Rolling maximum, then ``passes`` box blurs with shrinking edge windows.
    Profiles have a fixed number of samples per route."""
    w = Window.partitionBy(*_cols(key)).orderBy("seq").rowsBetween(-radius, radius)
    out = profile.withColumn("envelope", F.max(value).over(w)).withColumn("smooth", F.col("envelope"))
    for _ in range(passes):
        out = out.withColumn("smooth", F.avg("smooth").over(w))
    return out


def clip_runs(vertices: DataFrame, bbox, margin: float = 0.0, key="part_id", min_points: int = 2) -> DataFrame:
    """Maximal runs of consecutive vertices inside the box, numbered per line."""
    key = _cols(key)
    v = by_seq(vertices, key).withColumn("_in", in_bbox("lon", "lat", bbox, margin))
    v = shift(v, key, "seq", {"_was": ("_in", -1)})
    starts = (F.col("_in") & ~F.coalesce("_was", F.lit(False))).cast("long")
    v = running_sum(v.withColumn("_start", starts), key, "seq", {"run_id": "_start"}).where("_in")
    v = group_stats(v, [*key, "run_id"], {"run_n": F.count("*")}).where(F.col("run_n") >= min_points)
    return v.drop("_in", "_was", "_start", SLICE)


def top_n(df: DataFrame, part, order, n: int) -> DataFrame:
    """First ``n`` rows per group. The rank filter is applied per input
    partition before the shuffle, so a hot group ships at most n rows per task."""
    w = Window.partitionBy(*_cols(part)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def end_labels(track_stations: DataFrame, near_m: float = 300.0) -> DataFrame:
    """Stations nearest both ends of a part; labelled only when both are close
    and distinct."""
    row = F.struct("station", "dist_m")
    e = track_stations.groupBy("part_id").agg(
        F.min_by(row, F.struct("ratio", "dist_m", "station")).alias("a"),
        F.max_by(row, F.struct("ratio", (-F.col("dist_m")).alias("d"), "station")).alias("b"),
    )
    ok = (F.col("a.dist_m") < near_m) & (F.col("b.dist_m") < near_m) & (F.col("a.station") != F.col("b.station"))
    return e.select(
        "part_id",
        F.col("a.station").alias("first_station"),
        F.col("b.station").alias("last_station"),
        F.when(ok, F.concat("a.station", F.lit("→"), "b.station")).otherwise(F.lit("")).alias("label"),
    )


def sample_vertices(vertices: DataFrame, every: int = 8, cap: int = 40, key="part_id") -> DataFrame:
    """Every ``every``-th vertex and the last one; longer lists are thinned to
    ``cap`` evenly spaced picks (half-even rounding)."""
    key = _cols(key)
    v = group_stats(by_seq(vertices, key), key, {"_last": F.max("seq")}).drop(SLICE).withColumn("_n", F.col("_last") + 1).drop("_last")
    last = F.col("seq") == F.col("_n") - 1
    v = v.where((F.col("seq") % every == 0) | last)
    # k: position in the thinned list; m: its length
    k = F.when(F.col("seq") % every == 0, F.floor(F.col("seq") / every)).otherwise(F.floor(F.col("seq") / every) + 1)
    m = F.floor((F.col("_n") - 1) / every) + 1 + F.when((F.col("_n") - 1) % every != 0, 1).otherwise(0)
    v = v.withColumns({"_k": k.cast("long"), "_m": m.cast("long")})
    # position k is picked when some i has rint(i * (m-1) / (cap-1)) = k
    i0 = F.floor(F.col("_k") * (cap - 1) / F.greatest(F.col("_m") - 1, F.lit(1)))
    hit = F.exists(
        F.sequence(F.greatest(i0 - 1, F.lit(0)), F.least(i0 + 2, F.lit(cap - 1))),
        lambda i: F.rint(i * (F.col("_m") - 1) / float(cap - 1)).cast("long") == F.col("_k"),
    )
    return v.where((F.col("_m") <= cap) | hit).drop("_n", "_k", "_m")


def trip_direction(stops: DataFrame, trips: DataFrame | None = None) -> DataFrame:
    """'first→last' label per trip; a trip without stops uses its published ends."""
    d = stops.groupBy("trip_id").agg(F.min_by("station", "seq").alias("_a"), F.max_by("station", "seq").alias("_b"))
    if trips is None:
        return d.select("trip_id", F.concat("_a", F.lit("→"), "_b").alias("direction"))
    j = trips.join(d, "trip_id", "left")
    return j.withColumn("direction", F.concat(F.coalesce("_a", "origin"), F.lit("→"), F.coalesce("_b", "destination"))).drop("_a", "_b")


def to_legs(stops: DataFrame) -> DataFrame:
    """Adjacent stop pairs."""
    s = hot_slices(stops, "trip_id", F.floor(F.col("seq") / SEQ_SLICE) + 1)
    s = shift(s, "trip_id", "seq", {"to_station": ("station", 1), "to_arr_sec": ("arr_sec", 1)})
    return s.where(F.col("to_station").isNotNull()).withColumnRenamed("station", "from_station").drop(SLICE)


def _axis_stats() -> dict[str, Column]:
    return {
        "_la": F.avg("lat"),
        "_lo": F.avg("lon"),
        "_vx": F.var_pop("lon"),
        "_vy": F.var_pop("lat"),
        "_vxy": F.covar_pop("lon", "lat"),
        "_vn": F.count("*"),
    }


def _axis_columns() -> dict[str, Column]:
    """lat0 and the unit main direction (ux, uy) in local metres, from moments in
    degrees: the local plane only scales them."""
    r = math.radians(1.0) * R_M
    k = F.cos(F.radians("_la"))
    sxx, syy, sxy = (F.col("_vn") * c for c in (F.col("_vx") * k * k * r * r, F.col("_vy") * r * r, F.col("_vxy") * k * r * r))
    tr, det = sxx + syy, sxx * syy - sxy * sxy
    lam = tr / 2 + F.sqrt(F.greatest(F.lit(0.0), tr * tr / 4 - det))
    tilted = F.abs(sxy) > 1e-9
    flat_x = F.when(sxx >= syy, F.lit(1.0)).otherwise(F.lit(0.0))
    vx, vy = F.when(tilted, lam - syy).otherwise(flat_x), F.when(tilted, sxy).otherwise(1.0 - flat_x)
    return {"ux": vx / F.hypot(vx, vy), "uy": vy / F.hypot(vx, vy)}


def main_axis(vertices: DataFrame, key) -> DataFrame:
    """Mean position and unit main direction (ux, uy) of each vertex cloud, by one
    aggregation and the closed-form 2x2 eigenvector."""
    key = _cols(key)
    s = vertices.groupBy(*key).agg(*[a.alias(n) for n, a in _axis_stats().items()]).withColumns(_axis_columns())
    return s.select(*key, F.col("_lo").alias("lon0"), F.col("_la").alias("lat0"), "ux", "uy")


def axis_position(vertices: DataFrame, key) -> DataFrame:
    """Adds ``along``: signed metres along the main direction of the row's key."""
    cols = vertices.columns
    j = group_stats(vertices, key, _axis_stats()).withColumns(_axis_columns())
    r = math.radians(1.0) * R_M
    along = (F.col("lon") - F.col("_lo")) * F.cos(F.radians("_la")) * r * F.col("ux") + (F.col("lat") - F.col("_la")) * r * F.col("uy")
    return j.select(*cols, along.alias("along"))


def anchors(vertices: DataFrame, fracs: list[float], key) -> DataFrame:
    """On-line vertices at fractions of the order along the main direction."""
    key = _cols(key)
    pos = axis_position(by_seq(vertices, key), key).drop(SLICE)
    pos = hot_slices(pos, key, F.floor(F.col("along")) + (1 << 40))
    ranked = group_stats(row_number(pos, key, ["along", "lon", "lat"], "_rn"), key, {"_n": F.count("*")}).drop(SLICE)
    idx = lambda f: clamp(F.floor(F.col("_n") * f), F.lit(0), F.col("_n") - 1) + 1
    hits = F.filter(F.array(*[F.lit(f) for f in fracs]), lambda f: idx(f) == F.col("_rn"))
    return ranked.withColumn("frac", F.explode(hits)).drop("_rn", "_n")
