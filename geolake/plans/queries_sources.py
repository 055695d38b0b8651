"""Queries through sources, sinks and streams. Files are written from the given
tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as G
from ..session import ROCKSDB, scratch_path
from ..sources import catalog, readers, sinks
from ..streaming import pings as streams
from .queries_fleet import CLEANED
from .registry import query


def _features(df, geometry, kind, props):
    geo = F.struct(F.lit(kind).alias("type"), geometry.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geo.alias("geometry"))).alias("value"))


def _text(t, df, label, suffix):
    path = scratch_path(t.spark, label) + suffix
    df.write.text(path)
    return path


def _collections(t, features, label):
    """FeatureCollections of some hundred features, several in a file."""
    doc = F.pmod(F.xxhash64("value"), F.lit(max(1, features.count() // 400)))
    many = features.groupBy(doc).agg(F.concat(F.lit('{"type": "FeatureCollection",\n "features": [\n  '), F.array_join(F.collect_list("value"), ",\n  "), F.lit('],\n "crs": {"features": []}}')).alias("value"))
    return _text(t, many.select("value"), label, ".geojson")


POINTS_SQL = "select name, set_id, round(lon, 6) as lon, round(lat, 6) as lat from points"


def _point_features(t):
    return _features(t.points, F.array("lon", "lat"), "Point", ["name", "set_id"])


@query("s1_collection_points", POINTS_SQL)
def _(t):
    p = readers.read_geojson(t.spark, _collections(t, _point_features(t), "points"), "Point", ["name", "set_id"])
    return p.select("name", "set_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("s1_read_geojson_points", POINTS_SQL)
def _(t):
    f = _point_features(t)
    p = readers.read_geojson(t.spark, _text(t, f, "points", ".geojsonl"), "Point", ["name", "set_id"])
    return p.select("name", "set_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


LINES_SQL = """with l as (select s_name as name, s_suppkey % 3 as parts, 120e0 + s_suppkey / 1e3 as x from supplier)
     select name, p as part_id, cast(i as integer) as seq, round(x + p / 1e1 + i / 1e2, 6) as lon, round(22e0 + i / 1e2, 6) as lat from l cross join range(3) a(p) cross join range(4) b(i) where p < greatest(parts, 1)"""


def _line_features(t):
    x = F.lit(120.0) + F.col("s_suppkey") / 1e3
    line = lambda p: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(x + p / 1e1 + i / 1e2, F.lit(22.0) + i / 1e2))
    n = F.greatest(F.col("s_suppkey") % 3, F.lit(1))
    # a part with one vertex is added and must be dropped by the reader
    many = F.concat(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), line), F.array(F.array(F.array(x, F.lit(22.0)))))
    return _features(t.supplier, many, "MultiLineString", [F.col("s_name").alias("name")])


@query("s1_read_geojson_lines", LINES_SQL)
def _(t):
    v = readers.read_geojson(t.spark, _text(t, _line_features(t), "lines", ".geojsonl"), "LineString", ["name"])
    return v.select("name", F.col("part_id").cast("long").alias("part_id"), "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("s1_collection_lines", LINES_SQL)
def _(t):
    v = readers.read_geojson(t.spark, _collections(t, _line_features(t), "lines"), "LineString", ["name"])
    return v.select("name", F.col("part_id").cast("long").alias("part_id"), "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


POLYGONS_SQL = """with r as (select n_name as name, cast(i as integer) as seq, 119.2e0 + n_nationkey / 1e1 as x, 22e0 + n_nationkey / 1e1 as y, i from nation cross join range(5) a(i))
     select name, cast(0 as integer) as poly_id, cast(0 as integer) as ring_id, seq, round(x + case when i in (1, 2) then 0.1e0 else 0e0 end, 6) as lon, round(y + case when i in (2, 3) then 0.1e0 else 0e0 end, 6) as lat from r"""


def _polygon_features(t):
    x, y = F.lit(119.2) + F.col("n_nationkey") / 1e1, F.lit(22.0) + F.col("n_nationkey") / 1e1
    corner = lambda i: F.array(x + F.when(i.isin(1, 2), 0.1).otherwise(0.0), y + F.when(i.isin(2, 3), 0.1).otherwise(0.0))
    ring = F.transform(F.sequence(F.lit(0), F.lit(4)), corner)
    return _features(t.nation, F.array(F.array(ring)), "MultiPolygon", [F.col("n_name").alias("name")])


@query("s1_read_geojson_polygons", POLYGONS_SQL)
def _(t):
    v = readers.read_geojson(t.spark, _text(t, _polygon_features(t), "polygons", ".geojsonl"), "Polygon", ["name"])
    return v.select("name", "poly_id", "ring_id", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("s1_collection_polygons", POLYGONS_SQL)
def _(t):
    v = readers.read_geojson(t.spark, _collections(t, _polygon_features(t), "polygons"), "Polygon", ["name"])
    return v.select("name", "poly_id", "ring_id", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("s2_read_csv", "select c_custkey, c_name, c_acctbal, c_nationkey > 5 as flag from customer")
def _(t):
    path = scratch_path(t.spark, "csv")
    # another order than the schema's, and a column it does not have
    t.customer.selectExpr("c_acctbal as `﻿c_acctbal`", "c_nationkey > 5 as flag", "c_mktsegment", "c_name", "c_custkey").write.option("header", True).csv(path)
    schema = T.StructType.fromDDL("c_custkey long, c_name string, c_acctbal double, flag boolean")
    return readers.read_csv(t.spark, path, schema)


STATIONS = "transform(sequence(0L, 1 + o_orderkey % 3), i -> named_struct('station_id', 'S' || (o_orderkey + i) % 500, 'arrival', i * 600, 'departure', i * 600 + 60))"
TT = """tt as (select cast(o_orderkey as varchar) as trip_id, i + 1 as seq, 'S' || (o_orderkey + i) % 500 as station, i * 600 as arr_sec, i * 600 + 60 as dep_sec from orders cross join range(4) a(i) where i < 2 + o_orderkey % 3)"""


def _hms(c):
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat_ws(":", two(F.col(c) / 3600), two(F.col(c) % 3600 / 60), two(F.col(c) % 60))


TIMETABLE_SQL = f"with {TT} select trip_id, seq, station, arr_sec, dep_sec, (cast(trip_id as bigint) * 97) % 86400 as dep_sec_of_day from tt"


def _schedules(t):
    """Trips as JSON, and the document each belongs to."""
    o = t.orders.withColumn("d", F.expr("(o_orderkey * 97) % 86400"))
    trip = F.struct(
        F.col("o_orderkey").cast("string").alias("train_no"), F.col("o_orderpriority").alias("train_type"), _hms("d").alias("departure_time"), F.expr(STATIONS).alias("stations")
    )
    return o.select(trip.alias("trip"), F.floor(F.col("o_orderkey") / 4000).alias("doc"))


@query("s3_read_timetable", TIMETABLE_SQL)
def _(t):
    path = _text(t, _schedules(t).select(F.to_json(F.struct(F.array("trip").alias("schedules"))).alias("value")), "timetable", ".jsonl")
    trips, stops = readers.read_timetable(t.spark, path)
    return stops.join(trips.select("trip_id", "dep_sec_of_day"), "trip_id")


@query("s3_timetable_document", TIMETABLE_SQL)
def _(t):
    """A thousand trips a document."""
    docs = _schedules(t).groupBy("doc").agg(F.to_json(F.struct(F.lit("v1").alias("version"), F.collect_list("trip").alias("schedules"))).alias("value"))
    trips, stops = readers.read_timetable(t.spark, _text(t, docs.select("value"), "timetable", ".json"))
    return stops.join(trips.select("trip_id", "dep_sec_of_day"), "trip_id")


CORRIDOR_SQL = f"with {TT} select 'N' || cast(trip_id as bigint) % 2 || '/' || trip_id as trip_id, seq, station, arr_sec from tt"


def _departures(t):
    o = t.orders.withColumn("d", F.expr("(o_orderkey * 97) % 86400"))
    dep = F.struct(F.col("o_orderkey").cast("string").alias("train_id"), _hms("d").alias("departure_time"), F.expr(STATIONS).alias("stations"))
    return o.select(dep.alias("dep"), F.concat(F.lit("N"), F.col("o_orderkey") % 2).alias("track"), F.floor(F.col("o_orderkey") / 4000).alias("doc"))


@query("s3_read_corridor_timetable", CORRIDOR_SQL)
def _(t):
    track = F.struct(F.lit("main").alias("name"), F.array("dep").alias("departures"))
    doc = F.map_from_arrays(F.array(F.col("track"), F.lit("_metadata")), F.array(track, F.struct(F.lit("info").alias("name"), F.array("dep").alias("departures"))))
    path = _text(t, _departures(t).select(F.to_json(doc).alias("value")), "corridor", ".jsonl")
    _, stops = readers.read_corridor_timetable(t.spark, path)
    return stops.select("trip_id", "seq", "station", "arr_sec")


@query(
    "s3_corridor_document",
    f"with {TT}, k as (select *, 'N' || cast(trip_id as bigint) % 2 as track_id from tt) select track_id || '/' || trip_id as trip_id, 'line ' || track_id as track, seq, station, arr_sec from k",
)
def _(t):
    """A document of two tracks for each thousand departures, with their names."""
    tracks = _departures(t).groupBy("doc", "track").agg(F.struct(F.concat(F.lit("line "), F.first("track")).alias("name"), F.collect_list("dep").alias("departures")).alias("t"))
    body = F.map_from_arrays(F.concat(F.collect_list("track"), F.array(F.lit("_metadata"))), F.concat(F.collect_list("t"), F.array(F.first("t"))))
    path = scratch_path(t.spark, "corridor")
    tracks.groupBy("doc").agg(F.to_json(body).alias("value")).repartition("doc").write.partitionBy("doc").text(path)
    trips, stops = readers.read_corridor_timetable(t.spark, path)
    return stops.join(trips.select("trip_id", "track"), "trip_id").select("trip_id", "track", "seq", "station", "arr_sec")


@query(
    "s4_explode_trail",
    """with p as (select ping_id, i, lat + i / 1e2 as lat, lon + i / 1e2 as lon, t + i * 60 as t from pings cross join range(3) a(i) where i < 1 + ping_id % 3)
     select ping_id, i + 1 as seq, round(lat, 6) as lat, round(lon, 6) as lon, t from p""",
)
def _(t):
    step = "transform(sequence(0L, ping_id % 3), i -> concat_ws(',', cast(lat + i / 1e2 as string), cast(lon + i / 1e2 as string), cast(t + i * 60 as string)))"
    trails = t.pings.selectExpr("ping_id", f"concat(array_join({step}, ';;'), ';') as trail")
    return readers.explode_trail(trails, "trail").select("ping_id", "seq", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "t")


@query("s5_scan_stored_tiles", "select gx, gy, v from dem where z = 5 and gx // 256 between 26 and 27 and v <> 0")
def _(t):
    path = scratch_path(t.spark, "tiles")
    d = t.dem.selectExpr("z", "cast(floor(gx / 256e0) as bigint) as tx", "cast(floor(gy / 256e0) as bigint) as ty", "gx % 256 as px", "gy % 256 as py", "v")
    d.repartition("z", "tx", "ty").write.partitionBy("z", "tx").parquet(path)
    ty1 = t.dem.where("z = 5").agg(F.max("gy")).first()[0] // 256
    cells = t.spark.read.parquet(path)
    return readers.scan_tile_range(cells, 5, (26, 27, 13, ty1)).selectExpr("tx * 256 + px as gx", "ty * 256 + py as gy", "v").where("v <> 0")


@query("s6_catalog", "select p_brand as id, coalesce(any_value(case when p_brand in (select distinct p_brand from part where p_size > 49) then '/l/' || p_brand end), '/d/' || p_brand) as url from part group by p_brand")
def _(t):
    cat = t.part.where("p_size > 49").select(F.col("p_brand").alias("id"), F.concat(F.lit("/l/"), "p_brand").alias("url")).distinct()
    req = t.part.select(F.col("p_brand").alias("id"), F.concat(F.lit("/d/"), "p_brand").alias("default_url")).distinct()
    return catalog.Catalog(cat).resolve_all(req).select("id", "url")


@query("s9_write_layer", "select count(*) as features, count(distinct set_id) as sets, round(avg(val), 4) as mean_val, (select count(*) from points where set_id = 'BUILDING') as in_set from points")
def _(t):
    path = scratch_path(t.spark, "layer")
    sinks.write_layer(t.points, path, {"features": F.count("*"), "sets": F.count_distinct("set_id"), "mean_val": F.round(F.avg("val"), 4)}, ["set_id"])
    data, meta = sinks.read_layer(t.spark, path)
    return meta.drop("generated").withColumn("in_set", F.lit(data.where("set_id = 'BUILDING'").count()).cast("long"))


@query("s10_write_if_changed", "select true as wrote_first, false as wrote_again, true as wrote_changed, (select count(*) from points where val > 0) as n_rows")
def _(t):
    path = scratch_path(t.spark, "stable")
    a = sinks.write_if_changed(t.points, path)
    b = sinks.write_if_changed(t.points.repartition(5, "lat"), path)
    c = sinks.write_if_changed(t.points.where("val > 0"), path)
    n = sinks.read_current(t.spark, path).agg(F.count("*").alias("n_rows"))
    return n.select(F.lit(a).alias("wrote_first"), F.lit(b).alias("wrote_again"), F.lit(c).alias("wrote_changed"), "n_rows")


DAY = "strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d')"


@query("s11_bake_days", f"select {DAY} as date_key, count(*) as n, case when {DAY} <= '2024-01-10' then 1 else 2 end as pass_no from pings group by 1")
def _(t):
    """Early days first, then everything: stored days keep their first pass."""
    path = scratch_path(t.spark, "days")
    p = t.pings.withColumn("date_key", G.date_key("t"))
    sinks.bake_days(p.where("date_key <= '2024-01-10'").withColumn("pass_no", F.lit(1)), "date_key", path)
    sinks.bake_days(p.withColumn("pass_no", F.lit(2)), "date_key", path)
    back = t.spark.read.schema("ping_id long, pass_no int, date_key string").parquet(path)
    return back.groupBy("date_key").agg(F.count("*").alias("n"), F.min("pass_no").alias("pass_no"))


@query("s12_write_grid", "select 'dem' as grid_id, 13 as zoom, max(gx) + 1 as w, max(gy) + 1 as h, count(*) as n, max(v) as max_v, round(1e2 * count(*) filter (where v <> 0) / count(*), 4) as nonzero_pct, (select count(*) from cells where gx // 16 = 3) as in_column from cells")
def _(t):
    path = scratch_path(t.spark, "grid")
    sinks.write_grid(t.cells, path, "dem", 13, {"eps": "1e-4"}, 16)
    m = t.spark.read.parquet(f"{path}/grid_meta").select("grid_id", "zoom", "w", "h", "n", "max_v", F.round("nonzero_pct", 4).alias("nonzero_pct"))
    return m.withColumn("in_column", F.lit(t.spark.read.parquet(f"{path}/cells").where("tx = 3").count()).cast("long"))


@query(
    "s13_point_sets",
    """with b as (select set_id, feature_id, '#888' as color, true as visible from points where set_id not in ('BUILDING', 'MACHINERY') union all select 'BUILDING', feature_id, '#c00', true from sites)
     select set_id, count(*) as n, min(case when set_id = 'HOUSEHOLD' then '#0c0' else color end) as color, bool_and(set_id <> 'HOUSEHOLD' and visible) as visible from b group by set_id""",
)
def _(t):
    p = t.points.select("set_id", "feature_id", F.lit("#888").alias("color"), F.lit(True).alias("visible"))
    p = sinks.upsert_set(p, "BUILDING", t.sites.select("feature_id"), color="#c00")
    p = sinks.remove_set(p, "MACHINERY")
    return sinks.list_sets(sinks.upsert_set(p, "HOUSEHOLD", color="#0c0", visible=False))


def _stream(t):
    events = t.driver("events")
    s = t.spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    lon = "119.5e0 + ((user_id * 37) % 200) / 1e2 + ((event_id * 13) % 100) / 1e3 as lon"
    lat = "22.0e0 + ((user_id * 53) % 300) / 1e2 + ((event_id * 17) % 100) / 1e3 as lat"
    return s.selectExpr("cast(ts as timestamp) as ts", "event_id as ping_id", "user_id as entity_id", "unix_seconds(cast(ts as timestamp)) as t", lon, lat, "value")


@query("x1_clean_stream", f"with {CLEANED} select ping_id, entity_id from f where kept and t * 1000 <= (select max(epoch_ms(ts)) from events) - 3600000")
def _(t):
    """Reports that the final watermark has passed."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    p = _stream(t).select("ts", "entity_id", "ping_id", "t", "lon", "lat")
    return streams.run_to_table(streams.clean_stream(p), "clean").select("ping_id", "entity_id")


@query("x2_latest_status", "select entity_id, arg_max(value, (t, ping_id)) as pct from (select p.*, e.value from pings p join events e on e.event_id = p.ping_id) q group by entity_id")
def _(t):
    s = streams.latest_status(_stream(t), "entity_id", "value", F.struct("t", "ping_id"))
    out = streams.run_to_table(s, "status", "update")
    return out.groupBy("entity_id").agg(F.max_by("value", "at").alias("pct"))


TRAILS_SQL = f"""with d as (select entity_id, {DAY} as date_key, floor((t + 28800) / 86400) as d, t, ping_id, lon, lat from pings), m as (select max(epoch_us(ts)) / 1e6 - 3600 as wm from events)
     select entity_id, date_key, count(*) as points, min(t) as t_first, max(t) as t_last, string_agg(cast(t as varchar) || ' ' || cast(ping_id as varchar) || ' ' || cast(cast(round(lon * 1000) as bigint) as varchar) || ' ' || cast(cast(round(lat * 1000) as bigint) as varchar), ';' order by t, ping_id) as trail from d cross join m where (d + 1) * 86400 - 28800 <= wm group by entity_id, date_key"""


def _trail_text(df):
    text = F.transform("trail", lambda p: F.concat_ws(" ", p["t"], p["ping_id"], F.round(p["lon"] * 1000).cast("long"), F.round(p["lat"] * 1000).cast("long")))
    return df.withColumn("trail", F.array_join(text, ";"))


@query("x3_day_trails", TRAILS_SQL)
def _(t):
    return _trail_text(streams.run_to_table(streams.day_trails(_stream(t)), "trails"))


@query("x3_baked_days", TRAILS_SQL)
def _(t):
    """Trails stored by a stream; the stream then starts again from the first batch."""
    path, trails = scratch_path(t.spark, "stored"), streams.day_trails(_stream(t))
    for run in ("first", "again"):
        streams.bake_stream(trails, path, scratch_path(t.spark, run))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trails.schema.fields)
    return _trail_text(streams.stored_days(t.spark, path, schema))
