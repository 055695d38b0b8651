"""Scans: GeoJSON, CSV, timetables, trails, height tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .documents import ANY, read_elements

PAIR = "array<double>"
# geometry type -> (type of the coordinates, depth of the part lists above a vertex list)
COORDS = {
    "Point": (PAIR, 0),
    "LineString": (f"array<{PAIR}>", 1),
    "MultiLineString": (f"array<array<{PAIR}>>", 2),
    "Polygon": (f"array<array<{PAIR}>>", 2),
    "MultiPolygon": (f"array<array<array<{PAIR}>>>", 3),
}


def read_geojson(spark: SparkSession, path: str, geom_type: str, props: list[str]) -> DataFrame:
    """Features of one geometry type as rows: Point gives lon/lat, lines give one
    row per vertex with part_id, polygons add poly_id and ring_id.

    Accepts one FeatureCollection per file or newline-delimited features, of any size:
    a file is read by as many tasks as it has splits. Every feature has an id of its
    own, identical copies included, made of the file's name and the feature's place in
    it (feature_no, its first byte); no split size or folder changes it. Lines with
    fewer than two vertices are dropped.
    """
    want = {"Point": ["Point"], "LineString": ["LineString", "MultiLineString"], "Polygon": ["Polygon", "MultiPolygon"]}[geom_type]
    # coordinates nest differently per type: read as text, parse per type
    feature = T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
            T.StructField(
                "geometry",
                T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]),
            ),
        ]
    )
    found = read_elements(spark, path, None if _is_lines(path) else ("features",))
    feats = found.select("file", "offset", F.from_json("text", feature).alias("f"))
    feats = feats.where(F.col("f.geometry.type").isin(want)).select(
        F.xxhash64("file", "offset").alias("feature_id"),
        F.col("offset").alias("feature_no"),
        *[F.col("f.properties")[p].alias(p) for p in props],
        F.col("f.geometry.type").alias("_gt"),
        F.col("f.geometry.coordinates").alias("_raw"),
    )
    base = ["feature_id", "feature_no", *props]

    def parsed(kind: str) -> Column:
        return F.from_json("_raw", COORDS[kind][0])

    if geom_type == "Point":
        c = parsed("Point")
        return feats.select(*base, c[0].alias("lon"), c[1].alias("lat"))
    if geom_type == "LineString":
        parts = F.when(F.col("_gt") == "LineString", F.array(parsed("LineString"))).otherwise(parsed("MultiLineString"))
        lines = feats.select(*base, F.posexplode(parts).alias("part_id", "_v")).where(F.size("_v") >= 2)
        verts = lines.select(*base, "part_id", F.posexplode("_v").alias("seq", "_p"))
        return verts.select(*base, "part_id", "seq", *_pair())
    polys = F.when(F.col("_gt") == "Polygon", F.array(parsed("Polygon"))).otherwise(parsed("MultiPolygon"))
    rings = feats.select(*base, F.posexplode(polys).alias("poly_id", "_rings"))
    rings = rings.select(*base, "poly_id", F.posexplode("_rings").alias("ring_id", "_v"))
    verts = rings.select(*base, "poly_id", "ring_id", F.posexplode("_v").alias("seq", "_p"))
    return verts.select(*base, "poly_id", "ring_id", "seq", *_pair())


def _pair() -> list[Column]:
    return [
        F.col("_p")[0].alias("lon"),
        F.col("_p")[1].alias("lat"),
        F.get("_p", F.lit(2)).alias("elev"),
    ]


def _is_lines(path: str) -> bool:
    return path.rstrip("/").endswith((".geojsonl", ".ndjson", ".jsonl"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """UTF-8 CSV with a header, columns found by name in any order; a byte-order mark
    in the first header or value is ignored, further columns are left out, and a
    missing one is an error."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.removeprefix("﻿").strip() for c in df.columns])
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the header of {path}")
    return df.select(*[F.regexp_replace(F.col(f"`{f.name}`"), "^﻿", "").try_cast(f.dataType).alias(f.name) for f in schema.fields])


STOP = "struct<station_id:string,arrival:bigint,departure:bigint>"
TRIP = f"struct<train_no:string,train_type:string,origin_station:string,destination_station:string,departure_time:string,stations:array<{STOP}>>"
DEPARTURE = f"struct<train_id:string,departure_time:string,stations:array<{STOP}>>"
TRACK = f"struct<name:string,origin:string,destination:string,departures:array<{DEPARTURE}>>"


def read_timetable(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trips, stops) of {schedules: [...]} documents, each read by many tasks."""
    from ..functions.clock import hms_to_sec

    s = read_elements(spark, path, ("schedules",)).select(F.from_json("text", TRIP).alias("s"))
    trips = s.select(
        F.col("s.train_no").alias("trip_id"),
        F.col("s.train_type").alias("trip_type"),
        F.col("s.origin_station").alias("origin"),
        F.col("s.destination_station").alias("destination"),
        hms_to_sec(F.col("s.departure_time")).alias("dep_sec_of_day"),
    )
    return trips, _stops(s.select(F.col("s.train_no").alias("trip_id"), F.posexplode("s.stations").alias("pos", "st")))


def read_corridor_timetable(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trips, stops) of documents keyed by track; the metadata key is skipped. A
    document of several lines is read by many tasks; what it says beside the
    departures is put together in one row."""
    from ..functions.clock import hms_to_sec

    if _is_lines(path):
        text = spark.read.text(path)
        tracks = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("track_id", "_t"))
        tracks = tracks.select("track_id", F.from_json("_t", TRACK).alias("t"))
        d = tracks.select("track_id", F.col("t.name").alias("track"), F.explode("t.departures").alias("d"))
    else:
        found = read_elements(spark, path, (ANY, "departures"), rest=True)
        names = found.where("offset < 0").select("file", F.explode(F.from_json("text", "map<string,string>")).alias("track_id", "_t"))
        names = names.select("file", "track_id", F.get_json_object("_t", "$.name").alias("track"))
        d = found.where("offset >= 0").select("file", F.get("keys", F.lit(0)).alias("track_id"), F.from_json("text", DEPARTURE).alias("d"))
        d = d.join(names, ["file", "track_id"], "left").select("track_id", "track", "d")
    d = d.where("track_id <> '_metadata'")
    tid = F.concat("track_id", F.lit("/"), "d.train_id")
    trips = d.select(tid.alias("trip_id"), "track_id", "track", hms_to_sec(F.col("d.departure_time")).alias("dep_sec_of_day"))
    return trips, _stops(d.select(tid.alias("trip_id"), F.posexplode("d.stations").alias("pos", "st")))


def _stops(df: DataFrame) -> DataFrame:
    return df.select(
        "trip_id",
        (F.col("pos") + 1).cast("long").alias("seq"),
        F.col("st.station_id").alias("station"),
        F.col("st.arrival").alias("arr_sec"),
        F.col("st.departure").alias("dep_sec"),
    )


def explode_trail(df: DataFrame, col: str) -> DataFrame:
    """'lat,lng,ts;...' to one row per position; empty chunks are skipped."""
    chunks = F.filter(F.split(F.col(col), ";"), lambda x: x != "")
    keep = [c for c in df.columns if c != col]
    rows = df.select(*keep, F.posexplode(chunks).alias("_i", "_s"))
    part = F.split("_s", ",")
    return rows.select(
        *keep,
        (F.col("_i") + 1).cast("long").alias("seq"),
        part[0].cast("double").alias("lat"),
        part[1].cast("double").alias("lon"),
        part[2].cast("long").alias("t"),
    )


def scan_tiles(cells: DataFrame, z: int, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Every pixel of the tiles that cover ``bbox`` at zoom ``z``; pixels without
    data read as sea (0). ``cells`` holds z, tx, ty, px, py, v and should be
    stored partitioned by z and tx so the tile range prunes files."""
    from .tiles import tile_range

    return scan_tile_range(cells, z, tile_range(z, bbox))


def scan_tile_range(cells: DataFrame, z: int, tiles: tuple[int, int, int, int], tile: int = 256) -> DataFrame:
    """:func:`scan_tiles` for the inclusive tile range (tx0, tx1, ty0, ty1)."""
    tx0, tx1, ty0, ty1 = tiles
    have = cells.where((F.col("z") == z) & F.col("tx").between(tx0, tx1) & F.col("ty").between(ty0, ty1))
    span = F.sequence(F.lit(0).cast("long"), F.lit(tile - 1).cast("long"))
    grid = (
        cells.sparkSession.range(tx0, tx1 + 1)
        .select(F.col("id").alias("tx"), F.explode(F.sequence(F.lit(ty0), F.lit(ty1))).alias("ty"))
        .repartition("tx", "ty")
        .select("tx", "ty", F.explode(span).alias("px"))
        .select("*", F.explode(span).alias("py"))
    )
    # stored pixels unpack to many times their files, by which the optimizer would broadcast them
    got = grid.join(have.select("tx", "ty", "px", "py", "v").hint("merge"), ["tx", "ty", "px", "py"], "left")
    return got.withColumn("v", F.coalesce("v", F.lit(0.0)))
