import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolake.operators import windows
from geolake.session import ROCKSDB
from geolake.sources import catalog, readers, sinks
from geolake.streaming import pings as streams


def test_feature_collection(spark, tmp_path):
    fc = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}},
            {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "MultiLineString", "coordinates": [[[5, 6, 7.5], [7, 8, 9.5]], [[9, 9]]]}},
            {"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}},
        ],
    }
    p = tmp_path / "x.geojson"
    p.write_text(json.dumps(fc))
    v = readers.read_geojson(spark, str(p), "LineString", ["name"]).collect()
    assert sorted((r.name, r.part_id, r.seq, r.lon, r.elev) for r in v if r.name == "b") == [("b", 0, 0, 5.0, 7.5), ("b", 0, 1, 7.0, 9.5)]
    assert len(v) == 4
    pt = readers.read_geojson(spark, str(p), "Point", ["name"]).first()
    assert (pt.name, pt.lon, pt.lat) == ("p", 1.5, 2.5)


def test_csv_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("﻿id,lat\n1,22.5\n2,bad\n".encode())
    df = readers.read_csv(spark, str(p), T.StructType.fromDDL("id long, lat double"))
    assert [(r.id, r.lat) for r in df.orderBy("id").collect()] == [(1, 22.5), (2, None)]


def test_csv_by_header_name(spark, tmp_path):
    p = tmp_path / "y.csv"
    p.write_text("lat,lon,other\n22.5,120.5,x\n")
    r = readers.read_csv(spark, str(p), T.StructType.fromDDL("lon double, lat double")).first()
    assert (r.lon, r.lat) == (120.5, 22.5)
    with pytest.raises(ValueError, match="height"):
        readers.read_csv(spark, str(p), T.StructType.fromDDL("height double"))


def test_features_at_one_place_stay_apart(spark, tmp_path):
    line = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}
    p = tmp_path / "z.geojsonl"
    p.write_text("\n".join(json.dumps(line | {"properties": {"name": n}}) for n in ("a", "b", "b")))
    v = readers.read_geojson(spark, str(p), "LineString", ["name"])
    assert v.select("feature_id").distinct().count() == 3 and v.count() == 6


def test_corridor_document_skips_metadata(spark, tmp_path):
    dep = {"train_id": "T1", "departure_time": "06:30:00", "stations": [{"station_id": "A", "arrival": 0, "departure": 0}, {"station_id": "B", "arrival": 60, "departure": 90}]}
    p = tmp_path / "x.json"
    p.write_text(json.dumps({"N": {"name": "n", "origin": "A", "destination": "B", "departures": [dep]}, "_metadata": {"name": "m", "departures": [dep]}}, indent=1))
    trips, stops = readers.read_corridor_timetable(spark, str(p))
    assert [(r.trip_id, r.dep_sec_of_day) for r in trips.collect()] == [("N/T1", 23400)]
    assert stops.count() == 2


def test_stable_write_and_force(spark, tmp_path):
    df = spark.range(5).withColumn("day", F.lit("d1"))
    assert sinks.write_if_changed(df, str(tmp_path / "s")) and not sinks.write_if_changed(df, str(tmp_path / "s"))
    path = str(tmp_path / "d")
    assert sinks.bake_days(df, "day", path).count() == 1
    more = df.withColumn("id", F.col("id") + 10).unionByName(df.withColumn("day", F.lit("d2")))
    assert [r.day for r in sinks.bake_days(more, "day", path).collect()] == ["d2"]
    assert spark.read.parquet(path).where("day = 'd1'").agg(F.max("id")).first()[0] == 4
    sinks.bake_days(more.where("day = 'd1'"), "day", path, force=True)
    back = spark.read.parquet(path)
    assert back.where("day = 'd1'").agg(F.max("id")).first()[0] == 14 and back.where("day = 'd2'").count() == 5


def test_catalog_and_registry(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"layers": [{"id": "rail", "kind": "line", "label": "Rail", "url": "/r.json", "visible": False, "style": {"width": "2"}}]}))
    c = catalog.Catalog.read(spark, str(p))
    assert c.resolve("rail", "/d") == "/r.json" and c.resolve("none", "/d") == "/d"
    assert catalog.Catalog.read(spark, str(tmp_path / "absent.json")).resolve("rail", "/d") == "/d"
    reg = catalog.LayerRegistry()
    reg.register("n", lambda n: spark.range(n), [lambda d: d.where("id > 1")], {"group": "g", "visible": True})
    assert reg.build("n", 5).count() == 3
    with pytest.raises(ValueError):
        reg.register("n", None)


def test_stream_equals_batch_over_many_triggers(spark, tmp_path):
    from tests.test_trajectories import random_pings

    rnd = random.Random(3)
    rows = random_pings(11, n=90)
    # each report arrives up to six hours late; a last one moves the watermark past all
    late = sorted(rows, key=lambda r: r[2] + rnd.uniform(0, 6 * 3600))
    end = max(r[2] for r in rows) + 10 * 86400
    cols = "entity_id long, ping_id long, t long, lon double, lat double"
    src = tmp_path / "in"
    for part in [late[k : k + 90] for k in range(0, len(late), 90)] + [[(999, 10**9, end, 120.0, 23.0)]]:
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(str(src))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    s = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(src)).withColumn("ts", F.timestamp_seconds("t"))
    got = {r.ping_id for r in streams.run_to_table(streams.clean_stream(s, delay="7 hours"), "t").collect()}
    want = {r.ping_id for r in windows.flag_speed_anomalies(spark.createDataFrame(rows, cols)).where("kept").collect()}
    assert got == want


def test_closed_days_are_stored_once(spark, tmp_path):
    """A batch that comes again, one that was lost half-way, and an empty one."""
    path, kind = str(tmp_path / "stored"), "entity_id long, date_key string"
    batch = lambda *rows: spark.createDataFrame(list(rows), kind)
    put = streams.commit_days(path)
    put(batch((1, "d1"), (2, "d1"), (1, "d2")), 0)
    put(batch((9, "d1")), 0)
    # data without its note: the batch is not there, and comes again
    batch((5, "d3")).selectExpr("*", "1L as batch").write.mode("append").partitionBy("date_key", "batch").parquet(f"{path}/days")
    rows = lambda: sorted((r.entity_id, r.date_key) for r in streams.stored_days(spark, path, kind).collect())
    assert rows() == [(1, "d1"), (1, "d2"), (2, "d1")]
    put(batch((3, "d1"), (5, "d3")), 1)
    put(batch(), 2)
    assert rows() == [(1, "d1"), (1, "d2"), (2, "d1"), (3, "d1"), (5, "d3")]
