import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolake.operators import fleet, ordered, windows
from geolake.operators.ordered import hot_slices, nth_values, running_sum, shift


def pings(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, ping_id long, t long, lon double, lat double")


def random_pings(seed, n=300, entities=3):
    rnd = random.Random(seed)
    rows = []
    for e in range(entities):
        t = 1_700_000_000
        lon, lat = 120.0, 23.0
        for i in range(n):
            t += rnd.choice([0, 60, 600, 1200])
            lon += rnd.uniform(-0.01, 0.01)
            lat += rnd.uniform(-0.01, 0.01)
            jump = rnd.random() < 0.15
            rows.append((e, e * n + i, t, lon + (2.0 if jump else 0.0), lat))
    return rows


def knots(a, b):
    dt = (b[2] - a[2]) / 3600
    if dt <= 0:
        return 0.0
    p1, p2 = math.radians(a[4]), math.radians(b[4])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) / dt / 1.852


def brute_clean(rows, limit=40.0):
    kept = []
    for e in sorted({r[0] for r in rows}):
        last = None
        for r in sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[1])):
            if last is None or knots((None, None, last[2], last[3], last[4]), (None, None, r[2], r[3], r[4])) <= limit:
                kept.append(r[1])
                last = r
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_clean_matches_one_by_one(spark, seed):
    rows = random_pings(seed)
    got = windows.flag_speed_anomalies(pings(spark, rows)).where("kept").select("ping_id")
    assert sorted(r[0] for r in got.collect()) == brute_clean(rows)


def test_clean_of_hot_entities(spark, tiny_limits):
    rows = random_pings(3, n=120)
    got = windows.flag_speed_anomalies(pings(spark, rows)).where("kept").select("ping_id")
    assert sorted(r[0] for r in got.collect()) == brute_clean(rows)


def test_clean_long_outage_across_slices(spark, tiny_limits):
    # everything after the first report is far away for an hour: the guess of
    # every slice is wrong and must be healed
    rows = [(1, 0, 1_700_000_000, 120.0, 23.0)] + [(1, i, 1_700_000_000 + 60 * i, 123.0, 23.0) for i in range(1, 60)]
    got = windows.flag_speed_anomalies(pings(spark, rows)).where("kept").select("ping_id")
    assert sorted(r[0] for r in got.collect()) == brute_clean(rows)


def test_entities_with_one_point_left_are_dropped(spark):
    rows = [(1, 1, 0, 120.0, 23.0), (1, 2, 60, 130.0, 23.0), (2, 3, 0, 120.0, 23.0), (2, 4, 600, 120.0, 23.0)]
    got = windows.drop_speed_anomalies(pings(spark, rows)).select("ping_id").collect()
    assert sorted(r[0] for r in got) == [3, 4]


@pytest.mark.parametrize("hot", [False, True])
def test_shift_and_running_sum(spark, hot, monkeypatch):
    ordered._hot_memo.clear()
    monkeypatch.setattr(ordered, "ROW_LIMIT", 5 if hot else 10**6)
    rows = [(k, i, float(i * i % 7)) for k in (1, 2) for i in range(40 if k == 1 else 3)]
    df = spark.createDataFrame(rows, "k long, seq long, v double")
    df = hot_slices(df, "k", F.floor(F.col("seq") / 4) + 1)
    assert ("_slice" in df.columns) == hot
    got = shift(df, "k", "seq", {"p": ("v", -1), "n": ("v", 1)})
    got = running_sum(got, "k", "seq", {"s": "v"}).collect()
    by = {(r.k, r.seq): r for r in got}
    for k in (1, 2):
        vs = [v for kk, _, v in rows if kk == k]
        for i, v in enumerate(vs):
            r = by[(k, i)]
            assert r.p == (vs[i - 1] if i else None)
            assert r.n == (vs[i + 1] if i + 1 < len(vs) else None)
            assert r.s == sum(vs[: i + 1])


def test_nth_values(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice([1.0, 2.5, 2.5, 7.25, 900.0, -3.0])) for k in range(3) for _ in range(50)]
    df = spark.createDataFrame(rows, "k long, v double")
    ranks = spark.createDataFrame([(k, r) for k in range(3) for r in (0, 7, 24, 49)], "k long, rank long")
    for r in nth_values(df, "k", "v", ranks).collect():
        assert r.v == sorted(v for k, v in rows if k == r.k)[r["rank"]]


def test_positions_outside_trail_are_absent(spark):
    p = pings(spark, [(1, 1, 100, 0.0, 0.0), (1, 2, 200, 10.0, 20.0), (2, 3, 150, 5.0, 5.0)])
    at = spark.createDataFrame([(50,), (100,), (150,), (200,), (250,)], "t long")
    got = sorted((r.entity_id, r.t, r.lon, r.lat) for r in fleet.positions_at(p, at, bucket=7).collect())
    assert got == [(1, 100, 0.0, 0.0), (1, 150, 5.0, 10.0), (1, 200, 10.0, 20.0), (2, 150, 5.0, 5.0)]


def test_trip_crossing_midnight(spark):
    trips = spark.createDataFrame([(1, 86000)], "trip_id long, dep_sec_of_day long")
    stops = spark.createDataFrame([(1, 1, "A", 0, 0), (1, 2, "B", 600, 660), (1, 3, "C", 1200, 1200)], "trip_id long, seq long, station string, arr_sec long, dep_sec long")
    ts = spark.createDataFrame([("A", 0, 0.0), ("B", 0, 0.5), ("C", 0, 1.0)], "station string, part_id long, ratio double")
    now = spark.createDataFrame([(100,), (230,), (300,), (86300,), (5000,)], "t long")
    act = fleet.active_trips(fleet.trip_spans(trips, stops), now)
    assert {r.t: r.elapsed for r in act.collect()} == {100: 500, 230: 630, 300: 700, 86300: 300}
    loc = {r.t: r for r in fleet.locate_trips(act, fleet.resolve_legs(stops, ts)).collect()}
    assert loc[86300].ratio == pytest.approx(0.25) and loc[86300].moving
    assert loc[230].ratio == pytest.approx(0.5) and not loc[230].moving
    assert loc[300].ratio == pytest.approx(0.5 + 0.5 * 40 / 540)


def test_keep_sorted_matches_on_numpy_path():
    rows = random_pings(9, n=400, entities=1)
    pos = np.array([(r[3], r[4], r[2]) for r in sorted(rows, key=lambda r: (r[2], r[1]))], dtype=float)
    keep = windows._keep_sorted("haversine", 40.0, pos, None)
    ids = [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))]
    assert sorted(i for i, k in zip(ids, keep) if k) == brute_clean(rows)


def test_slices_of_any_number(spark, tiny_limits):
    """Times around zero give negative slices and slice 0; no link may be lost."""
    from geolake.operators import windows as win

    rows = [(1, i, 30 * i - 300, 120.0 + i / 100, 23.0) for i in range(20)]
    p = spark.createDataFrame(rows, "entity_id long, ping_id long, t long, lon double, lat double")
    assert win.ping_speed(p).where("knots is null").count() == 1


def test_feature_numbers_of_signed_ids(spark):
    from geolake.operators import tiling

    ids = [-70000, -9, -8, 3, 4, 70000, 1 << 62, -(1 << 62)]
    rows = [(i, s, 120.001 + s / 10000, 23.001, "c") for i in ids for s in (0, 1)]
    v = spark.createDataFrame(rows, "part_id long, seq long, lon double, lat double, cls string")
    got = {r.part_id: r.feature_index for r in tiling.tile_features(v, 10, "cls", {}, "x").collect()}
    assert [got[i] for i in sorted(ids)] == list(range(len(ids)))


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e9])
def test_ranks_by_refinement(spark, scale):
    """Values of any scale, one value very often, and a heavy tail."""
    rnd = random.Random(8)
    rows = [("u", rnd.random() * scale) for _ in range(3000)] + [("t", scale * rnd.choice([1, 1, 1, 2, 3])) for _ in range(2000)]
    rows += [("e", scale * 10.0 ** rnd.uniform(-12, 12) * rnd.choice([1, -1])) for _ in range(2500)] + [("s", -scale), ("s", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    ranks = spark.createDataFrame([(k, r) for k, v in by.items() for r in {0, len(v) // 7, len(v) // 2, len(v) - 1}], "k string, rank long")
    for limit in (100, 10_000):
        got = [(r.k, r["rank"], r.v) for r in nth_values(df, "k", "v", ranks, limit).collect()]
        assert len(got) == ranks.count() and all(sorted(by[k])[n] == v for k, n, v in got)


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_few_kept_reports_across_batches(size):
    import pandas as pd

    rnd = random.Random(size)
    rows = pd.DataFrame({"entity_id": sorted(rnd.choices(range(12), k=45)), "p": range(45), "kept": [rnd.random() < 0.5 for _ in range(45)]})
    for least in (1, 2, 4):
        got = pd.concat(list(windows._enough((rows[k : k + size] for k in range(0, 45, size)), least)))
        n = rows[rows.kept].groupby("entity_id")["p"].transform("size")
        assert got["p"].tolist() == rows[rows.kept][n >= least]["p"].tolist()


def test_legs_by_lists_of_parts(spark):
    rnd = random.Random(8)
    far = [0, 1, 2, 65_535, 65_536, 70_000, 200_000, -1, -70_000]
    ts = [(f"S{rnd.randrange(12)}", rnd.choice(far), rnd.choice([None, rnd.random()])) for _ in range(90)] + [("S1", None, 0.5)]
    stops = [(trip, k, f"S{rnd.randrange(13)}", k * 600, k * 600 + 60) for trip in range(40) for k in range(6)]
    tracks = spark.createDataFrame(ts, "station string, part_id long, ratio double")
    got = fleet.resolve_legs(spark.createDataFrame(stops, "trip_id long, seq long, station string, arr_sec long, dep_sec long"), tracks)
    assert dict(got.dtypes)["part_id"] == "bigint"
    high = {}
    for s, p, r in ts:
        if p is not None:
            high.setdefault((s, p), []).append(r)
    high = {k: max([r for r in v if r is not None], default=0.0) for k, v in high.items()}
    at = {(t, k): s for t, k, s, _, _ in stops}
    rows = got.collect()
    assert len(rows) == 200
    for r in rows:
        f, t = at[r.trip_id, r.seq], at[r.trip_id, r.seq + 1]
        both = [p for p in far if (f, p) in high and (t, p) in high]
        want = (min(both), high[f, min(both)], high[t, min(both)]) if both else (-1, 0.0, 0.0)
        assert (r.part_id, r.ratio_from, r.ratio_to) == want
    # a station is a row or two, however many parts it is on
    many = spark.range(300).select(F.lit("S0").alias("station"), F.col("id").alias("part_id"), F.lit(0.5).alias("ratio"))
    assert fleet.station_lists(many).count() == 1


def test_ranks_are_dealt_by_rows(spark, monkeypatch):
    """Without a large key too, tasks follow the rows and not their bytes."""
    from geolake.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_HELD", 100, raising=False)
    df = spark.range(3000).select((F.col("id") % 60).alias("k"), (F.col("id") * 7919 % 3000).alias("v"))
    ranks = spark.range(60).select(F.col("id").alias("k"), F.lit(3).alias("rank"))
    got = nth_values(df, "k", "v", ranks).withColumn("_p", F.spark_partition_id()).collect()
    want = {k: sorted(i * 7919 % 3000 for i in range(k, 3000, 60))[3] for k in range(60)}
    assert {r.k: r.v for r in got} == want
    assert len({r["_p"] for r in got}) > 8


def test_legs_are_dealt_by_stops(spark, monkeypatch):
    """Every step on a timetable has tasks in number to its stops."""
    from geolake.operators import aggs, fleet, ordered

    monkeypatch.setattr(ordered, "ROWS_HELD", 100, raising=False)
    stops = spark.range(3000).selectExpr("id % 500 as trip_id", "id div 500 + 1 as seq", "concat('S', id % 90) as station", "0L as arr_sec", "0L as dep_sec")
    track = spark.range(90).selectExpr("id % 10 as part_id", "concat('S', id) as station", "id / 90 as ratio", "0e0 as dist_m")
    legs = fleet.resolve_legs(stops, track).withColumn("matched", F.col("part_id") >= 0)
    pairs = aggs.failing_pairs(legs.withColumn("matched", F.lit(False))).withColumn("_p", F.spark_partition_id()).collect()
    assert sum(r.n for r in pairs) == 2500 and len({r["_p"] for r in pairs}) > 8
    assert aggs.failing_pairs(legs).schema["a"].metadata["tasks"] > 8  # for the search for bridges
    report = aggs.coverage(legs, stops.select("trip_id").distinct(), stops, track).first()
    assert (report.trips, report.legs, report.stops_dropped) == (500, 2500, 0)
