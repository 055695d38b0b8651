"""Fleets in time: timetable legs, trip states, trajectory positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import DAY, UTC_PLUS_8, sec_to_hhmm
from ..functions.shape import clamp
from .geometry import point_at
from ..session import cut
from .ordered import SLICE, deal, hot_slices, note_tasks, shift, tasks_for
from .windows import SEQ_SLICE, arc_ratio, by_time, to_legs

BUCKET = 600


def by_stop(df: DataFrame) -> DataFrame:
    return hot_slices(df, "trip_id", F.floor(F.col("seq") / SEQ_SLICE) + 1)


# ------------------------------------------------------------------ part matching
PARTS_HELD = 1 << 16  # part numbers of one list: two bytes each


def station_lists(track_stations: DataFrame) -> DataFrame:
    """The parts of every station as lists (_p, highest first, relative to the list's
    range _range of part numbers) with the station's highest ratio on each (_r)."""
    part = F.col("part_id").cast("long")
    span = F.floor(part / PARTS_HELD)
    low = (part - span * PARTS_HELD - PARTS_HELD // 2).cast("short")
    ts = track_stations.where("station is not null and part_id is not null")
    rows = F.sort_array(F.collect_list(F.struct(low.alias("p"), F.col("ratio").cast("double").alias("r"))), False)
    return ts.groupBy("station", span.alias("_range")).agg(rows.alias("_l")).select("station", "_range", F.col("_l.p").alias("_p"), F.col("_l.r").alias("_r"))


def resolve_legs(stops: DataFrame, track_stations: DataFrame) -> DataFrame:
    """Legs with the lowest part both stations share (-1 without one) and the
    ratios of the two stations on it. Parts are matched once per distinct pair of
    stations, however often it is served, by meeting the stations' lists: a pair never
    becomes a row for each part."""
    legs = cut(to_legs(stops))  # one ordered pass, used for the pairs and for the legs
    ends = ["from_station", "to_station"]
    tasks = tasks_for(legs, legs.count())
    lists = cut(station_lists(track_stations))
    pairs = legs.select(*ends).repartition(tasks, *ends).distinct()
    a = lists.select(F.col("station").alias("from_station"), "_range", F.col("_p").alias("_a"))
    b = lists.select(F.col("station").alias("to_station"), "_range", "_p", "_r")
    from_a = pairs.repartition(tasks, "from_station").join(a, "from_station")
    both = from_a.repartition(tasks, "to_station", "_range").join(b, ["to_station", "_range"]).withColumn("_m", F.array_min(F.array_intersect("_a", "_p"))).where("_m is not null")
    on = F.element_at("_r", F.array_position("_p", F.col("_m")).cast("int"))
    both = both.select(*ends, (F.col("_range") * PARTS_HELD + F.col("_m") + PARTS_HELD // 2).alias("_part"), on.alias("ratio_to"))
    best = both.repartition(tasks, *ends).groupBy(*ends).agg(F.min("_part").alias("_part"), F.min_by("ratio_to", "_part").alias("ratio_to"))
    best = best.withColumn("_range", F.floor(F.col("_part") / PARTS_HELD))
    own = lists.select(F.col("station").alias("from_station"), "_range", "_p", "_r")
    low = (F.col("_part") - F.col("_range") * PARTS_HELD - PARTS_HELD // 2).cast("short")
    best = best.repartition(tasks, "from_station", "_range").join(own, ["from_station", "_range"]).withColumn("ratio_from", F.element_at("_r", F.array_position("_p", low).cast("int")))
    part = F.col("_part").cast(track_stations.schema["part_id"].dataType).alias("part_id")
    out = legs.repartition(tasks, *ends).join(best.select(*ends, part, "ratio_from", "ratio_to"), ends, "left")
    out = out.withColumn("part_id", F.coalesce("part_id", F.lit(-1))).fillna(0.0, ["ratio_from", "ratio_to"])
    return note_tasks(note_tasks(out, "trip_id", tasks), "from_station", tasks)


def resolve_corridor(stops: DataFrame, track_stations: DataFrame) -> DataFrame:
    """One part per trip: the lowest where the first station comes before the
    last; trips without one are absent."""
    ends = deal(stops, stops, "trip_id", "trip_id").groupBy("trip_id").agg(F.min_by("station", "seq").alias("s0"), F.max_by("station", "seq").alias("s1"))
    ts = track_stations.groupBy("station", "part_id").agg(F.max("ratio").alias("ratio"))
    a = ts.select(F.col("station").alias("s0"), "part_id", F.col("ratio").alias("r0"))
    b = ts.select(F.col("station").alias("s1"), "part_id", F.col("ratio").alias("r1"))
    pairs = deal(ends.select("s0", "s1"), stops, "trip_id", "s0", "s1").distinct()
    pairs = deal(pairs, stops, "trip_id", "s0").join(a, "s0")
    pairs = deal(pairs, stops, "trip_id", "s1", "part_id").join(b, ["s1", "part_id"]).where("r0 < r1")
    best = deal(pairs, stops, "trip_id", "s0", "s1").groupBy("s0", "s1").agg(F.min("part_id").alias("part_id"))
    return deal(ends, stops, "trip_id", "s0", "s1").join(best, ["s0", "s1"]).select("trip_id", "part_id")


def corridor_legs(stops: DataFrame, track_stations: DataFrame) -> DataFrame:
    """Legs of single-corridor trips on the trip's part; matched when both
    stations lie on it in travel order."""
    ts = track_stations.groupBy("station", "part_id").agg(F.max("ratio").alias("ratio"))
    a = ts.select(F.col("station").alias("from_station"), "part_id", F.col("ratio").alias("ratio_from"))
    b = ts.select(F.col("station").alias("to_station"), "part_id", F.col("ratio").alias("ratio_to"))
    legs = to_legs(stops).join(resolve_corridor(stops, track_stations), "trip_id", "left")
    legs = deal(legs, stops, "trip_id", "from_station", "part_id").join(a, ["from_station", "part_id"], "left")
    legs = deal(legs, stops, "trip_id", "to_station", "part_id").join(b, ["to_station", "part_id"], "left")
    return legs.withColumn("matched", F.coalesce(F.col("ratio_from") <= F.col("ratio_to"), F.lit(False)))


# ------------------------------------------------------------------- trips in time
def trip_spans(trips: DataFrame, stops: DataFrame) -> DataFrame:
    """Trips of at least two stops with first_dep (relative) and last_arr."""
    s = stops.groupBy("trip_id").agg(
        F.min_by("dep_sec", "seq").alias("first_dep"), F.max_by("arr_sec", "seq").alias("last_arr"), F.count("*").alias("_n")
    )
    return trips.join(s.where("_n >= 2").drop("_n"), "trip_id")


def active_trips(spans: DataFrame, instants: DataFrame) -> DataFrame:
    """(trip, t) pairs in service at second-of-day ``t``, with ``elapsed`` wrapped
    past midnight. Both sides meet on ten-minute buckets of the day, so neither
    needs to be small."""
    per_day = DAY // BUCKET
    lo = F.floor(F.col("dep_sec_of_day") / BUCKET)
    hi = F.least(F.floor((F.col("dep_sec_of_day") + F.col("last_arr")) / BUCKET), lo + per_day - 1)
    s = spans.withColumn("_b", F.explode(F.sequence(lo, hi))).withColumn("_b", F.pmod("_b", F.lit(per_day)))
    i = instants.select("t", F.floor(F.pmod("t", F.lit(DAY)) / BUCKET).alias("_b"))
    j = s.join(i, "_b").withColumn("elapsed", F.pmod(F.col("t") - F.col("dep_sec_of_day"), F.lit(DAY)).cast("long"))
    return j.where(F.col("elapsed") <= F.col("last_arr")).drop("_b")


def _dir(a: Column, b: Column) -> Column:
    return F.when(b >= a, F.lit(1)).otherwise(F.lit(-1))


def locate_trips(active: DataFrame, legs: DataFrame) -> DataFrame:
    """State of each active trip: part_id, ratio, dir and moving. While dwelling
    it stands at the end of the leg before (or the start of the next); trips on
    a leg without a part are absent."""
    l = shift(by_stop(legs), "trip_id", "seq", {"p_part": ("part_id", -1), "p_from": ("ratio_from", -1), "p_to": ("ratio_to", -1)}).drop(SLICE)
    j = active.select("trip_id", "t", "elapsed", "first_dep").join(l, "trip_id").where(
        (F.col("elapsed") >= F.col("first_dep")) & (F.col("elapsed") >= F.col("arr_sec")) & (F.col("elapsed") <= F.col("to_arr_sec"))
    )
    dwell = F.col("elapsed") < F.col("dep_sec")
    span = F.col("to_arr_sec") - F.col("dep_sec")
    frac = F.when(span > 0, (F.col("elapsed") - F.col("dep_sec")) / span).otherwise(F.lit(0.0))
    use_prev = F.coalesce(F.col("p_part") >= 0, F.lit(False))
    state = (
        F.when(dwell & use_prev, F.struct(F.col("p_part").alias("part_id"), F.col("p_to").alias("ratio"), _dir(F.col("p_from"), F.col("p_to")).alias("dir"), F.lit(False).alias("moving")))
        .when(dwell, F.struct("part_id", F.col("ratio_from").alias("ratio"), _dir(F.col("ratio_from"), F.col("ratio_to")).alias("dir"), F.lit(False).alias("moving")))
        .otherwise(F.struct("part_id", (F.col("ratio_from") + (F.col("ratio_to") - F.col("ratio_from")) * frac).alias("ratio"), _dir(F.col("ratio_from"), F.col("ratio_to")).alias("dir"), F.lit(True).alias("moving")))
    )
    first = j.groupBy("trip_id", "t").agg(F.min_by(F.struct("elapsed", state.alias("s")), "seq").alias("m"))
    return first.select("trip_id", "t", "m.elapsed", "m.s.*").where("part_id >= 0")


def trip_positions(located: DataFrame, vertices: DataFrame) -> DataFrame:
    """Longitude and latitude of located trips on their part."""
    return point_at(located, vertices)


def lookahead(located: DataFrame, vertices: DataFrame, ahead_m: float) -> DataFrame:
    """Position ``ahead_m`` metres further along the part, held at its end."""
    v = arc_ratio(vertices)
    length = v.groupBy("part_id").agg(F.max("length_m").alias("_len")).where("_len > 0")
    q = located.join(length, "part_id")
    q = q.withColumn("ratio", clamp(F.col("ratio") + F.col("dir") * (F.lit(ahead_m) / F.col("_len")), 0.0, 1.0)).drop("_len")
    return point_at(q, v)


def trailing_positions(located: DataFrame, vertices: DataFrame, n: int, unit_m: float) -> DataFrame:
    """Positions of ``n`` units of ``unit_m`` metres behind each head (unit 0)."""
    v = arc_ratio(vertices)
    length = v.groupBy("part_id").agg(F.max("length_m").alias("_len")).where("_len > 0")
    q = located.join(length, "part_id").withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    q = q.withColumn("ratio", clamp(F.col("ratio") - F.col("dir") * F.col("unit") * (F.lit(unit_m) / F.col("_len")), 0.0, 1.0)).drop("_len")
    return point_at(q, v)


def trip_section(active: DataFrame, stops: DataFrame) -> DataFrame:
    """Current section and arrival time at its far end: the first later stop
    whose arrival is not before now, or the last stop after arrival."""
    s = shift(by_stop(stops), "trip_id", "seq", {"_prev": ("station", -1)}).drop(SLICE)
    s = s.select("trip_id", "seq", "station", "arr_sec", "_prev")
    j = active.select("trip_id", "t", "elapsed", "dep_sec_of_day", "last_arr").join(s, "trip_id")
    done = F.col("elapsed") >= F.col("last_arr")
    j = j.where(F.when(done, F.col("arr_sec") >= F.col("last_arr")).otherwise(F.col("_prev").isNotNull() & (F.col("arr_sec") >= F.col("elapsed"))))
    row = F.struct("station", "arr_sec", "_prev", "dep_sec_of_day", "last_arr", "elapsed")
    first = F.when(done, -F.col("seq")).otherwise(F.col("seq"))
    m = j.groupBy("trip_id", "t").agg(F.min_by(row, first).alias("m")).select("trip_id", "t", "m.*")
    arrived = F.col("elapsed") >= F.col("last_arr")
    return m.select(
        "trip_id",
        "t",
        F.when(arrived, F.col("station")).otherwise(F.concat("_prev", F.lit(" → "), "station")).alias("section"),
        sec_to_hhmm(F.col("dep_sec_of_day") + F.col("arr_sec")).alias("next_eta"),
    )


# ------------------------------------------------------------------- trajectories
def ping_segments(pings: DataFrame) -> DataFrame:
    """Consecutive reports of an entity: t0, lon0, lat0, t1, lon1, lat1. The last
    report stands alone with t1 null."""
    p = shift(by_time(pings, "entity_id"), "entity_id", ["t", "ping_id"], {"t1": ("t", 1), "lon1": ("lon", 1), "lat1": ("lat", 1)})
    return p.drop(SLICE).withColumnsRenamed({"t": "t0", "lon": "lon0", "lat": "lat0"})


def _at(seg: DataFrame, keep: list[str]) -> DataFrame:
    span = F.col("t1") - F.col("t0")
    frac = F.when(span > 0, (F.col("t") - F.col("t0")) / span).otherwise(F.lit(0.0))
    pos = lambda c: F.when(F.col("t1").isNull(), F.col(f"{c}0")).otherwise(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * frac)
    return seg.select(*keep, "t", pos("lon").alias("lon"), pos("lat").alias("lat"))


LEVELS = 14


def positions_at(pings: DataFrame, instants: DataFrame, bucket: int = 600) -> DataFrame:
    """Interpolated position of every entity at each instant between its first
    and last report.

    An interval join on time buckets of growing size: a segment is keyed in the
    bucket size that fits its length, so even a gap of months gives at most five
    rows; every instant is keyed once per size."""
    s = ping_segments(pings)
    length = F.greatest(F.coalesce("t1", "t0") - F.col("t0"), F.lit(1))
    level = clamp(F.ceil(F.log(4.0, length / F.lit(float(bucket)))), F.lit(0), F.lit(LEVELS - 1)).cast("int")
    size = lambda c: (F.lit(bucket) * F.pow(F.lit(4.0), c)).cast("long")
    s = s.withColumn("_lv", level)
    lo, hi = F.floor(F.col("t0") / size("_lv")), F.floor(F.coalesce("t1", "t0") / size("_lv"))
    s = s.withColumn("_b", F.explode(F.sequence(lo, hi)))
    i = instants.select("t", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_lv"))
    i = i.withColumn("_b", F.floor(F.col("t") / size("_lv")))
    j = s.join(i, ["_lv", "_b"]).where(
        F.when(F.col("t1").isNull(), F.col("t") == F.col("t0")).otherwise((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")))
    )
    return _at(j, ["entity_id"])


def timeline(pings: DataFrame, step: int) -> DataFrame:
    """Positions of every entity on the grid of multiples of ``step`` seconds;
    each segment lays out its own grid times, so nothing is joined."""
    s = ping_segments(pings)
    first = (F.ceil(F.col("t0") / step) * step).cast("long")
    last = F.when(F.col("t1").isNull(), F.col("t0")).otherwise(F.col("t1") - 1)
    last = (F.floor(last / step) * step).cast("long")
    g = s.where(last >= first).withColumn("t", F.explode(F.sequence(first, last, F.lit(step).cast("long"))))
    return _at(g, ["entity_id"])


def trip_timeline(spans: DataFrame, legs: DataFrame, step: int) -> DataFrame:
    """Trip states on a grid of the day's seconds. Each trip lays out the grid
    times it is in service at."""
    first = F.ceil(F.col("dep_sec_of_day") / step)
    last = F.floor((F.col("dep_sec_of_day") + F.least("last_arr", F.lit(DAY - 1))) / step)
    a = spans.where(last >= first).withColumn("_k", F.explode(F.sequence(first, last)))
    t = F.pmod(F.col("_k") * step, F.lit(DAY)).cast("long")
    a = a.withColumn("t", t).withColumn("elapsed", (F.col("_k") * step - F.col("dep_sec_of_day")).cast("long")).drop("_k")
    return locate_trips(a, legs)


def for_day(df: DataFrame, date_key: str, t: str = "t") -> DataFrame:
    """Rows of one UTC+8 day as a plain range on the time column, which the scan
    can push down; a ``date_key`` partition column prunes folders instead."""
    if "date_key" in df.columns:
        return df.where(F.col("date_key") == date_key)
    import datetime as dt

    start = int(dt.datetime.fromisoformat(date_key).replace(tzinfo=dt.timezone.utc).timestamp()) - UTC_PLUS_8
    return df.where((F.col(t) >= start) & (F.col(t) < start + DAY))
