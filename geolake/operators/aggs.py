"""Counts, ranks, totals and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import SLICE, _cols, deal, note_tasks, nth_values, range_slices, row_number


def to_sets(points: DataFrame, key: str, first: Sequence[str], order: str) -> DataFrame:
    """One row per set: its constant attributes (from the first member in
    ``order``), member count and bounds. Members stay rows keyed by the set."""
    return points.groupBy(key).agg(
        *[F.min_by(c, order).alias(c) for c in first],
        F.count("*").alias("n_points"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
    )


def class_counts(df: DataFrame, cols, out: str = "n") -> DataFrame:
    return df.groupBy(*_cols(cols)).agg(F.count("*").alias(out))


def elev_range(vertices: DataFrame, key, source: DataFrame | None = None) -> DataFrame:
    """Lowest and highest vertex per line; with a ``source`` table of published
    ranges, the differences too."""
    got = vertices.groupBy(*_cols(key)).agg(F.min("elev").alias("min_elev"), F.max("elev").alias("max_elev"))
    if source is None:
        return got
    return (
        got.join(source, _cols(key), "left")
        .withColumn("min_diff", F.col("min_elev") - F.col("src_min"))
        .withColumn("max_diff", F.col("max_elev") - F.col("src_max"))
    )


def exact_median(df: DataFrame, key, value: str, out: str = "median", limit: int | None = None) -> DataFrame:
    """Median per group by rank selection (mean of the two middle values)."""
    key = _cols(key)
    n = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.count("*").alias("_n"))
    mids = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    ranks = n.select(*key, F.explode(mids).alias("rank"))
    return nth_values(df, key, value, ranks, limit).groupBy(*key).agg(F.avg(value).alias(out))


def percentile_rank(df: DataFrame, key, value: str, p: float, out: str, min_n: int = 1, limit: int | None = None) -> DataFrame:
    """``sorted[min(n-1, int(n*p))]``; groups under ``min_n`` values use their minimum."""
    key = _cols(key)
    n = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.count("*").alias("_n"))
    k = F.when(F.col("_n") < min_n, F.lit(0).cast("long")).otherwise(
        F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p)))
    )
    return nth_values(df, key, value, n.select(*key, k.alias("rank")), limit).select(*key, F.col(value).alias(out))


def tile_means(cells: DataFrame, tile: int = 256) -> DataFrame:
    return cells.groupBy(F.floor(F.col("gx") / tile).alias("tx"), F.floor(F.col("gy") / tile).alias("ty")).agg(F.avg("v").alias("mean"))


def datum(means: DataFrame) -> DataFrame:
    """Mean of tile means; an absent tile (null mean) counts as zero."""
    return means.agg(F.avg(F.coalesce("mean", F.lit(0.0))).alias("datum"))


def majority(df: DataFrame, group, candidate: Sequence[str]) -> DataFrame:
    """Most frequent candidate per group; ties go to the smallest. Two
    aggregations, no window over a group."""
    group, candidate = _cols(group), _cols(candidate)
    votes = df.groupBy(*group, *candidate).agg(F.count("*").alias("votes"))
    best = F.min_by(F.struct(*candidate, "votes"), F.struct((-F.col("votes")).alias("_v"), *candidate))
    return votes.groupBy(*group).agg(best.alias("_b")).select(*group, "_b.*")


def component_totals(chains: DataFrame, component: str, length: str, out: str = "total") -> DataFrame:
    return chains.groupBy(component).agg(F.sum(length).alias(out), F.count("*").alias("chains"))


def coverage(legs: DataFrame, trips: DataFrame, stops: DataFrame | None = None, track_stations: DataFrame | None = None) -> DataFrame:
    """Timetable match report. ``legs`` holds trip_id and matched (boolean);
    ``trips`` lists every trip. With ``stops`` (trip_id, station) and
    ``track_stations`` (station) it adds stops_dropped: stops of listed trips at a
    station that no part knows."""
    per = deal(legs.select("trip_id", "matched"), legs, "trip_id", "trip_id").groupBy("trip_id").agg(F.count("*").alias("n"), F.count_if("matched").alias("ok"))
    all_ = deal(trips.select("trip_id"), legs, "trip_id", "trip_id").join(per, "trip_id", "left").fillna(0, ["n", "ok"])
    dropped = []
    if stops is not None and track_stations is not None:
        lost = deal(stops.select("trip_id", "station"), legs, "trip_id", "station").join(track_stations.select("station").distinct(), "station", "left_anti")
        lost = deal(lost, legs, "trip_id", "trip_id").groupBy("trip_id").agg(F.count("*").alias("lost"))
        all_ = all_.join(lost, "trip_id", "left").fillna(0, ["lost"])
        dropped = [F.sum("lost").alias("stops_dropped")]
    return all_.agg(
        F.count("*").alias("trips"),
        F.sum("n").alias("legs"),
        F.sum("ok").alias("legs_matched"),
        F.count_if((F.col("n") > 0) & (F.col("ok") == F.col("n"))).alias("trips_full"),
        F.count_if((F.col("n") > 0) & (F.col("ok") / F.greatest("n", F.lit(1)) >= 0.8)).alias("trips_mostly"),
        F.count_if(F.col("n") == 0).alias("trips_under_two_stops"),
        *dropped,
    )


def interchanges(track_stations: DataFrame, min_parts: int = 2) -> DataFrame:
    """Stations on at least ``min_parts`` parts: one row per station and part with
    the number of parts and the part's position in their order."""
    pairs = track_stations.select("station", "part_id").distinct()
    n = pairs.groupBy("station").agg(F.count("*").alias("n_parts")).where(F.col("n_parts") >= min_parts)
    rows = pairs.join(n, "station")
    return row_number(range_slices(rows, "station", "part_id"), "station", "part_id", "part_no").drop(SLICE)


def failing_pairs(legs: DataFrame) -> DataFrame:
    """Unordered station pairs of legs without a common part, with counts."""
    a, b = F.least("from_station", "to_station").alias("a"), F.greatest("from_station", "to_station").alias("b")
    pairs = legs.where(~F.col("matched")).select(a, b)
    out = deal(pairs, legs, "from_station", "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))
    tasks = legs.schema["from_station"].metadata.get("tasks")
    return out if tasks is None else note_tasks(out, "a", tasks)


def layer_meta(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """One-row report of a layer."""
    return df.agg(*[c.alias(n) for n, c in totals.items()])


def prefer(df: DataFrame, key, preferred: Column, order) -> DataFrame:
    """One row per key: a preferred row if there is one, else the first."""
    key = _cols(key)
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(F.when(preferred, 0).otherwise(1).alias("_p"), *_cols(order))
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*key, "_r.*")


def grid_stats(cells: DataFrame, above: float, col: str = "v") -> DataFrame:
    v = F.col(col)
    return cells.agg(
        F.count("*").alias("cells"),
        (F.count_if(v > 0) / F.count("*") * 100.0).alias("land_pct"),
        (F.count_if(v != 0) / F.count("*") * 100.0).alias("nonzero_pct"),
        F.max(v).alias("max_v"),
        F.count_if(v > above).alias("n_above"),
        F.count_distinct(v).alias("n_unique"),
    )


def unique_values(cells: DataFrame, col: str = "v") -> DataFrame:
    return cells.groupBy(col).agg(F.count("*").alias("n"))


def describe_layers(features: DataFrame, catalog: DataFrame, default_group: str = "other") -> DataFrame:
    """Feature count, visibility and group of every layer."""
    counts = features.groupBy("layer_id").agg(F.count("*").alias("n"))
    return counts.join(catalog, "layer_id", "left").select(
        "layer_id",
        "n",
        F.coalesce("visible", F.lit(False)).alias("visible"),
        F.coalesce("grp", F.lit(default_group)).alias("grp"),
    )


def common_parts(a: DataFrame, b: DataFrame, keys=("part_id",)) -> DataFrame:
    keys = _cols(keys)
    return a.select(*keys).intersect(b.select(*keys))


def diff_points(before: DataFrame, after: DataFrame, group: str, cols=("lon", "lat")) -> DataFrame:
    """Per group: points lost, points added, equality, and whether the row
    multiset is untouched (order-free content hash)."""
    cols = _cols(cols)

    def tally(df, side):
        h = F.xxhash64(*cols)
        return df.groupBy(group, *cols).agg(
            F.count("*").alias(side), F.sum(h.cast("decimal(38,0)")).alias(f"h_{side}")
        )

    both = tally(before, "n_before").join(tally(after, "n_after"), [group, *cols], "full")
    return both.groupBy(group).agg(
        F.count_if(F.col("n_after").isNull()).alias("lost"),
        F.count_if(F.col("n_before").isNull()).alias("added"),
        (F.count_if(F.col("n_after").isNull() | F.col("n_before").isNull()) == 0).alias("same_points"),
        (
            F.coalesce(F.sum("h_n_before"), F.lit(0)) == F.coalesce(F.sum("h_n_after"), F.lit(0))
        ).alias("untouched"),
    )
