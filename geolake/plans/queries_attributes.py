"""Queries over attributes, table joins, sets and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as G
from ..operators import aggs, attrs, joins
from .queries_functions import hav_sql
from .registry import query

COLORS = {"BUILDING": "#c94", "MACHINERY": "#49c", "HOUSEHOLD": "#4c9"}


@query(
    "p1_project_attrs",
    """select feature_id, case when val > 5e3 then name when group_id > 12 then set_id else 'unnamed' end as label,
     case set_id when 'BUILDING' then '#c94' when 'MACHINERY' then '#49c' when 'HOUSEHOLD' then '#4c9' else '#888' end as color from points""",
)
def _(t):
    p = t.points.withColumn("name_zh", F.when(F.col("val") > 5000.0, F.col("name")).otherwise("")).withColumn(
        "name_en", F.when(F.col("group_id") > 12, F.col("set_id"))
    )
    p = attrs.project_attrs(p, {"label": (("name_zh", "name_en"), "unnamed")})
    return p.select("feature_id", "label", attrs.classify("set_id", COLORS, "#888").alias("color"))


TYPE_CLASS = {"ECONOMY": "R", "STANDARD": "D"}


@query(
    "p2_map_enum",
    """select p_partkey, case p_type when 'ECONOMY' then 'R' else 'D' end as cls from part where p_type in ('ECONOMY', 'STANDARD')""",
)
def _(t):
    return attrs.map_enum(t.part, "p_type", TYPE_CLASS)[0].select("p_partkey", "cls")


@query(
    "p2_map_enum_audit",
    "select p_type, count(*) as dropped from part where p_type not in ('ECONOMY', 'STANDARD') group by p_type",
)
def _(t):
    return attrs.map_enum(t.part, "p_type", TYPE_CLASS)[1]


@query(
    "p3_allow_list",
    """select o_orderkey, o_orderpriority from orders where o_orderstatus in ('F', 'O') and o_orderpriority not in ('5-LOW')
     and try_cast(left(o_orderpriority, 1) as integer) is not null""",
)
def _(t):
    o = t.orders.withColumn("grade", F.substring("o_orderpriority", 1, 1))
    o = attrs.allow(o, "o_orderstatus", values=["F", "O"])
    o = attrs.allow(o, "o_orderpriority", exclude=["5-LOW"])
    return attrs.allow(o, "grade", numeric=True).select("o_orderkey", "o_orderpriority")


@query(
    "p4_in_bbox",
    "select feature_id from points where lon between 119.9e0 - 0.05e0 and 121.1e0 + 0.05e0 and lat between 22.0e0 - 0.05e0 and 24.0e0 + 0.05e0",
)
def _(t):
    return t.points.where(G.in_bbox("lon", "lat", (119.9, 22.0, 121.1, 24.0), 0.05)).select("feature_id")


@query(
    "p5_keep_rule",
    "select feature_id from points where val >= 7e3 or group_id = 3 or set_id = 'BUILDING' or (lat > 24.5e0 and lon > 121e0)",
)
def _(t):
    return attrs.keep_rule(
        t.points, "val >= 7e3", "group_id = 3", "set_id = 'BUILDING'", "lat > 24.5e0 and lon > 121e0"
    ).select("feature_id")


@query("p6_round_coord", "select feature_id, round(lon / 3e0, 5) as lon, round(lat / 3e0, 4) as lat from points")
def _(t):
    return t.points.select(
        "feature_id", G.round_coord(F.col("lon") / 3, 5).alias("lon"), G.round_coord(F.col("lat") / 3, 4).alias("lat")
    )


@query(
    "p7_slab_bounds",
    """with s as (select c_custkey, case when c_nationkey > 4 then c_acctbal end as f, case when c_nationkey < 20 then c_acctbal * 3e0 - 9e3 end as c from customer),
     b as (select c_custkey, case when f is null or c is null then 0e0 else f end as lo, least(case when f is null or c is null then 1524e0 else c end, 10000e0) as hi from s)
     select c_custkey, round(lo, 5) as lo, round(case when hi <= lo then lo + 1e0 else hi end, 5) as hi from b""",
)
def _(t):
    s = t.customer.selectExpr(
        "c_custkey", "case when c_nationkey > 4 then c_acctbal end as f", "case when c_nationkey < 20 then c_acctbal * 3e0 - 9e3 end as c"
    )
    s = s.select("c_custkey", G.slab_bounds("f", "c").alias("s"))
    return s.select("c_custkey", F.round("s.lo", 5).alias("lo"), F.round("s.hi", 5).alias("hi"))


@query(
    "p8_drop_malformed",
    """select p_partkey, p_retailprice as a, p_size / 1e1 as b from part where p_size > 5 and p_type <> 'ECONOMY'""",
)
def _(t):
    raw = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") > 5, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("a"),
        F.when(F.col("p_type") != "ECONOMY", (F.col("p_size") / 10).cast("string")).otherwise("").alias("b"),
    )
    return attrs.drop_malformed(raw, ["a", "b"])


@query(
    "p9_dict_encode",
    """with d as (select p_brand, row_number() over (order by min(p_partkey)) - 1 as code from part group by p_brand)
     select p_partkey, cast(code as bigint) as code from part join d using (p_brand)""",
)
def _(t):
    return attrs.dict_encode(t.part, "p_brand", "p_partkey")[0].select("p_partkey", "code")


ROADS = {"1-URGENT": "major", "2-HIGH": "mid", "3-MEDIUM": "mid"}


@query(
    "p11_classify",
    "select o_orderkey, case o_orderpriority when '1-URGENT' then 'major' when '2-HIGH' then 'mid' when '3-MEDIUM' then 'mid' else 'minor' end as bucket from orders",
)
def _(t):
    return t.orders.select("o_orderkey", attrs.classify("o_orderpriority", ROADS, "minor").alias("bucket"))


@query(
    "p11_classify_table",
    "select l_orderkey, coalesce(m.to_cls, 'other') as bucket, count(*) as n from lineitem left join (select p_partkey as k, min(p_type) as to_cls from part where p_size > 5 group by 1) m on m.k = l_partkey group by 1, 2",
)
def _(t):
    """The classes of the larger parts as a table; the others take the default."""
    known = t.part.where("p_size > 5").select("p_partkey", "p_type")
    return attrs.classify_by(t.lineitem, "l_partkey", known, "bucket", "other").groupBy("l_orderkey", "bucket").agg(F.count("*").alias("n"))


@query(
    "j9_gap_fill",
    """select group_id, feature_id, val from sites where val > 4e3
     union all select group_id, min(feature_id) as feature_id, arg_min(val, feature_id) as val from points
     where group_id not in (select group_id from sites where val > 4e3) group by group_id""",
)
def _(t):
    return joins.gap_fill(
        t.sites.where("val > 4e3").select("group_id", "feature_id", "val"), t.points.select("group_id", "feature_id", "val"), "group_id"
    )


@query(
    "j10_supplement",
    """select feature_id, group_id from sites where val > 6e3
     union all select feature_id, group_id from points where group_id not in (select group_id from sites where val > 6e3)""",
)
def _(t):
    return joins.supplement(
        t.sites.where("val > 6e3").select("feature_id", "group_id"), t.points.select("feature_id", "group_id"), "group_id"
    )


@query(
    "j11_resolve_names",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(s_name, cast(l_suppkey as varchar)) as s_name
     from lineitem left join (select * from supplier where s_acctbal > 2e3) s on l_suppkey = s_suppkey""",
)
def _(t):
    dim = t.supplier.where("s_acctbal > 2e3").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return joins.resolve_names(t.lineitem, dim, "l_suppkey", "s_name").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s_name"
    )


@query(
    "j11_unmatched_count",
    "select count(*) as dropped from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 2e3)",
)
def _(t):
    dim = t.supplier.where("s_acctbal > 2e3").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.unmatched_count(t.lineitem, dim, "l_suppkey")


@query(
    "j12_first_attr",
    """with d as (select p_brand, arg_min(h, p_partkey) as height from (select *, case when p_size > 20 then p_size else 0 end as h from part) where h <> 0 group by p_brand)
     select p_partkey, height from part join d using (p_brand)""",
)
def _(t):
    d = joins.first_attr(t.part.selectExpr("*", "case when p_size > 20 then p_size else 0 end as h"), "p_brand", "h", "p_partkey", "height")
    return t.part.join(d, "p_brand").select("p_partkey", "height")


@query(
    "j13_with_status",
    """with s as (select user_id, arg_max(value, (ts, event_id)) as pct from events group by user_id)
     select feature_id, round(coalesce(case when pct is not null then least(greatest(pct / 1e2, 0e0), 1e0) end, 1e0), 6) as ratio from points left join s on feature_id = user_id""",
)
def _(t):
    s = t.events.groupBy(F.col("user_id").alias("feature_id")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("pct"))
    return joins.with_status(t.points, s, "feature_id", "pct").select("feature_id", F.round("ratio", 6).alias("ratio"))


@query(
    "j16_coord_conflicts",
    f"""with a as (select feature_id, lon, lat from points), b as (select feature_id, lon as lon2, lat as lat2 from sites)
     select feature_id, round({hav_sql('lon', 'lat', 'lon2', 'lat2')}, 3) as dist_m from a join b using (feature_id)
     where {hav_sql('lon', 'lat', 'lon2', 'lat2')} > 50000""",
)
def _(t):
    c = joins.coord_conflicts(t.points, t.sites, "feature_id", 50000.0)
    return c.select("feature_id", F.round("dist_m", 3).alias("dist_m"))


@query(
    "j18_grid_or",
    """with a as (select gx, gy, v > 150 as m from cells where gx >= 20), b as (select gx, gy, valid as m from field where gx < 60)
     select gx, gy, coalesce(a.m, false) or coalesce(b.m, false) as m from a full join b using (gx, gy)""",
)
def _(t):
    a = t.cells.where("gx >= 20").selectExpr("gx", "gy", "v > 150 as m")
    return joins.grid_or(a, t.field.where("gx < 60").selectExpr("gx", "gy", "valid as m"))


J19 = """case when val < 1500e0 then 'small' when not (lon between 119.5e0 and 121.9e0 and lat between 22e0 and 25.2e0) then 'outside'
 when (lon between 119.5e0 and 120e0 and lat between 23e0 and 24e0) or (lon between 121e0 and 121.3e0 and lat between 22e0 and 22.6e0) then 'duplicate'
 when lon between 120e0 and 121e0 and lat between 22e0 and 25e0 and val > 7e3 then 'main' else 'kept' end"""


def _dedupe(t):
    area = lambda df: df.select("feature_id", "lon", "lat", F.col("val").alias("area"))
    return joins.dedupe_sources(
        area(t.sites),
        area(t.points),
        (119.5, 22.0, 121.9, 25.2),
        {"west": (119.5, 23.0, 120.0, 24.0), "south": (121.0, 22.0, 121.3, 22.6)},
        (120.0, 22.0, 121.0, 25.0),
        7000.0,
        1500.0,
    )


@query(
    "j19_dedupe_sources",
    f"""select feature_id, 'fine' as source from sites where val >= 1500e0
     union all select feature_id, 'coarse' as source from points where {J19} = 'kept'""",
)
def _(t):
    return _dedupe(t)[0].select("feature_id", "source")


@query("j19_drop_reasons", f"select {J19} as reason, count(*) as n from points group by 1")
def _(t):
    return aggs.class_counts(_dedupe(t)[1], "reason")


@query(
    "j21_dirty_tiles",
    """with tiles as (select distinct cast(floor(gx / 4e0) as bigint) as bx, cast(floor(gy / 4e0) as bigint) as byy from cells),
     changed as (select distinct cast(floor(gx / 4e0) as bigint) as tx, cast(floor(gy / 4e0) as bigint) as ty from cells where v > 285)
     select distinct bx, byy from tiles join changed on abs(bx - tx) <= 1 and abs(byy - ty) <= 1""",
)
def _(t):
    tile = lambda df: df.selectExpr("cast(floor(gx / 4e0) as bigint) as tx0", "cast(floor(gy / 4e0) as bigint) as ty0").distinct()
    tiles = tile(t.cells).selectExpr("*", "tx0 as tx1", "ty0 as ty1")
    changed = tile(t.cells.where("v > 285")).toDF("tx", "ty")
    return joins.dirty_tiles(tiles, changed).selectExpr("tx0 as bx", "ty0 as byy")


@query(
    "a1_to_sets",
    """select set_id, arg_min(name, feature_id) as name, count(*) as n_points, min(lon) as min_lon, max(lon) as max_lon,
     min(lat) as min_lat, max(lat) as max_lat from points group by set_id""",
)
def _(t):
    return aggs.to_sets(t.points, "set_id", ["name"], "feature_id")


@query(
    "a2_class_counts",
    "select set_id, group_id, count(*) as n from points group by set_id, group_id",
)
def _(t):
    return aggs.class_counts(t.points, ["set_id", "group_id"])


@query(
    "a3_elev_range",
    """with g as (select part_id, min(elev) as lo, max(elev) as hi from vertices group by part_id)
     select part_id, lo as min_elev, hi as max_elev, lo - s_acctbal / 1e2 as min_diff, hi - s_acctbal / 5e1 as max_diff
     from g join supplier on part_id = s_suppkey""",
)
def _(t):
    src = t.supplier.selectExpr("s_suppkey as part_id", "s_acctbal / 1e2 as src_min", "s_acctbal / 5e1 as src_max")
    return aggs.elev_range(t.vertices, "part_id", src).select("part_id", "min_elev", "max_elev", "min_diff", "max_diff")


MEDIAN = "select set_id, round(median(val), 6) as median from points group by set_id"


@query("a4_exact_median", MEDIAN)
def _(t):
    m = aggs.exact_median(t.points, "set_id", "val")
    return m.select("set_id", F.round("median", 6).alias("median"))


@query("a4_median_refined", MEDIAN)
def _(t):
    """As for a set too large to be ordered at once."""
    m = aggs.exact_median(t.points, "set_id", "val", limit=60)
    return m.select("set_id", F.round("median", 6).alias("median"))


P10 = """with r as (select l_suppkey, l_extendedprice as v, row_number() over (partition by l_suppkey order by l_extendedprice) - 1 as k,
       count(*) over (partition by l_suppkey) as n from lineitem)
     select l_suppkey, v as p10 from r where k = case when n < 5 then 0 else least(n - 1, cast(floor(n * 0.1e0) as bigint)) end"""


@query("a5_percentile_rank", P10)
def _(t):
    return aggs.percentile_rank(t.lineitem, "l_suppkey", "l_extendedprice", 0.1, "p10", min_n=5)


@query("a5_percentile_refined", P10)
def _(t):
    """As for suppliers with too many lines to be ordered at once."""
    return aggs.percentile_rank(t.lineitem, "l_suppkey", "l_extendedprice", 0.1, "p10", min_n=5, limit=200)


@query(
    "a6_tile_datum",
    """with m as (select floor(gx / 16) as tx, floor(gy / 16) as ty, avg(v) as mean from cells group by all)
     select round(avg(mean), 6) as datum, count(*) as tiles from m""",
)
def _(t):
    m = aggs.tile_means(t.cells, 16)
    return m.agg(F.round(F.avg(F.coalesce("mean", F.lit(0.0))), 6).alias("datum"), F.count("*").alias("tiles"))


@query(
    "a7_majority",
    """with v as (select l_suppkey, l_returnflag, l_linestatus, count(*) as votes from lineitem group by all)
     select l_suppkey, l_returnflag, l_linestatus, votes from v
     qualify row_number() over (partition by l_suppkey order by votes desc, l_returnflag, l_linestatus) = 1""",
)
def _(t):
    return aggs.majority(t.lineitem, "l_suppkey", ["l_returnflag", "l_linestatus"])


@query(
    "a11_component_totals",
    "select group_id, round(sum(val), 4) as total, count(*) as chains from points group by group_id",
)
def _(t):
    return aggs.component_totals(t.points, "group_id", "val").select("group_id", F.round("total", 4).alias("total"), "chains")


@query(
    "a15_interchanges",
    """with p as (select distinct station, part_id from track_stations)
     select station, part_id, count(*) over (partition by station) as n_parts, row_number() over (partition by station order by part_id) as part_no
     from p qualify count(*) over (partition by station) >= 2""",
)
def _(t):
    return aggs.interchanges(t.track_stations)


@query(
    "a17_layer_meta",
    """select count(distinct name) as features, count(distinct part_id) as parts, count(*) as vertices,
     cast(count(*) filter (where elev = 0) as bigint) as sea_hits, round(1e2 * count(*) filter (where elev > 0) / count(*), 1) as hit_pct from vertices""",
)
def _(t):
    return aggs.layer_meta(
        t.vertices,
        {
            "features": F.count_distinct("name"),
            "parts": F.count_distinct("part_id"),
            "vertices": F.count("*"),
            "sea_hits": F.count_if(F.col("elev") == 0),
            "hit_pct": F.round(100.0 * F.count_if(F.col("elev") > 0) / F.count("*"), 1),
        },
    )


@query(
    "a19_prefer",
    """select p_brand, p_partkey, p_type from part
     qualify row_number() over (partition by p_brand order by case when p_type = 'PROMO' then 0 else 1 end, p_partkey) = 1""",
)
def _(t):
    rows = t.part.select("p_brand", "p_partkey", "p_type")
    return aggs.prefer(rows, "p_brand", F.col("p_type") == "PROMO", "p_partkey")


@query(
    "a20_grid_stats",
    """select count(*) as cells, round(1e2 * count(*) filter (where v > 0) / count(*), 4) as land_pct,
     round(1e2 * count(*) filter (where v <> 0) / count(*), 4) as nonzero_pct, max(v) as max_v,
     count(*) filter (where v > 100) as n_above, count(distinct v) as n_unique from cells""",
)
def _(t):
    s = aggs.grid_stats(t.cells, 100.0)
    return s.withColumns({"land_pct": F.round("land_pct", 4), "nonzero_pct": F.round("nonzero_pct", 4)})


@query(
    "a22_describe_layers",
    """with f as (select set_id as layer_id from points union all select 'sites' from sites union all select 'zones' from zones),
     c as (select n_name as layer_id, n_regionkey > 2 as visible, 'g' || n_regionkey as grp from nation
       union all select 'sites', true, 'facility' union all select 'BUILDING', false, 'city')
     select layer_id, count(*) as n, coalesce(any_value(visible), false) as visible, coalesce(any_value(grp), 'other') as grp
     from f left join c using (layer_id) group by layer_id""",
)
def _(t):
    f = t.points.select(F.col("set_id").alias("layer_id")).union(t.sites.select(F.lit("sites"))).union(t.zones.select(F.lit("zones")))
    c = t.nation.selectExpr("n_name as layer_id", "n_regionkey > 2 as visible", "'g' || n_regionkey as grp")
    fixed = t.spark.createDataFrame([("sites", True, "facility"), ("BUILDING", False, "city")], "layer_id string, visible boolean, grp string")
    return aggs.describe_layers(f, c.union(fixed))


@query(
    "u1_union_sources",
    "select feature_id, lon, lat, 'points' as source from points union all select feature_id, lon, lat, 'sites' from sites",
)
def _(t):
    cols = ["feature_id", "lon", "lat"]
    return joins.union_sources({"points": t.points.select(*cols), "sites": t.sites.select(*cols)})


@query(
    "u2_keep_union",
    """select count(*) filter (where set_id = 'BUILDING') as kept_matched,
     count(*) filter (where set_id <> 'BUILDING' and val >= 6e3) as kept_system,
     count(*) filter (where set_id = 'BUILDING' or val >= 6e3) as kept_total, count(*) as total from points""",
)
def _(t):
    return attrs.keep_union(t.points, {"matched": "set_id = 'BUILDING'", "system": "val >= 6e3"})[1]


@query(
    "u3_common_parts",
    "select part_id from track_stations where ratio < 0.3e0 intersect select part_id from track_stations where ratio > 0.7e0",
)
def _(t):
    ts = t.track_stations
    return aggs.common_parts(ts.where("ratio < 0.3e0"), ts.where("ratio > 0.7e0"))


@query(
    "u4_diff_points",
    """with b as (select distinct set_id, lon, lat from points), a as (select distinct set_id, case when val < 1e3 and set_id <> 'BUILDING' then lon + 1e0 else lon end as lon, lat from points)
     select coalesce(b.set_id, a.set_id) as set_id, count(*) filter (where a.set_id is null) as lost, count(*) filter (where b.set_id is null) as added,
       count(*) filter (where a.set_id is null or b.set_id is null) = 0 as same_points,
       count(*) filter (where a.set_id is null or b.set_id is null) = 0 as untouched
     from b full join a on b.set_id = a.set_id and b.lon = a.lon and b.lat = a.lat group by 1""",
)
def _(t):
    moved = t.points.withColumn("lon", F.expr("case when val < 1e3 and set_id <> 'BUILDING' then lon + 1e0 else lon end"))
    return aggs.diff_points(t.points, moved, "set_id")


@query(
    "t1_ordered_by_ratio",
    """select part_id, station, ratio, dist_m from track_stations order by part_id, ratio, station""",
)
def _(t):
    return t.track_stations.orderBy("part_id", "ratio", "station")


@query(
    "s7_read_day",
    """with p as (select ping_id, entity_type, strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d') as day from pings)
     select ping_id, day, 'snapshot' as origin from p where entity_type = 'error' and day <= '2024-01-12'
     union all select ping_id, day, 'feed' from p where day not in (select day from p where entity_type = 'error' and day <= '2024-01-12') and entity_type <> 'error'""",
)
def _(t):
    p = t.pings.select("ping_id", "entity_type", G.date_key("t").alias("day"))
    snap = p.where("entity_type = 'error' and day <= '2024-01-12'").withColumn("origin", F.lit("snapshot"))
    out = joins.read_day(snap, p.withColumn("origin", F.lit("feed")), "day", lambda d: d.where("entity_type <> 'error'"))
    return out.select("ping_id", "day", "origin")


@query(
    "s8_recent_past_days",
    """select day, cast(row_number() over (order by day) as integer) as rank from (
     select distinct strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d') as day from pings
     where strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d') < '2024-01-20' order by day desc limit 7)""",
)
def _(t):
    return joins.recent_past_days(t.pings.select(G.date_key("t").alias("day")), "day", 7, "2024-01-20")


@query(
    "k8_for_day",
    "select ping_id, entity_id, t from pings where strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d') = '2024-01-09'",
)
def _(t):
    from ..operators.fleet import for_day

    return for_day(t.pings, "2024-01-09").select("ping_id", "entity_id", "t")
