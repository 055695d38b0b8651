"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as G
from .registry import query

ANCHOR = G.projection(23.7, 121.0, 12)
TILE = """cast(floor((lon + 180e0) / 360e0 * {n}) as bigint) as tx,
 cast(floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * {n}) as bigint) as ty"""
GX = "((lon + 180e0) / 360e0 * {s}e0)"
GY = "((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * {s}e0)"
HAV = (
    "2e0 * 6371000e0 * asin(sqrt(pow(sin(radians({b} - {a}) / 2e0), 2) + cos(radians({a})) * cos(radians({b}))"
    " * pow(sin(radians({d} - {c}) / 2e0), 2)))"
)


def hav_sql(lon1, lat1, lon2, lat2):
    return HAV.format(a=lat1, b=lat2, c=lon1, d=lon2)


@query(
    "h1_lonlat_to_tile",
    f"""with g as (select feature_id, {GX.format(s=8192 * 256)} as fx, {GY.format(s=8192 * 256)} as fy from points)
    select feature_id, cast(floor(fx / 256) as bigint) as tx, cast(floor(fy / 256) as bigint) as ty,
      cast(least(floor(fx - floor(fx / 256) * 256), 255) as bigint) as px,
      cast(least(floor(fy - floor(fy / 256) * 256), 255) as bigint) as py from g""",
)
def _(t):
    return t.points.select("feature_id", G.lonlat_to_tile("lon", "lat", 13).alias("k")).select("feature_id", "k.*")


@query(
    "h2_pixel_to_lonlat",
    """select gx, gy, round((6808 + gx) / 8192e0 * 360e0 - 180e0, 6) as lon,
      round(degrees(atan(sinh(pi() * (1e0 - 2e0 * (3498e0 + gy) / 8192e0)))), 6) as lat from cells""",
)
def _(t):
    lon, lat = G.pixel_to_lonlat(F.col("gx") + 6808, F.col("gy") + 3498, 5)
    return t.cells.select("gx", "gy", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_K = f"{ANCHOR.units_per_pixel!r}"
_W = f"""select feature_id, lon, lat, ({GX.format(s=4096 * 256)} - {ANCHOR.ox!r}) * {_K} as x,
   ({GY.format(s=4096 * 256)} - {ANCHOR.oy!r}) * {_K} as z from points"""


@query(
    "h3_lonlat_to_world",
    f"""with w as ({_W}) select feature_id, round(x, 4) as x, round(z, 4) as z,
     round(({ANCHOR.ox!r} + x / {_K}) / 1048576e0 * 360e0 - 180e0, 5) as lon_back,
     round(degrees(atan(sinh(pi() * (1e0 - 2e0 * ({ANCHOR.oy!r} + z / {_K}) / 1048576e0)))), 5) as lat_back,
     round(((floor(({ANCHOR.ox!r} + x / {_K}) / 256e0) + 0.5e0) * 256e0 - {ANCHOR.ox!r}) * {_K}, 4) as tile_x,
     round(((floor(({ANCHOR.oy!r} + z / {_K}) / 256e0) + 0.5e0) * 256e0 - {ANCHOR.oy!r}) * {_K}, 4) as tile_z from w""",
)
def _(t):
    x, z = G.lonlat_to_world("lon", "lat", ANCHOR)
    lon, lat = G.world_to_lonlat("x", "z", ANCHOR)
    gx, gy = G.world_to_pixel("x", "z", ANCHOR)
    cx, cz = G.tile_center_world(F.floor(gx / 256), F.floor(gy / 256), ANCHOR)
    return t.points.select("feature_id", x.alias("x"), z.alias("z")).select(
        "feature_id",
        F.round("x", 4).alias("x"),
        F.round("z", 4).alias("z"),
        F.round(lon, 5).alias("lon_back"),
        F.round(lat, 5).alias("lat_back"),
        F.round(cx, 4).alias("tile_x"),
        F.round(cz, 4).alias("tile_z"),
    )


TM2 = """with k as (select 6378137e0 as a, 6356752.314245e0 as b),
 c as (select a, b, (a-b)/(a+b) as n, 1e0-(b*b)/(a*a) as e2, (1e0-(b*b)/(a*a))/((b*b)/(a*a)) as ep from k),
 p as (select {id}, radians(lat) as f, radians(lon) - radians(121e0) as p, c.* from {src} cross join c),
 q as (select {id}, f, p, ep, n, a,
   a*(1e0-n+5e0*n*n/4e0*(1e0-n)+81e0*n*n*n*n/64e0*(1e0-n)) as ka,
   3e0*a*n/2e0*(1e0-n-7e0*n*n/8e0*(1e0-n)+55e0*n*n*n*n/64e0) as kb,
   15e0*a*n*n/16e0*(1e0-n+3e0*n*n/4e0*(1e0-n)) as kc,
   35e0*a*n*n*n/48e0*(1e0-n+11e0*n*n/16e0) as kd,
   315e0*a*n*n*n*n/51e0*(1e0-n) as ke,
   a/sqrt(1e0-e2*sin(f)*sin(f)) as nu from p),
 tm as (select {id},
   0.9999e0*nu*cos(f)*p + 0.9999e0*nu*pow(cos(f),3)/6e0*(1e0-pow(tan(f),2)+ep*pow(cos(f),2))*pow(p,3) + 250000e0 as x,
   (ka*f-kb*sin(2*f)+kc*sin(4*f)-kd*sin(6*f)+ke*sin(8*f))*0.9999e0 + 0.9999e0*nu*sin(f)*cos(f)/2e0*p*p
   + 0.9999e0*nu*sin(f)*pow(cos(f),3)/24e0*(5e0-pow(tan(f),2)+9e0*ep*pow(cos(f),2)+4e0*ep*ep*pow(cos(f),4))*pow(p,4) as y
   from q)"""


@query(
    "h4_lonlat_to_tm2",
    TM2.format(id="feature_id", src="points") + " select feature_id, round(x, 3) as x, round(y, 3) as y from tm",
)
def _(t):
    x, y = G.lonlat_to_tm2("lon", "lat")
    return t.points.select("feature_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    "h5_pixel_to_3857",
    """select gx, gy, round((6808 + gx) * (156543.03392e0 / 32e0) - 128e0 * 156543.03392e0, 3) as x,
     round(128e0 * 156543.03392e0 - (3498 + gy) * (156543.03392e0 / 32e0), 3) as y from cells""",
)
def _(t):
    x, y = G.pixel_to_3857(F.col("gx") + 6808, F.col("gy") + 3498, 5)
    return t.cells.select("gx", "gy", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    "h6_haversine",
    f"""select feature_id, round({hav_sql('lon', 'lat', '121e0', '23.7e0')}, 3) as metres,
      round({hav_sql('lon', 'lat', '121e0', '23.7e0')} / 1e3, 6) as km from points""",
)
def _(t):
    return t.points.select(
        "feature_id",
        F.round(G.haversine_m("lon", "lat", 121.0, 23.7), 3).alias("metres"),
        F.round(G.haversine_km("lon", "lat", 121.0, 23.7), 6).alias("km"),
    )


@query(
    "h7_terrarium_decode",
    """with c as (select p_partkey, (p_partkey * 7) % 3 + 126 as r, (p_partkey * 31) % 256 as g, (p_partkey * 17) % 256 as b from part)
    select p_partkey, case when r*256e0+g+b/256e0-32768e0 < -100e0 then 0e0 else r*256e0+g+b/256e0-32768e0 end as by_threshold,
      case when r=0 and g=0 and b=0 then 0e0 else r*256e0+g+b/256e0-32768e0 end as by_black from c""",
)
def _(t):
    c = t.part.selectExpr(
        "p_partkey", "(p_partkey * 7) % 3 + 126 as r", "(p_partkey * 31) % 256 as g", "(p_partkey * 17) % 256 as b"
    )
    return c.select(
        "p_partkey",
        G.terrarium_decode("r", "g", "b").alias("by_threshold"),
        G.terrarium_decode("r", "g", "b", "black").alias("by_black"),
    )


@query(
    "h8_log_area_ramp",
    """with a as (select p_partkey, least(greatest((log10(greatest(p_retailprice / 30e0, 1e-6)) - log10(0.1e0)) / (log10(45e0) - log10(0.1e0)), 0e0), 1e0) as t from part)
    select p_partkey, round(t * t * (3e0 - 2e0 * t), 6) as intensity from a""",
)
def _(t):
    ramp = G.log_area_ramp(F.col("p_retailprice") / 30.0, 0.1, 45.0)
    return t.part.select("p_partkey", F.round(ramp, 6).alias("intensity"))


# Red channel of the building height ramp.
BUILDING_RED = [(0.0, 0x2C / 255), (15.0, 0xFE / 255), (50.0, 0xA5 / 255)]


@query(
    "h9_ramp_lookup",
    f"""with a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as h from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when h <= 0 then {0x2C / 255!r}
      when h <= 15 then {0x2C / 255!r} + ({0xFE / 255!r} - {0x2C / 255!r}) * (h / 15e0)
      when h <= 50 then {0xFE / 255!r} + ({0xA5 / 255!r} - {0xFE / 255!r}) * ((h - 15e0) / 35e0)
      else {0xA5 / 255!r} end, 6) as red from a""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(G.ramp_lookup("l_quantity", BUILDING_RED), 6).alias("red")
    )


@query(
    "h10_hypsometric",
    """with h as (select p_partkey, (p_partkey * 7919) % 11000 - 7000e0 as h from part)
    select p_partkey, round(case when h < 0 then (1e0 - pow(1e0 - least(greatest((h + 7000e0) / 7000e0, 0e0), 1e0), 0.4e0)) * 0.35e0
      else 0.35e0 + 0.65e0 * least(greatest(0.5e0 + (least(greatest(h / 3952e0, 0e0), 1e0) - 0.4e0) * 1.2e0, 0e0), 1e0) end, 6) as ramp from h""",
)
def _(t):
    h = t.part.selectExpr("p_partkey", "(p_partkey * 7919) % 11000 - 7000e0 as h")
    return h.select("p_partkey", F.round(G.hypsometric("h", 0.0, -7000.0, 3952.0, 1.2, 0.4, 0.35), 6).alias("ramp"))


VOLT = "cast(cast(l_quantity * 1e3 as bigint) as varchar(20)) || ';' || cast(cast(floor(l_extendedprice) as bigint) as varchar(20)) || ';n/a'"


@query(
    "h11_voltage_class",
    f"""with v as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, list_max(list_transform(string_split({VOLT}, ';'), lambda x: try_cast(x as double))) / 1e3 as kv from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(case when kv >= 300 then 2 when kv >= 100 then 1 else 0 end as integer) as vclass from v""",
)
def _(t):
    v = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{VOLT} as volts")
    return v.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.voltage_class("volts").alias("vclass"))


CAP = "case when p_size > 30 then p_retailprice || ' MW' when p_size > 15 then 'approx ' || p_size || '00kW' else cast(p_size as varchar(20)) end"


@query(
    "h12_parse_capacity_mw",
    f"""with c as (select p_partkey, {CAP} as raw from part),
    m as (select p_partkey, try_cast(regexp_extract(raw, '([\\d.]+)\\s*(MW|KW)', 1, 'i') as double) as num,
       upper(regexp_extract(raw, '([\\d.]+)\\s*(MW|KW)', 2, 'i')) as unit from c)
    select p_partkey, round(case when unit = 'MW' then num when unit = 'KW' then num / 1e3 end, 3) as mw from m""",
)
def _(t):
    return t.part.selectExpr("p_partkey", f"{CAP} as raw").select("p_partkey", G.parse_capacity_mw("raw").alias("mw"))


HMS = "lpad(cast(dep_sec_of_day // 3600 as varchar(2)), 2, '0') || ':' || lpad(cast(dep_sec_of_day % 3600 // 60 as varchar(2)), 2, '0') || ':' || lpad(cast(dep_sec_of_day % 60 as varchar(2)), 2, '0')"


@query(
    "h13_clock_labels",
    """select trip_id, dep_sec_of_day as sec,
      lpad(cast(((dep_sec_of_day + 40000) % 86400) // 3600 as varchar), 2, '0') || ':' ||
      lpad(cast(((dep_sec_of_day + 40000) % 86400) % 3600 // 60 as varchar), 2, '0') as later from trips""",
)
def _(t):
    d = F.col("dep_sec_of_day")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    text = F.concat_ws(":", two(d / 3600), two(F.pmod(d, F.lit(3600)) / 60), two(F.pmod(d, F.lit(60))))
    return t.trips.select("trip_id", G.hms_to_sec(text).alias("sec"), G.sec_to_hhmm(d + 40000).alias("later"))


@query(
    "h14_date_key_day_seconds",
    """select ping_id, strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d') as date_key,
      (t + 28800) % 86400 as day_seconds from pings""",
)
def _(t):
    return t.pings.select("ping_id", G.date_key("t").alias("date_key"), G.day_seconds("t").alias("day_seconds"))


@query(
    "h15_service_elapsed",
    "select trip_id, ((30000 - dep_sec_of_day) % 86400 + 86400) % 86400 as elapsed from trips",
)
def _(t):
    return t.trips.select("trip_id", G.service_elapsed(F.lit(30000), "dep_sec_of_day").alias("elapsed"))


@query(
    "h16_reservoir_level",
    """with r as (select c_custkey, c_acctbal / 1e1 as full_el, c_acctbal / 2e1 as floor_el,
       case when c_nationkey < 10 then c_acctbal / 4e1 end as dam_h, (c_custkey % 101) / 1e2 as ratio from customer)
    select c_custkey, round(least(full_el, greatest(floor_el, full_el - (1e0 - ratio) * coalesce(dam_h, full_el * 0.15e0))), 7) as level from r""",
)
def _(t):
    r = t.customer.selectExpr(
        "c_custkey",
        "c_acctbal / 1e1 as full_el",
        "c_acctbal / 2e1 as floor_el",
        "case when c_nationkey < 10 then c_acctbal / 4e1 end as dam_h",
        "(c_custkey % 101) / 1e2 as ratio",
    )
    return r.select("c_custkey", F.round(G.reservoir_level("full_el", "floor_el", "dam_h", "ratio"), 7).alias("level"))


@query(
    "h17_tower_height",
    "select p_partkey, cast(case p_size % 3 when 0 then 25 when 1 then 40 when 2 then 55 end as integer) as height_m from part",
)
def _(t):
    return t.part.select("p_partkey", G.tower_height(F.col("p_size") % 3).alias("height_m"))


@query(
    "h18_ring_open_close",
    """select feature_id, cast(4 + group_id % 3 as bigint) as n_open, cast(5 + group_id % 3 as bigint) as n_closed,
      case when val > 5e3 then 'closed' else 'open' end as given from points""",
)
def _(t):
    # a regular outline around each point, stored closed or open
    n = (F.col("group_id") % 3 + 4).cast("int")
    turn = lambda i: F.struct((F.col("lon") + F.cos(i * 6.283185307179586 / n) / 100).alias("lon"), (F.col("lat") + F.sin(i * 6.283185307179586 / n) / 100).alias("lat"))
    pts = F.transform(F.sequence(F.lit(0), n - 1), turn)
    given = F.when(F.col("val") > 5000.0, F.concat(pts, F.slice(pts, 1, 1))).otherwise(pts)
    return t.points.withColumn("pts", given).select(
        "feature_id",
        F.size(G.ring_open("pts")).cast("long").alias("n_open"),
        F.size(G.ring_close("pts")).cast("long").alias("n_closed"),
        F.when(F.size("pts") > n, "closed").otherwise("open").alias("given"),
    )


@query(
    "h19_lerp_smoothstep",
    """with s as (select c_custkey, least(greatest((c_acctbal - 1e3) / 7e3, 0e0), 1e0) as k, c_acctbal from customer)
    select c_custkey, round(10e0 + 25e0 * k, 5) as mixed, round(k * k * (3e0 - 2e0 * k), 6) as smooth,
      round(1e0 - least(greatest((c_acctbal - 2e3) / 5e3, 0e0), 1e0), 6) as fade from s""",
)
def _(t):
    k = G.clamp((F.col("c_acctbal") - 1000.0) / 7000.0, 0.0, 1.0)
    return t.customer.select(
        "c_custkey",
        F.round(G.lerp(10.0, 35.0, k), 5).alias("mixed"),
        F.round(G.smoothstep(1000.0, 8000.0, "c_acctbal"), 6).alias("smooth"),
        F.round(G.linear_fade("c_acctbal", 2000.0, 7000.0), 6).alias("fade"),
    )


@query(
    "h20_ring_tolerance",
    """with d as (select feature_id, ring_id, sqrt(pow(max(lon) - min(lon), 2) + pow(max(lat) - min(lat), 2)) as diag from rings group by all)
    select feature_id, ring_id, round(greatest(0.0008e0, least(0.012e0, diag * 0.015e0)), 8) as tol from d""",
)
def _(t):
    diag = F.hypot(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat"))
    d = t.rings.groupBy("feature_id", "ring_id").agg(diag.alias("diag"))
    return d.select("feature_id", "ring_id", F.round(G.ring_tolerance("diag", 0.015, 0.0008, 0.012), 8).alias("tol"))


@query(
    "h21_metres_to_scaled",
    f"select gx, gy, round((v - 90e0) * {ANCHOR.k * 1.5!r}, 6) as y from cells",
)
def _(t):
    return t.cells.select("gx", "gy", F.round(G.metres_to_scaled("v", 90.0, ANCHOR.k, 1.5), 6).alias("y"))


@query(
    "h22_strip_prefix",
    "select feature_id, replace(name, 'Customer#', '') as code, replace(name, 'Customer#', '') || '→' || set_id as label from points",
)
def _(t):
    code = G.strip_prefix("name", "Customer#")
    return t.points.select("feature_id", code.alias("code"), F.concat(code, F.lit("→"), "set_id").alias("label"))


@query(
    "h23_feature_card",
    """select feature_id, name || ' ' || cast(round(val) as bigint) as label, cast(round(val) as bigint) as elev_m,
      cast(round(val * 3.28084e0) as bigint) as feet, printf('%.4f, %.4f', lat, lon) as grid_ref from points""",
)
def _(t):
    return t.points.select("feature_id", *G.feature_card("name", "val", "lon", "lat"))
