"""Tables the operators work on, derived from the driver tables.

Each derivation is one SQL text that both engines read; ``{name}`` is a driver
table and ``{series:N}`` a column ``i`` counting 0..N-1 beside every row.
Every table grows with the driver tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

DERIVED: dict[str, str] = {
    # point features in named sets
    "points": """
      select c_custkey as feature_id, c_name as name, c_mktsegment as set_id,
             cast(c_nationkey as bigint) as group_id, c_acctbal as val,
             119.2e0 + ((c_custkey * 7919) % 29000) / 1e4 as lon,
             21.8e0 + ((c_custkey * 6133) % 36000) / 1e4 as lat
      from {customer}""",
    # second, smaller point source
    "sites": """
      select s_suppkey as feature_id, s_name as name, cast(s_nationkey as bigint) as group_id, s_acctbal as val,
             119.2e0 + ((s_suppkey * 4049) % 29000) / 1e4 as lon,
             21.8e0 + ((s_suppkey * 2791) % 36000) / 1e4 as lat
      from {supplier}""",
    # rectangular zones, closed rings
    "zones": """
      select cast(n_nationkey as bigint) as zone_id, n_name as name, cast(n_regionkey as bigint) as kind, i as seq,
             119.2e0 + (n_nationkey % 5) * 0.58e0 + case when i = 1 or i = 2 then 0.58e0 else 0e0 end as lon,
             21.8e0 + floor(n_nationkey / 5e0) * 0.72e0 + case when i = 2 or i = 3 then 0.72e0 else 0e0 end as lat
      from {nation} {series:5}""",
    # star-shaped rings (0) with an inner ring (1) of opposite turn, closed
    "rings": """
      select s_suppkey as feature_id, ring_id, i as seq,
             round(119.5e0 + ((s_suppkey * 37) % 200) / 1e2
               + (case when ring_id = 0 then 1e0 else 0.3e0 end) * (0.02e0 + ((s_suppkey * 7 + (i % 16) * (i % 16) * 3) % 10) / 5e2)
                 * cos((case when ring_id = 0 then 1e0 else -1e0 end) * (i % 16) * 0.39269908169872414e0), 6) as lon,
             round(22.0e0 + ((s_suppkey * 53) % 300) / 1e2
               + (case when ring_id = 0 then 1e0 else 0.3e0 end) * (0.02e0 + ((s_suppkey * 7 + (i % 16) * (i % 16) * 3) % 10) / 5e2)
                 * sin((case when ring_id = 0 then 1e0 else -1e0 end) * (i % 16) * 0.39269908169872414e0), 6) as lat
      from (select s_suppkey, 0 as ring_id from {supplier} union all
            select s_suppkey, 1 as ring_id from {supplier} where s_acctbal > 5e3) r {series:17}""",
    # position reports
    "pings": """
      select event_id as ping_id, user_id as entity_id, event_type as entity_type, {epoch} as t,
             119.5e0 + ((user_id * 37) % 200) / 1e2 + ((event_id * 13) % 100) / 1e3 as lon,
             22.0e0 + ((user_id * 53) % 300) / 1e2 + ((event_id * 17) % 100) / 1e3 as lat
      from {events}""",
    # line vertices; four consecutive parts share end points
    "vertices": """
      select part_id, seq, system, name,
             round(119.5e0 + (g % 20) * 0.1e0 + (cast(floor(g / 18e4) as bigint) % 50) * 2e-3 + k * 1e-3, 6) as lon,
             round(22.0e0 + (cast(floor(g / 2e1) as bigint) % 6) * 0.5e0
                   + (cast(floor(g / 12e1) as bigint) % 1500) * 3e-4 + (((g + 1) * k * 7) % 11) / 1e4, 6) as lat,
             cast((k * 37 + g * 11) % 100 as double) as elev
      from (select s_suppkey as part_id, i as seq, s_name as name, cast(s_nationkey as bigint) as system,
                   cast(floor(s_suppkey / 4e0) as bigint) as g, (s_suppkey % 4) * 19 + i as k
            from {supplier} {series:20}) v""",
    # dense height grid, 100 cells wide; three sea columns
    "cells": """
      select p_partkey % 100 as gx, cast(floor(p_partkey / 1e2) as bigint) as gy,
             case when p_partkey % 100 < 3 then 0e0
                  else ((p_partkey % 100) * 7919 + cast(floor(p_partkey / 1e2) as bigint) * 6133) % 1000 / 1e1
                       + (p_partkey % 100) * 2e0 end as v
      from {part}""",
    # heights at two map zooms, addressed by global pixel; the fine one is partial
    "dem": """
      select 5 as z, 6808 + p_partkey % 70 as gx, 3498 + cast(floor(p_partkey / 7e1) as bigint) as gy,
             cast((p_partkey * 7919) % 3000 - 200 as double) as v from {part}
      union all
      select 4 as z, 3404 + p_partkey % 40 as gx, 1749 + cast(floor(p_partkey / 4e1) as bigint) as gy,
             cast((p_partkey * 6133) % 2500 - 150 as double) as v from {part}""",
    # vector field on the grid of cells
    "field": """
      select p_partkey % 100 as gx, cast(floor(p_partkey / 1e2) as bigint) as gy,
             ((p_partkey * 31) % 200 - 100) / 1e2 as u, ((p_partkey * 17) % 200 - 100) / 1e2 as v,
             p_size > 3 as valid
      from {part}""",
    # timetable
    "trips": """
      select o_orderkey as trip_id, o_orderpriority as trip_type, (o_orderkey * 97) % 86400 as dep_sec_of_day
      from {orders}""",
    "stops": """
      select trip_id, seq, station, (seq - 1) * 600 as arr_sec,
             (seq - 1) * 600 + case when seq = 1 then 0 else 60 end as dep_sec
      from (select l_orderkey as trip_id,
                   'S' || cast(cast(floor(l_orderkey / 3e2) as bigint) * 40 + l_partkey % 40 as varchar(20)) as station,
                   cast(row_number() over (partition by l_orderkey
                     order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as bigint) as seq
            from {lineitem}) s""",
    "track_stations": """
      select cast(floor(p_partkey / 4e1) as bigint) * 8 + p_partkey % 8 as part_id,
             'S' || cast(p_partkey as varchar(20)) as station,
             ((p_partkey * 13) % 40) / 4e1 as ratio, (p_partkey * 37) % 800 / 1e0 as dist_m from {part}
      union all
      select cast(floor(p_partkey / 4e1) as bigint) * 8 + (p_partkey + 1) % 8 as part_id,
             'S' || cast(p_partkey as varchar(20)) as station,
             ((p_partkey * 29 + 7) % 40) / 4e1 as ratio, (p_partkey * 53) % 800 / 1e0 as dist_m from {part}""",
}
# which derived tables a derivation itself reads
_TOKEN = re.compile(r"\{(\w+)(?::(\d+))?\}")

EPOCH_SPARK = "unix_seconds(cast(ts as timestamp))"
EPOCH_DUCK = "cast(floor(epoch_us(ts) / 1000000) as bigint)"


def _spark_text(text: str) -> str:
    def sub(m):
        word, n = m.group(1), m.group(2)
        if word == "series":
            return f"lateral view explode(sequence(0L, {int(n) - 1}L)) s as i"
        if word == "epoch":
            return EPOCH_SPARK
        return "{" + word + "}"

    return _TOKEN.sub(sub, text)


def _duck_text(text: str) -> str:
    def sub(m):
        word, n = m.group(1), m.group(2)
        if word == "series":
            return f"cross join range({n}) s(i)"
        if word == "epoch":
            return EPOCH_DUCK
        return word

    return _TOKEN.sub(sub, text)


def ctes(body: str) -> str:
    """Full SQL text: definitions of the derived tables used, then ``body``."""
    used = [n for n in DERIVED if re.search(rf"\b{n}\b", body)]
    defs = ",\n".join(f"{n} as ({_duck_text(DERIVED[n]).strip()})" for n in used)
    body = body.strip()
    m = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if m:
        rest = body[m.end():]
        return "with recursive " + (defs + ",\n" if defs else "") + rest
    return ("with recursive " + defs + "\n" if defs else "") + body


class Tables:
    """Driver tables and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def driver(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.driver(name)
        if name == "stops":
            return self._stops()
        if name in DERIVED:
            text = DERIVED[name]
            need = {m.group(1) for m in _TOKEN.finditer(text)} & set(DRIVER_TABLES)
            return self.spark.sql(_spark_text(text), **{n: self.driver(n) for n in need})
        raise AttributeError(name)

    def _stops(self) -> DataFrame:
        """The timetable numbered without putting a hot order into one task."""
        from ..operators.ordered import SLICE, hot_slices, note_tasks, row_number, tasks_for

        li = self.driver("lineitem")
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
        fine = F.col("l_linenumber").cast("long") * (1 << 40) + F.floor(F.col("l_partkey") / 4096) + 1
        tasks, li = tasks_for(li, li.count()), hot_slices(li, "l_orderkey", fine)
        li = li.repartition(tasks, "l_orderkey", *[c for c in li.columns if c == SLICE])
        seq = note_tasks(row_number(li, "l_orderkey", order, "seq").drop(SLICE), "l_orderkey", tasks)
        return seq.select(
            F.col("l_orderkey").alias("trip_id"),
            "seq",
            F.expr(
                "'S' || cast(cast(floor(l_orderkey / 3e2) as bigint) * 40 + l_partkey % 40 as varchar(20))"
            ).alias("station"),
            ((F.col("seq") - 1) * 600).alias("arr_sec"),
            ((F.col("seq") - 1) * 600 + F.when(F.col("seq") == 1, 0).otherwise(60)).alias("dep_sec"),
        )
