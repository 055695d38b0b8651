"""The registered queries against their SQL. All of them with GEOLAKE_ALL=1."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from geolake.plans.fixtures import DRIVER_TABLES
from tools.check import norm

DIR = "/root/testdata/sf0.001"
SOME = """h4_lonlat_to_tm2 p9_dict_encode j1_sample_nearest j4_points_in_polygons j14_resolve_legs a5_percentile_rank
 a13_ring_metrics w2_drop_speed_anomalies w10_sample_vertices e1_simplify r2_d8 r9_blur k2_locate_trips l2_lod_partition
 s1_read_geojson_lines t2_select_peaks bake_timetable_report bake_rivers g6_path_vertices""".split()
NAMES = sorted(entry.REGISTRY) if os.environ.get("GEOLAKE_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(entry.REGISTRY) <= set(entry.queries()) & set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["tx", "ty", "n"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)
