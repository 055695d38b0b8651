import random

import pytest
from pyspark.sql import functions as F

from geolake.operators import graph


def find(edges, nodes=()):
    parent = {n: n for e in edges for n in e} | {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in parent}


def test_components_star_path_and_random(spark):
    rnd = random.Random(1)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)]
    edges += [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(45)] + [(300, 300)]
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(n,) for n in {x for e in edges for x in e} | {999}], "node long")
    got = {r.node: r.component for r in graph.components(df, nodes).collect()}
    assert got == find(edges, [999])


def parts_df(spark, parts):
    return spark.createDataFrame([(k, i, float(x), float(y)) for k, p in parts.items() for i, (x, y) in enumerate(p)], "part_id long, seq long, lon double, lat double")


def test_stitch_chain_ring_and_junction(spark):
    parts = {
        1: [(0, 0), (1, 0)], 2: [(2, 0), (1, 0)], 3: [(2, 0), (3, 0)],  # chain, middle part reversed
        10: [(10, 0), (11, 0)], 11: [(11, 1), (11, 0)], 12: [(11, 1), (10, 0)],  # ring
        20: [(20, 0), (21, 0)], 21: [(21, 0), (22, 0)], 22: [(21, 0), (21, 1)],  # junction of three
        30: [(30, 0), (31, 0), (30, 1), (30, 0)],  # closed on itself
    }
    got = {}
    for r in graph.stitch(parts_df(spark, parts)).collect():
        got.setdefault(r.chain_id, {})[r.seq] = (r.lon, r.lat)
    lines = {k: [v[i] for i in range(len(v))] for k, v in got.items()}
    assert lines[1] == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert lines[10] == [(10, 0), (11, 0), (11, 1), (10, 0)]
    assert {20, 21, 22} <= lines.keys() and len(lines[21]) == 2
    assert lines[30] == [(30, 0), (31, 0), (30, 1), (30, 0)]
    before = {(x, y) for p in parts.values() for x, y in p}
    assert {p for l in lines.values() for p in l} == before


def test_long_chain_orders_in_one_line(spark):
    n = 70
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    parts = {ids[i]: ([(i, 0), (i + 1, 0)] if i % 3 else [(i + 1, 0), (i, 0)]) for i in range(n)}
    got = graph.stitch(parts_df(spark, parts)).orderBy("seq").collect()
    xs = [r.lon for r in got]
    assert len({r.chain_id for r in got}) == 1
    assert xs in (list(range(n + 1)), list(range(n, -1, -1)))


def test_dangling_end_joins_the_mainstem(spark):
    # 0.0001 deg of latitude is about 11 m
    parts = {1: [(120.0, 23.0), (120.0, 23.01), (120.0, 23.02)], 2: [(120.01, 23.01), (120.0001, 23.0101)], 3: [(121.0, 23.0), (121.0, 23.1)]}
    ends, chains, report = graph.snap_dangling(parts_df(spark, parts), tol_m=20.0)
    assert report.first().asDict() == {"checked": 6, "snapped": 1}
    moved = ends.where("near_chain is not null").first()
    assert (moved.chain_id, moved.near_chain, moved.lon, moved.lat) == (2, 1, 120.0, 23.01)
    comp = {r.chain_id: r.component for r in chains.collect()}
    assert comp[1] == comp[2] != comp[3]


def test_simple_paths_split_at_branch(spark):
    # 1 - 2 - 3, and 4 joins 2: 2 has three links and ends every path
    e = spark.createDataFrame([(1, 2, "end", "start"), (2, 3, "end", "end"), (2, 4, "start", "start")], "p long, q long, side_p string, side_q string")
    rows = graph.simple_paths(e).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path_id, []).append((r.pos, r.part_id, r.flipped))
    got = sorted(tuple(x[1] for x in sorted(v)) for v in by.values())
    assert sorted(tuple(sorted(g)) for g in got) == [(1, 2), (2, 3), (2, 4)]
    flips = {tuple(x[1] for x in sorted(v)): [x[2] for x in sorted(v)] for v in by.values()}
    # part 1 leaves by its end; 2 and 3 meet end to end, so the second is turned
    assert flips.get((1, 2), [False, False]) == [False, False]
    pair = flips.get((2, 3)) or flips.get((3, 2))
    assert pair == [False, True]


def test_path_vertices_keep_every_point(spark):
    v = parts_df(spark, {1: [(0, 0), (1, 0)], 2: [(1, 0), (2, 0)], 3: [(3, 0), (2, 0)]})
    e = spark.createDataFrame([(1, 2, "end", "start"), (2, 3, "end", "end")], "p long, q long, side_p string, side_q string")
    p = graph.path_vertices(graph.simple_paths(e), v).orderBy("seq").collect()
    assert [r.lon for r in p] in ([0, 1, 2, 3], [3, 2, 1, 0])


def test_components_of_links_between_many_copies(spark):
    # one node holds most edges
    edges = spark.range(2000).select(F.lit(-5).cast("long").alias("src"), F.col("id").alias("dst"))
    assert graph.components(edges).select("component").distinct().count() == 1


def test_large_part_numbers_are_an_error(spark):
    e = spark.createDataFrame([(1, 1 << 29, "end", "start")], "p long, q long, side_p string, side_q string")
    with pytest.raises(Exception, match="merged parts need numbers"):
        graph.simple_paths(e).count()
