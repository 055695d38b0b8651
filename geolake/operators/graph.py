"""Networks: snapping, components, list ranking, stitching, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import SLICE, _cols, deal, hot_slices, running_sum
from .spatial import nearest_within

NODE_SPAN = 1 << 32
MAX_PART = (1 << 29) - 1


def snap(c: str, prec: float):
    return F.rint(F.col(c) / prec).cast("long")


def node_id(lon: str, lat: str, prec: float):
    """One number per grid node of size ``prec`` (half-even rounding)."""
    return snap(lon, prec) * NODE_SPAN + snap(lat, prec)


def endpoint_nodes(vertices: DataFrame, prec: float = 1e-4, key: str = "part_id") -> DataFrame:
    """Both ends of every part with at least two vertices: node, port (0 start,
    1 end) and the node's degree (number of part ends on it)."""
    pos = F.struct("lon", "lat")
    e = vertices.groupBy(key).agg(F.min_by(pos, "seq").alias("a"), F.max_by(pos, "seq").alias("b"), F.count("*").alias("_n"))
    ends = e.where("_n >= 2").select(
        key, F.explode(F.array(F.struct(F.lit(0).alias("port"), "a.*"), F.struct(F.lit(1).alias("port"), "b.*"))).alias("e")
    )
    ends = ends.select(key, "e.*").withColumn("node", node_id("lon", "lat", prec))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return ends.join(degree, "node")


# ------------------------------------------------------------------- components
def components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components labelled by their smallest node.

    Alternates two star steps (join every larger neighbour, then every smaller
    one, to the smallest) until the edge set is a set of stars: a logarithmic
    number of rounds, each a minimum per node (pre-aggregated) and one join.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("s"))
        e = cut(small.select("s.u", F.col("s.m").alias("v")).where("u <> v").distinct())
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    lab = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = lab.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    lab = lab.unionByName(roots)
    if nodes is None:
        return lab
    n = nodes.select(F.col(nodes.columns[0]).cast("long").alias("node")).distinct()
    return n.join(lab, "node", "left").withColumn("component", F.coalesce("component", "node"))


# ----------------------------------------------------------------- list ranking
def rank_paths(items: DataFrame, links: DataFrame) -> DataFrame:
    """Order items joined end to end.

    ``items`` has ``item``; ``links`` joins port ``pa`` of ``a`` to port ``pb`` of
    ``b`` (ports 0 and 1, at most one link each). Returns item, path_id (its
    smallest item), pos and flipped (entered at port 1). Paths run so that their
    smallest item is not flipped; rings are opened before port 0 of it. Ranks
    come from pointer doubling: rounds grow with the logarithm of a path's length.
    """
    ids = items.select(F.col("item").cast("long").alias("item")).distinct()
    links = cut(links.select("a", "pa", "b", "pb").where("a <> b"))
    comp = cut(components(links, ids, "a", "b"))
    with_comp = links.join(comp.withColumnRenamed("node", "a"), "a")
    size = comp.groupBy("component").agg(F.count("*").alias("_n"))
    rings = with_comp.groupBy("component").agg(F.count("*").alias("_l")).join(size, "component").where("_l >= _n").select("component")
    opened = with_comp.join(rings.withColumn("_ring", F.lit(True)), "component", "left")
    at_start = ((F.col("a") == F.col("component")) & (F.col("pa") == 0)) | ((F.col("b") == F.col("component")) & (F.col("pb") == 0))
    links = opened.where(F.col("_ring").isNull() | ~at_start).select("a", "pa", "b", "pb")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("pb").alias("pa"), F.col("a").alias("b"), F.col("pa").alias("pb")))
    # state item*2+d: entered at port d; the state before it left through its link
    states = ids.select("item", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    before = both.select(F.col("a").alias("item"), F.col("pa").alias("d"), (F.col("b") * 2 + 1 - F.col("pb")).alias("_prev"))
    s = states.join(before, ["item", "d"], "left").select(
        (F.col("item") * 2 + F.col("d")).alias("sid"),
        F.coalesce("_prev", F.col("item") * 2 + F.col("d")).alias("ptr"),
        F.when(F.col("_prev").isNull(), 0).otherwise(1).cast("long").alias("dist"),
    )
    s = cut(s)
    while True:
        up = s.select(F.col("sid").alias("ptr"), F.col("ptr").alias("_p2"), F.col("dist").alias("_d2"))
        s = cut(s.join(up, "ptr").select("sid", F.col("_p2").alias("ptr"), (F.col("dist") + F.col("_d2")).alias("dist"), (F.col("_p2") != F.col("ptr")).alias("moved")))
        if s.where("moved").isEmpty():
            break
    r = s.select(F.shiftright("sid", 1).alias("item"), F.col("sid").bitwiseAND(1).cast("int").alias("d"), F.col("ptr").alias("head"), F.col("dist").alias("pos"))
    lead = r.groupBy("head").agg(F.min("item").alias("path_id"), F.min_by("d", "item").alias("_d")).where("_d = 0").select("head", "path_id")
    return r.join(lead, "head").select("item", "path_id", "pos", (F.col("d") == 1).alias("flipped"))


# --------------------------------------------------------------------- stitching
def stitch_order(vertices: DataFrame, prec: float = 1e-4, key: str = "part_id") -> tuple[DataFrame, DataFrame]:
    """(order, ends): chain_id, pos, flipped per part, joined through nodes where
    exactly two ends of different parts meet; and the part ends with degrees."""
    ends = cut(endpoint_nodes(vertices, prec, key))
    pair = ends.where("degree = 2").groupBy("node").agg(F.min(F.struct(key, "port")).alias("p"), F.max(F.struct(key, "port")).alias("q"))
    links = pair.select(F.col(f"p.{key}").alias("a"), F.col("p.port").alias("pa"), F.col(f"q.{key}").alias("b"), F.col("q.port").alias("pb")).where("a <> b")
    order = rank_paths(ends.select(F.col(key).alias("item")), links)
    return order.withColumnsRenamed({"item": key, "path_id": "chain_id"}), ends


def _concat(order: DataFrame, vertices: DataFrame, path: str, key: str) -> DataFrame:
    """Vertices along each path; the first vertex of a follower is dropped when
    ``joined`` says it repeats the one before."""
    size = vertices.groupBy(key).agg(F.count("*").alias("_n"))
    o = order.join(size, key).withColumn("_take", F.col("_n") - F.col("joined").cast("long"))
    o = running_sum(hot_slices(o, path, F.floor(F.col("pos") / 65536) + 1), path, "pos", {"_end": "_take"}).drop(SLICE)
    v = vertices.join(o, key)
    local = F.when(F.col("flipped"), F.col("_n") - 1 - F.col("seq")).otherwise(F.col("seq")) - F.col("joined").cast("long")
    v = v.withColumn("_local", local).where("_local >= 0")
    return v.withColumn("vseq", F.col("_end") - F.col("_take") + F.col("_local")).drop("_n", "_take", "_end", "_local", "joined")


def stitch(vertices: DataFrame, prec: float = 1e-4, key: str = "part_id") -> DataFrame:
    """Vertices of the maximal chains: chain_id, seq (0..), lon, lat, part_id, and
    the degrees of the chain's end nodes."""
    order, ends = stitch_order(vertices, prec, key)
    order = cut(order)
    v = _concat(order.withColumn("joined", F.col("pos") > 0), vertices.select(key, "seq", "lon", "lat"), "chain_id", key)
    return v.select("chain_id", F.col("vseq").alias("seq"), "lon", "lat", key)


def chain_ends(order: DataFrame, ends: DataFrame, key: str = "part_id") -> DataFrame:
    """Two rows per chain: which (0 start, 1 end), node, degree, lon, lat."""
    span = order.groupBy("chain_id").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    o = order.join(span, "chain_id")
    first = o.where("pos = _lo").select("chain_id", key, F.lit(0).alias("which"), F.when(F.col("flipped"), 1).otherwise(0).alias("port"))
    last = o.where("pos = _hi").select("chain_id", key, F.lit(1).alias("which"), F.when(F.col("flipped"), 0).otherwise(1).alias("port"))
    return first.unionByName(last).join(ends, [key, "port"]).select("chain_id", "which", "node", "degree", "lon", "lat")


def snap_dangling(vertices: DataFrame, prec: float = 1e-4, tol_m: float = 20.0, cell: float = 0.0003, key: str = "part_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ends, chains, report). Chain ends on a degree-1 node move onto the nearest
    vertex of another chain within ``tol_m`` and join its component. All ends
    are matched against the unmoved vertices."""
    order, part_ends = stitch_order(vertices, prec, key)
    order = cut(order)
    ends = cut(chain_ends(order, part_ends, key))
    v = _concat(order.withColumn("joined", F.col("pos") > 0), vertices.select(key, "seq", "lon", "lat"), "chain_id", key)
    v = v.select(F.col("chain_id").alias("chain"), F.col("vseq").alias("seq"), "lon", "lat")
    loose = ends.where("degree = 1").select((F.col("chain_id") * 2 + F.col("which")).alias("end_id"), F.col("chain_id").alias("chain"), "lon", "lat")
    near = cut(nearest_within(loose, v, tol_m, cell=cell))
    e = ends.withColumn("end_id", F.col("chain_id") * 2 + F.col("which")).join(near, "end_id", "left")
    e = cut(e.withColumns({"lon": F.coalesce("near_lon", "lon"), "lat": F.coalesce("near_lat", "lat")}))
    start = e.where("which = 0").select("chain_id", F.col("node").alias("start"))
    stop = e.where("which = 1").select("chain_id", F.col("node").alias("stop"))
    own = start.join(stop, "chain_id").select(F.col("start").alias("src"), F.col("stop").alias("dst"))
    tie = e.where("near_chain is not null").select(F.col("node").alias("src"), F.col("near_chain").alias("chain_id")).join(start, "chain_id")
    comp = components(own.unionByName(tie.select("src", F.col("start").alias("dst"))), e.select("node"))
    chains = start.join(comp.withColumnRenamed("node", "start"), "start").select("chain_id", "component")
    report = e.agg(F.count_if(F.col("degree") == 1).alias("checked"), F.count("near_chain").alias("snapped"))
    return e.drop("near_lon", "near_lat"), chains, report


# ----------------------------------------------------------------------- merging
def find_bridges(track_stations: DataFrame, pairs: DataFrame, end_tol: float = 0.05) -> DataFrame:
    """For station pairs (a, b): the lowest station that sits near an end of a
    part of ``a`` and near an end of a part of ``b``, with those parts and ends.
    """
    ts = track_stations.select("station", "part_id", "ratio")
    tips = ts.where((F.col("ratio") < end_tol) | (F.col("ratio") > 1 - end_tol)).select(
        "part_id", F.col("station").alias("bridge"), F.when(F.col("ratio") > 0.5, "end").otherwise("start").alias("side")
    )

    def half(col, tag):
        p = deal(pairs.select("a", "b", F.col(col).alias("station")), pairs, "a", "station").join(ts.select("station", "part_id"), "station")
        p = deal(p, pairs, "a", "part_id").join(tips, "part_id")
        best = F.min(F.struct("part_id", "side"))
        return deal(p, pairs, "a", "a", "b", "bridge").groupBy("a", "b", "bridge").agg(best.alias(tag))

    both = half("a", "pa").join(half("b", "pb"), ["a", "b", "bridge"])
    pick = both.groupBy("a", "b").agg(F.min(F.struct("bridge", "pa", "pb")).alias("m"))
    return pick.select(
        "a", "b", F.col("m.bridge").alias("bridge"),
        F.col("m.pa.part_id").alias("part_a"), F.col("m.pa.side").alias("side_a"), F.col("m.pb.part_id").alias("part_b"), F.col("m.pb.side").alias("side_b"),
    )


def merge_plan(track_stations: DataFrame, pairs: DataFrame, end_tol: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): one bridge per pair of parts (the first station pair
    that asks for it), and the station pairs without a bridge."""
    b = cut(find_bridges(track_stations, pairs, end_tol))
    unresolved = pairs.join(b.select("a", "b"), ["a", "b"], "left_anti")
    swap = F.col("part_a") > F.col("part_b")
    e = b.select(
        F.least("part_a", "part_b").alias("p"), F.greatest("part_a", "part_b").alias("q"), "a", "b", "bridge",
        F.when(swap, F.col("side_b")).otherwise(F.col("side_a")).alias("side_p"),
        F.when(swap, F.col("side_a")).otherwise(F.col("side_b")).alias("side_q"),
    )
    first = e.groupBy("p", "q").agg(F.min_by(F.struct("bridge", "side_p", "side_q"), F.struct("a", "b")).alias("m"))
    return first.select("p", "q", "m.*"), unresolved


def simple_paths(edges: DataFrame, key: str = "part_id") -> DataFrame:
    """Merged parts as simple paths: path_id, pos, part_id, flipped. A part with
    three or more links ends every path it is on and appears in each of them."""
    # copies of branch parts have negative numbers of twice the edge's, states twice those again
    small = F.col("p").between(0, MAX_PART) & F.col("q").between(0, MAX_PART)
    edge = F.when(small, F.col("p") * NODE_SPAN + F.col("q")).otherwise(F.raise_error(F.lit(f"merged parts need numbers in 0..{MAX_PART}")).cast("long"))
    e = edges.select("p", "q", "side_p", "side_q").withColumn("edge", edge)
    half = e.select("edge", F.col("p").alias("part"), F.col("side_p").alias("side"), F.lit(0).alias("h")).unionByName(
        e.select("edge", F.col("q").alias("part"), F.col("side_q").alias("side"), F.lit(1).alias("h"))
    )
    deg = half.groupBy("part").agg(F.count("*").alias("_deg"), F.min("edge").alias("_first"))
    half = half.join(deg, "part")
    # a branch part is copied per link (negative numbers); others keep one copy
    # with up to two ports. Part numbers must stay below 2^29.
    copy = F.when(F.col("_deg") >= 3, -(F.col("edge") * 2 + F.col("h")) - 1).otherwise(F.col("part"))
    half = cut(half.select("edge", "h", "part", "side", copy.alias("copy"), F.when((F.col("_deg") == 2) & (F.col("edge") != F.col("_first")), 1).otherwise(0).alias("port")))
    a = half.where("h = 0").select("edge", F.col("copy").alias("a"), F.col("port").alias("pa"))
    b = half.where("h = 1").select("edge", F.col("copy").alias("b"), F.col("port").alias("pb"))
    r = cut(rank_paths(half.select(F.col("copy").alias("item")), a.join(b, "edge")))
    # the physical side facing the part before (or, for the first part, after)
    faces = r.join(half.select(F.col("copy").alias("item"), "part", "port", "side"), "item")
    entry = F.when(F.col("flipped"), 1).otherwise(0)
    by_entry = F.min(F.when(F.col("port") == entry, F.col("side")))
    by_exit = F.min(F.when(F.col("port") != entry, F.col("side")))
    any_side = F.min("side")
    p = faces.groupBy("item", "path_id", "pos", "part").agg(by_entry.alias("_in"), by_exit.alias("_out"), any_side.alias("_any"))
    first = F.col("pos") == 0
    out_side = F.coalesce("_out", "_any")
    in_side = F.coalesce("_in", "_any")
    flip = F.when(first, out_side == "start").otherwise(in_side == "end")
    low = p.groupBy("path_id").agg(F.min(F.struct("part", "pos")).alias("m"))
    return p.join(low, "path_id").select(F.concat_ws("-", "m.part", "path_id").alias("path_id"), "pos", F.col("part").alias(key), flip.alias("flipped"))


def path_vertices(paths: DataFrame, vertices: DataFrame, key: str = "part_id") -> DataFrame:
    """Vertices along simple paths; a repeated joint vertex is dropped once."""
    ends = vertices.groupBy(key).agg(F.min_by(F.struct("lon", "lat"), "seq").alias("_a"), F.max_by(F.struct("lon", "lat"), "seq").alias("_b"))
    o = paths.join(ends, key)
    o = o.withColumns({"_h": F.when(F.col("flipped"), F.col("_b")).otherwise(F.col("_a")), "_t": F.when(F.col("flipped"), F.col("_a")).otherwise(F.col("_b"))})
    prev = o.select("path_id", (F.col("pos") + 1).alias("pos"), F.col("_t").alias("_pt"))
    o = o.join(prev, ["path_id", "pos"], "left").withColumn("joined", F.coalesce(F.col("_pt") == F.col("_h"), F.lit(False)))
    return _concat(o.select("path_id", "pos", key, "flipped", "joined"), vertices.select(key, "seq", "lon", "lat"), "path_id", key).select(
        "path_id", F.col("vseq").alias("seq"), "lon", "lat", key
    )
