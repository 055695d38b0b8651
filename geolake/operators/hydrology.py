"""Whole-raster solves in blocks: filling, accumulation, regions, rings, burning.

A raster is cut into square blocks; each block is one bounded numpy task, blocks
talk through one-cell borders, and only blocks whose surroundings changed are
solved again. What travels between rounds is the borders, not the raster.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import lonlat_to_pixel
from ..session import cut
from .geometry import ring_edges
from .graph import components, rank_paths
from .ordered import _cols
from .raster import NAMES, STEPS, bounds, halo_blocks, neighbours
from .sampling import scanline_spans
from .voids import heights

SOLVE_BLOCK = 512
SPAN = 1 << 32


def _window(pdf: pd.DataFrame, cols: list[str], fill: dict) -> tuple[int, int, dict[str, np.ndarray]]:
    """Block rows to dense arrays with a one-cell margin."""
    x0, y0 = int(pdf["gx"].min()), int(pdf["gy"].min())
    h, w = int(pdf["gy"].max()) - y0 + 1, int(pdf["gx"].max()) - x0 + 1
    ix, iy = pdf["gx"].to_numpy() - x0 + 1, pdf["gy"].to_numpy() - y0 + 1
    out = {}
    for c in cols:
        v = pdf[c].to_numpy()
        a = np.full((h + 2, w + 2), fill[c], dtype=np.asarray(fill[c]).dtype)
        a[iy, ix] = v
        out[c] = a
    out["_iy"], out["_ix"] = iy, ix
    return x0, y0, out


def _shifts(a: np.ndarray):
    """The eight neighbours of the inner part."""
    n, m = a.shape
    for dx, dy in STEPS:
        yield a[1 + dy : n - 1 + dy, 1 + dx : m - 1 + dx]


def _sweep_rows(f: np.ndarray, z: np.ndarray, eps: float, rows) -> None:
    for r in rows:
        p = f[r[1]]
        low = np.minimum(np.minimum(p[:-2], p[1:-1]), p[2:])
        np.minimum(f[r[0], 1:-1], np.maximum(z[r[0], 1:-1], low + eps), out=f[r[0], 1:-1])


def _fill_block(z: np.ndarray, f: np.ndarray, eps: float) -> np.ndarray:
    """Least surface f >= z with f <= neighbour + eps wherever f > z, from the
    values already in ``f``. Sweeps down, up, right and left until still."""
    n, m = z.shape
    down = [(r, r - 1) for r in range(1, n - 1)]
    up = [(r, r + 1) for r in range(n - 2, 0, -1)]
    right = [(c, c - 1) for c in range(1, m - 1)]
    left = [(c, c + 1) for c in range(m - 2, 0, -1)]
    while True:
        old = f.copy()
        _sweep_rows(f, z, eps, down)
        _sweep_rows(f, z, eps, up)
        _sweep_rows(f.T, z.T, eps, right)
        _sweep_rows(f.T, z.T, eps, left)
        if np.array_equal(old, f):
            return f


def fill_depressions(cells: DataFrame, eps: float = 1e-4, block: int = SOLVE_BLOCK) -> DataFrame:
    """Depression filling with a minimal slope: adds ``filled``.

    filled = v on the raster's edge (cells missing a neighbour), elsewhere the
    least surface with filled >= v and filled <= lowest neighbour + eps where
    raised. Rounds exchange block borders until none changes, then one last pass
    emits the surface.
    """
    src = cells.select("gx", "gy", F.col("v").cast("double").alias("v"))
    tiles = cut(halo_blocks(src, block, 1))  # the source is read once, rounds read blocks

    def solve(emit_all: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            _, _, a = _window(pdf, ["v", "f", "core"], {"v": np.inf, "f": np.inf, "core": False})
            z, f, core = a["v"], a["f"], a["core"]
            inner = np.isfinite(z)
            whole = np.ones(z[1:-1, 1:-1].shape, dtype=bool)
            for s in _shifts(inner):
                whole &= s
            edge = np.zeros(z.shape, dtype=bool)
            edge[1:-1, 1:-1] = inner[1:-1, 1:-1] & ~whole
            edge &= core
            f[edge] = z[edge]
            f[core & ~edge] = np.inf
            # halo cells keep the value of their own block
            zz = np.where(core, z, np.inf)
            keep = f.copy()
            f = _fill_block(zz, f, eps)
            f[~core] = keep[~core]
            iy, ix = a["_iy"], a["_ix"]
            out = pd.DataFrame({"gx": pdf["gx"], "gy": pdf["gy"], "filled": f[iy, ix], "v": pdf["v"]})[pdf["core"].to_numpy()]
            if not emit_all:
                lx, ly = out["gx"] % block, out["gy"] % block
                out = out[(lx == 0) | (lx == block - 1) | (ly == 0) | (ly == block - 1)]
            return out[["gx", "gy", "v", "filled"]]

        return run

    schema = "gx long, gy long, v double, filled double"
    inf = F.lit(float("inf"))
    borders = cut(cells.sparkSession.createDataFrame([], "gx long, gy long, filled double"))
    active = None
    while True:
        t = tiles if active is None else tiles.join(active, ["bx", "by"], "left_semi")
        t = _with_halo(t, borders, inf)
        got = cut(t.groupBy("bx", "by").applyInPandas(solve(False), schema).where(F.col("filled") < inf).select("gx", "gy", "filled"))
        old = borders.select("gx", "gy", F.col("filled").alias("_old"))
        moved = got.join(old, ["gx", "gy"], "left").where(F.col("_old").isNull() | (F.col("filled") < F.col("_old")))
        moved = cut(moved.select("gx", "gy", "filled"))
        active = halo_blocks(moved, block, 1).where("not core").select("bx", "by").distinct()
        if active.isEmpty():
            break
        borders = cut(borders.join(moved.select("gx", "gy"), ["gx", "gy"], "left_anti").unionByName(moved))
    full = cut(borders.join(got.select("gx", "gy"), ["gx", "gy"], "left_anti").unionByName(got))
    return _with_halo(tiles, full, inf).groupBy("bx", "by").applyInPandas(solve(True), schema)


def _with_halo(tiles: DataFrame, borders: DataFrame, inf: Column) -> DataFrame:
    """Block rows with the known values of their halo cells. Core rows need no
    lookup and skip the join."""
    core = tiles.where("core").withColumn("f", inf)
    halo = tiles.where("not core").join(borders, ["gx", "gy"], "left").withColumn("f", F.coalesce("filled", inf)).drop("filled")
    return core.unionByName(halo.select(*core.columns))


# ------------------------------------------------------------------ accumulation
def _down(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Place of each cell's receiver among the cells of its block, ``len(pdf)`` where it
    lies outside or the cell is an outlet, and which cells' receivers lie outside."""
    gx, gy, rx, ry = (pdf[c].to_numpy().astype(np.int64) for c in ("gx", "gy", "rx", "ry"))
    key, want = gy * SPAN + gx, ry * SPAN + rx
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(key[order], want), len(key) - 1)
    here = key[order][at] == want
    ends = want == key
    return np.where(here & ~ends, order[at], len(key)), ~here


def _gather(ptr: np.ndarray, load: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``load`` over all cells that drain through each cell, and the last cell
    on each cell's way, by doubling the pointers."""
    n = len(ptr)
    acc = np.append(load, 0)
    root = np.where(ptr < n, ptr, np.arange(n))
    p = np.append(ptr, n)
    while (p[:n] < n).any():
        live = np.flatnonzero(p[:n] < n)
        acc[:n] += np.bincount(p[live], acc[live], n).astype(acc.dtype)
        root[live] = root[root[live]]
        p = p[p]
    return acc[:n], root


def accumulate(receivers: DataFrame, block: int = SOLVE_BLOCK) -> DataFrame:
    """Number of cells draining through each cell of a receiver forest (gx, gy, rx, ry;
    a receiver is a neighbour, or the cell itself at an outlet): adds ``acc``.

    Blocks add up their own flow. Between them only borders travel: the sums that leave
    a block, and for each border cell where flow that enters there leaves again. Doubling
    these links, settled ones set aside, gives what enters each block; a second pass over
    the blocks starts with it."""
    own = receivers.select("gx", "gy", "rx", "ry")
    at = [F.floor(F.col("gx") / block).alias("bx"), F.floor(F.col("gy") / block).alias("by")]

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        ptr, leaves = _down(pdf)
        acc, root = _gather(ptr, np.ones(len(ptr), np.int64))
        gx, gy, rx, ry = (pdf[c].to_numpy().astype(np.int64) for c in ("gx", "gy", "rx", "ry"))
        if (np.abs(rx - gx)[leaves] > 1).any() or (np.abs(ry - gy)[leaves] > 1).any():
            raise ValueError("a receiver is not a neighbour of its cell")
        out = np.where(leaves, ry * SPAN + rx, -1)
        x, y = gx % block, gy % block
        rim = (x == 0) | (x == block - 1) | (y == 0) | (y == block - 1)
        links = pd.DataFrame({"id": (gy * SPAN + gx)[rim], "ptr": out[root][rim], "acc": 0})
        sums = pd.DataFrame({"id": out[leaves], "ptr": -2, "acc": acc[leaves]})
        return pd.concat([links, sums])

    met = cut(own.groupBy(*at).applyInPandas(borders, "id long, ptr long, acc long"))
    enter = met.where("ptr = -2").groupBy("id").agg(F.sum("acc").alias("acc"))
    nodes = met.where("ptr > -2").select("id", F.when(F.col("ptr") >= 0, F.col("ptr")).alias("ptr"))
    live = cut(nodes.join(enter, "id", "left").fillna(0, ["acc"]).where("ptr is not null"))
    shares = [enter]
    while not live.isEmpty():
        add = cut(live.groupBy(F.col("ptr").alias("id")).agg(F.sum("acc").alias("acc")).where("acc > 0"))
        shares.append(add)
        ahead = live.select(F.col("id").alias("ptr"), F.col("ptr").alias("_next"))
        moved = live.join(ahead, "ptr").select("id", F.col("_next").alias("ptr"), "acc")
        live = cut(moved.join(add.withColumnRenamed("acc", "_add"), "id", "left").select("id", "ptr", (F.col("acc") + F.coalesce("_add", F.lit(0))).alias("acc")))
    load = _total([s.select(F.pmod("id", F.lit(SPAN)).alias("gx"), F.floor(F.col("id") / SPAN).alias("gy"), "acc") for s in shares])
    load = load.withColumnRenamed("acc", "_load").withColumns({"_bx": F.floor(F.col("gx") / block), "_by": F.floor(F.col("gy") / block)})

    def spread(key: tuple, pdf: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
        start = pdf[["gx", "gy"]].merge(entering[["gx", "gy", "_load"]], "left", ["gx", "gy"])["_load"].fillna(0).to_numpy().astype(np.int64)
        acc, _ = _gather(_down(pdf)[0], start + 1) if len(pdf) else (start, start)
        return pdf.assign(acc=acc).drop(columns=["_bx", "_by"])

    cells = receivers.withColumns({"_bx": F.floor(F.col("gx") / block), "_by": F.floor(F.col("gy") / block)})
    schema = receivers.withColumn("acc", F.lit(0).cast("long")).schema
    return cells.groupBy("_bx", "_by").cogroup(load.groupBy("_bx", "_by")).applyInPandas(spread, schema)


def accumulate_mfd(filled: DataFrame, p: float, cell_m: float = 1.0, block: int = SOLVE_BLOCK) -> DataFrame:
    """Contributing area when each cell shares its flow among all lower
    neighbours, weighted by slope^p: adds ``acc``.

    A block passes its own flow down until it has left or settled; what crosses a
    block border enters the next block in the next round. Flow is additive, so
    the rounds' shares add up to the exact result."""
    diag = cell_m * math.sqrt(2.0)
    filled = cut(filled)
    tiles = cut(halo_blocks(filled.select("gx", "gy", F.col("filled").cast("double").alias("z")), block, 1))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0, a = _window(pdf, ["z", "core", "load"], {"z": np.inf, "core": False, "load": 0.0})
        z, core = a["z"], a["core"]
        zi = z[1:-1, 1:-1]
        ci = core[1:-1, 1:-1]
        ws = []
        for (dx, dy), zn in zip(STEPS, _shifts(z)):
            d = diag if dx and dy else cell_m
            with np.errstate(invalid="ignore"):
                drop = np.where(ci & np.isfinite(zn), zi - zn, 0.0)
            ws.append(np.where(drop > 0, (np.maximum(drop, 0) / d) ** p, 0.0))
        tot = sum(ws)
        ws = [np.divide(w, tot, out=np.zeros_like(w), where=tot > 0) for w in ws]
        flow = np.where(core, a["load"], 0.0)
        acc = flow.copy()
        out = np.zeros_like(acc)
        n, m = z.shape
        while True:
            nxt = np.zeros_like(acc)
            inner = flow[1:-1, 1:-1]
            for (dx, dy), w in zip(STEPS, ws):
                nxt[1 + dy : n - 1 + dy, 1 + dx : m - 1 + dx] += inner * w
            out += np.where(core, 0.0, nxt)
            flow = np.where(core, nxt, 0.0)
            if not flow.any():
                break
            acc += flow
        iy, ix = a["_iy"], a["_ix"]
        c = pdf["core"].to_numpy()
        val = np.where(c, acc[iy, ix], out[iy, ix])
        res = pd.DataFrame({"gx": pdf["gx"], "gy": pdf["gy"], "core": c, "load": val})
        return res[res["load"] > 0]

    schema = "gx long, gy long, core boolean, load double"
    shares = []
    inflow = None
    while True:
        if inflow is None:
            t = tiles.withColumn("load", F.when(F.col("core"), 1.0).otherwise(0.0))
        else:
            hit = halo_blocks(inflow, block, 0).select("bx", "by").distinct()
            t = tiles.join(hit, ["bx", "by"], "left_semi").join(inflow, ["gx", "gy"], "left")
            t = t.withColumn("load", F.when(F.col("core"), F.coalesce("load", F.lit(0.0))).otherwise(0.0))
        got = cut(t.groupBy("bx", "by").applyInPandas(run, schema))
        shares.append(got.where("core").select("gx", "gy", F.col("load").alias("acc")))
        inflow = cut(got.where("not core").groupBy("gx", "gy").agg(F.sum("load").alias("load")))
        if inflow.isEmpty():
            break
        if len(shares) >= 8:  # keep the plan short over many rounds
            shares = [cut(_total(shares))]
    return filled.join(_total(shares), ["gx", "gy"])


def _total(shares: list[DataFrame]) -> DataFrame:
    u = shares[0]
    for s in shares[1:]:
        u = u.unionByName(s)
    return u.groupBy("gx", "gy").agg(F.sum("acc").alias("acc"))


# ------------------------------------------------------------------------ regions
def label_regions(mask: DataFrame, connectivity: int = 4, block: int = SOLVE_BLOCK) -> DataFrame:
    """Connected regions of the cells of ``mask`` (gx, gy): adds ``region``, the
    smallest cell number (gy * 2^32 + gx) of the region. Blocks are labelled on
    their own; a small graph of touching labels joins them."""
    steps = [(dx, dy) for dx, dy in STEPS if connectivity == 8 or dx == 0 or dy == 0]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        big = np.iinfo(np.int64).max
        lab0 = pdf["gy"].to_numpy() * SPAN + pdf["gx"].to_numpy()
        _, _, a = _window(pdf.assign(l=lab0), ["l"], {"l": np.int64(big)})
        lab = a["l"]
        on = lab != big
        n, m = lab.shape
        while True:
            old = lab.copy()
            for dx, dy in steps:
                np.minimum(lab[1:-1, 1:-1], old[1 + dy : n - 1 + dy, 1 + dx : m - 1 + dx], out=lab[1:-1, 1:-1])
            lab[~on] = big
            # pass the least label along whole runs of each row and column
            for q, o in ((lab, on), (lab.T, on.T)):
                for r in range(1, q.shape[0] - 1):
                    row, hit = q[r], o[r]
                    if not hit.any():
                        continue
                    starts = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
                    ids = np.cumsum(hit & ~np.concatenate([[False], hit[:-1]])) - 1
                    low = np.full(len(starts), big)
                    np.minimum.at(low, ids[hit], row[hit])
                    row[hit] = low[ids[hit]]
            if np.array_equal(old, lab):
                break
        return pd.DataFrame({"gx": pdf["gx"], "gy": pdf["gy"], "local": lab[a["_iy"], a["_ix"]]})

    keyed = mask.select("gx", "gy", F.floor(F.col("gx") / block).alias("bx"), F.floor(F.col("gy") / block).alias("by"))
    loc = cut(keyed.groupBy("bx", "by").applyInPandas(run, "gx long, gy long, local long"))
    lx, ly = F.pmod("gx", F.lit(block)), F.pmod("gy", F.lit(block))
    rim = loc.where((lx == 0) | (lx == block - 1) | (ly == 0) | (ly == block - 1))
    half = [(dx, dy) for dx, dy in steps if (dy, dx) > (0, 0)]
    probe = rim.select("local", F.explode(F.array(*[F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx, dy in half])).alias("n"))
    touch = probe.select(F.col("local").alias("src"), "n.*").join(rim.select("gx", "gy", F.col("local").alias("dst")), ["gx", "gy"])
    touch = touch.where("src <> dst").select("src", "dst").distinct()
    comp = components(touch).withColumnRenamed("node", "local")
    return loc.join(comp, "local", "left").select("gx", "gy", F.coalesce("component", "local").alias("region"))


def interior_voids(cells: DataFrame, sea: float = 0.0, block: int = SOLVE_BLOCK) -> DataFrame:
    """Cells at or below ``sea`` whose 4-connected region does not reach the
    raster's border: gx, gy, region."""
    x0, x1, y0, y1 = bounds(cells)
    low = label_regions(cells.where(F.col("v") <= sea), 4, block)
    on_border = F.col("gx").isin(x0, x1) | F.col("gy").isin(y0, y1)
    open_ = low.where(on_border).select("region").distinct()
    return low.join(open_, "region", "left_anti").select("gx", "gy", "region")


def fill_holes(mask: DataFrame, col: str = "m", block: int = SOLVE_BLOCK) -> DataFrame:
    """Mask with its enclosed holes closed."""
    inv = mask.select("gx", "gy", F.when(F.col(col), 1.0).otherwise(0.0).alias("v"))
    holes = interior_voids(inv, 0.0, block).select("gx", "gy", F.lit(True).alias("_hole"))
    return mask.join(holes, ["gx", "gy"], "left").withColumn(col, F.col(col) | F.coalesce("_hole", F.lit(False))).drop("_hole")


def fill_voids(
    cells: DataFrame, voids: DataFrame, iters: int | None = None, block: int = 256, per_round: int = 16, tol: float = 1e-3
) -> DataFrame:
    """``cells`` with heights for void cells (gx, gy, region) such that each is the mean
    of its four neighbours, rim fixed. They are solved for, within ``tol`` of the exact
    heights (:mod:`.voids`).

    With ``iters`` they are not solved but relaxed: they start at the mean height of
    their region's rim and do that many steps. A halo of ``per_round`` cells lets a block
    do that many exact steps between shuffles, and only cells near voids take part."""
    if iters is None:
        done = heights(cells, voids, tol, block).withColumnRenamed("v", "_new")
        return cells.join(done, ["gx", "gy"], "left").withColumn("v", F.coalesce("_new", "v")).drop("_new")
    v = voids.select("gx", "gy", "region")
    near = v.select("region", F.explode(F.array(*[F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx, dy in ((0, -1), (-1, 0), (1, 0), (0, 1))])).alias("n"))
    ring = near.select("region", "n.*").distinct().join(v.select("gx", "gy"), ["gx", "gy"], "left_anti")
    ring = cut(ring.join(cells.select("gx", "gy", "v"), ["gx", "gy"]))
    start = ring.groupBy("region").agg(F.avg("v").alias("v"))
    free = v.join(start, "region", "left").select("gx", "gy", F.coalesce("v", F.lit(0.0)).alias("v"), F.lit(True).alias("free"))
    fixed = ring.select("gx", "gy", "v").distinct().withColumn("free", F.lit(False))
    work = cut(free.unionByName(fixed))

    def relax(k: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            _, _, a = _window(pdf, ["v", "free", "has"], {"v": 0.0, "free": False, "has": False})
            w, fr, has = a["v"], a["free"], a["has"].astype(float)
            cnt = has[:-2, 1:-1] + has[2:, 1:-1] + has[1:-1, :-2] + has[1:-1, 2:]
            for _ in range(k):
                s = w * has
                nb = s[:-2, 1:-1] + s[2:, 1:-1] + s[1:-1, :-2] + s[1:-1, 2:]
                mean = np.divide(nb, cnt, out=w[1:-1, 1:-1].copy(), where=cnt > 0)
                w[1:-1, 1:-1] = np.where(fr[1:-1, 1:-1], mean, w[1:-1, 1:-1])
            out = pdf[["gx", "gy", "free", "core"]].assign(v=w[a["_iy"], a["_ix"]])
            return out[out["core"]][["gx", "gy", "v", "free"]]

        return run

    left = iters
    while left > 0:
        k = min(per_round, left)
        t = halo_blocks(work.withColumn("has", F.lit(True)), block, k)
        work = cut(t.groupBy("bx", "by").applyInPandas(relax(k), "gx long, gy long, v double, free boolean"))
        left -= k
    done = work.where("free").select("gx", "gy", F.col("v").alias("_new"))
    return cells.join(done, ["gx", "gy"], "left").withColumn("v", F.coalesce("_new", "v")).drop("_new")


def polygonize(mask: DataFrame, block: int = SOLVE_BLOCK) -> DataFrame:
    """Outlines of the 8-connected regions of mask cells (gx, gy) as closed
    corner rings: region, ring_id, seq, x, y. Outer rings run clockwise on the
    screen (y down), holes the other way; straight runs keep only their corners."""
    cell = mask.select("gx", "gy").distinct()
    reg = cut(label_regions(cell, 8, block))
    n = cut(neighbours(reg.select("gx", "gy", "region"), F.lit(1), block, gaps=True))
    x, y = F.col("gx"), F.col("gy")
    # side 0 north (going east), 1 east (south), 2 south (west), 3 west (north)
    sides = [("n", 0), ("e", 1), ("s", 2), ("w", 3)]
    have = [F.when(F.col(nb).isNull(), F.lit(k)) for nb, k in sides]
    e = n.select("gx", "gy", "region", *NAMES, F.explode(F.filter(F.array(*have), lambda s: s.isNotNull())).alias("side"))
    # the next side around the region: outward diagonal first (it is connected),
    # then straight on, then the next side of the same cell
    turn = {0: ("ne", (1, -1), 3, "e", (1, 0)), 1: ("se", (1, 1), 0, "s", (0, 1)), 2: ("sw", (-1, 1), 1, "w", (-1, 0)), 3: ("nw", (-1, -1), 2, "n", (0, -1))}
    nx, ny, ns = x, y, F.pmod(F.col("side") + 1, F.lit(4))
    for k, (dn, (dx, dy), dside, sn, (sx, sy)) in turn.items():
        diag, straight = (F.col("side") == k) & F.col(dn).isNotNull(), (F.col("side") == k) & F.col(sn).isNotNull()
        nx = F.when(diag, x + dx).when(straight, x + sx).otherwise(nx)
        ny = F.when(diag, y + dy).when(straight, y + sy).otherwise(ny)
        ns = F.when(diag, F.lit(dside)).when(straight, F.col("side")).otherwise(ns)
    # a side's number: 29 bits each for y and x, signed, two for the side; ranking takes one more
    half = 1 << 28
    inside = x.between(-half + 1, half - 2) & y.between(-half + 1, half - 2)
    x, y, nx, ny = (F.when(inside, c).otherwise(F.raise_error(F.lit(f"outlines need cells within {half} of 0")).cast("long")) for c in (x, y, nx, ny))
    num = lambda a, b, s: ((b + half) * (1 << 29) + (a + half)) * 4 + s
    e = cut(e.select("region", "gx", "gy", "side", num(x, y, F.col("side")).alias("item"), num(nx, ny, ns).alias("after"), ns.alias("next_side")))
    links = e.select(F.col("item").alias("a"), F.lit(1).alias("pa"), F.col("after").alias("b"), F.lit(0).alias("pb"))
    order = rank_paths(e, links)
    # a vertex is where the direction changes: the end corner of the side
    cx = F.col("gx") + F.when(F.col("side").isin(0, 1), 1).otherwise(0)
    cy = F.col("gy") + F.when(F.col("side").isin(1, 2), 1).otherwise(0)
    v = e.join(order, "item").where(F.col("side") != F.col("next_side"))
    return v.select("region", F.col("path_id").alias("ring_id"), F.col("pos").alias("seq"), cx.alias("x"), cy.alias("y"))


def rasterize(ring_vertices: DataFrame, z: int, key) -> DataFrame:
    """Cells touched by polygons (rings by even-odd): every cell an edge passes,
    and every cell whose centre is inside. Columns: key..., gx, gy.
    ``key`` names a polygon; ``ring_id`` tells its rings apart."""
    key = _cols(key)
    rk = [*key, "ring_id"]
    gx, gy = lonlat_to_pixel("lon", "lat", z)
    v = ring_vertices.select(*rk, "seq", gx.alias("lon"), gy.alias("lat"))
    e = cut(ring_edges(v, rk))
    x0, y0, x1, y1 = (F.col(c) for c in ("lon0", "lat0", "lon1", "lat1"))
    rows = e.withColumn("gy", F.explode(F.sequence(F.floor(F.least(y0, y1)), F.floor(F.greatest(y0, y1)))))
    # part of the edge inside the row
    at = lambda yy: F.when(y0 == y1, x0).otherwise(x0 + (x1 - x0) * (yy - y0) / F.nullif(y1 - y0, F.lit(0.0)))
    ya, yb = F.greatest(F.least(y0, y1), F.col("gy").cast("double")), F.least(F.greatest(y0, y1), F.col("gy") + 1.0)
    xa, xb = F.when(y0 == y1, x0).otherwise(at(ya)), F.when(y0 == y1, x1).otherwise(at(yb))
    edge = rows.select(*key, F.col("gy"), F.explode(F.sequence(F.floor(F.least(xa, xb)), F.floor(F.greatest(xa, xb)))).alias("gx"))
    lo, hi = F.ceil(F.least(y0, y1) - 0.5), F.floor(F.greatest(y0, y1) - 0.5)
    mid = e.select(*key, *[c for c in ("lon0", "lat0", "lon1", "lat1")], lo.alias("_lo"), hi.alias("_hi")).where("_hi >= _lo").withColumn("gy", F.explode(F.sequence("_lo", "_hi")))
    spans = scanline_spans(mid, key, "gy", F.col("gy") + 0.5)
    a, b = F.ceil(F.col("x_in") - 0.5), F.ceil(F.col("x_out") - 0.5) - 1
    inside = spans.where(b >= a).select(*key, "gy", F.explode(F.sequence(a, b)).alias("gx"))
    return edge.select(*key, "gx", "gy").unionByName(inside.select(*key, "gx", "gy")).distinct()
