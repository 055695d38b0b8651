"""Heights inside voids as the solution of Laplace's equation.

In every void cell the height is the mean of the four neighbours; the rim is fixed.
A void of a bounded number of cells is one sparse system, solved by conjugate
gradients in one task. A larger one is solved by cycles of two steps. Overlapping
blocks are solved exactly, with what lies around them fixed. Then the residuals are
summed over coarse cells, the coarse system (the fine one summed over the same cells)
is solved, and its correction is added, which carries heights across the void at once.
A cycle is three jobs whatever the size of the void and takes about four tenths of the
error away; the end is judged by a bound of the error, not by how little moved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .raster import halo_blocks

SPAN = 1 << 32
SIDES = ((0, -1), (-1, 0), (1, 0), (0, 1))
#: Cells of a void, or of a coarse system, that one task solves.
DIRECT_CELLS = 1 << 18


def _sides(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the four neighbours among the cells, ``len(x)`` where there is none."""
    key = y.astype(np.int64) * SPAN + x
    order = np.argsort(key)
    ranked = key[order]
    out = np.full((4, len(x)), len(x))
    for k, (dx, dy) in enumerate(SIDES):
        want = key + dy * SPAN + dx
        at = np.minimum(np.searchsorted(ranked, want), len(x) - 1)
        hit = ranked[at] == want
        out[k, hit] = order[at[hit]]
    return out


def solve(sides: np.ndarray, weights: np.ndarray, own: np.ndarray, b: np.ndarray, start: np.ndarray, close: float) -> np.ndarray:
    """x with ``own * x - sum(weights * x of the sides) = b`` by conjugate gradients, until
    no cell misses its equation by ``close`` or doubles allow no more."""
    x = start.astype(float)

    def times(p: np.ndarray) -> np.ndarray:
        q = np.append(p, 0.0)
        return own * p - sum(w * q[s] for w, s in zip(weights, sides, strict=True))

    scale = np.where(own > 0, own, 1.0)
    r = b - times(x)
    z = r / scale
    p, rz = z, float(r @ z)
    best, still = np.inf, 0
    while rz > 0:
        worst = float(np.abs(r).max())
        best, still = (worst, 0) if worst < 0.999 * best else (best, still + 1)
        if worst <= close or still > 2 * len(x) ** 0.5 + 100:
            break
        q = times(p)
        a = rz / float(p @ q)
        x, r = x + a * p, r - a * q
        z = r / scale
        rz, last = float(r @ z), rz
        p = z + rz / last * p
    return x


def equations(cells: DataFrame, voids: DataFrame) -> DataFrame:
    """gx, gy, region, b, m: of each void cell the sum and the number of its neighbours
    outside voids."""
    around = F.array(*[F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx, dy in SIDES])
    v = voids.select("gx", "gy", "region")
    near = v.select(F.col("gx").alias("_x"), F.col("gy").alias("_y"), F.explode(around).alias("n")).select("_x", "_y", "n.*")
    rim = cells.select("gx", "gy", F.col("v").cast("double").alias("v")).join(v.select("gx", "gy"), ["gx", "gy"], "left_anti")
    met = near.join(rim, ["gx", "gy"]).groupBy(F.col("_x").alias("gx"), F.col("_y").alias("gy")).agg(F.sum("v").alias("b"), F.count("v").alias("m"))
    return v.join(met, ["gx", "gy"], "left").fillna(0, ["b", "m"])


def _close(tol: float, x: np.ndarray, y: np.ndarray) -> float:
    """The residual below which no height of a void is off by more than ``tol``: in a
    strip of n cells a residual of 1 everywhere raises the middle by n² / 8."""
    n = 2 + min(int(x.max() - x.min()), int(y.max() - y.min()))
    return 8 * tol / n**2


def _direct(tol: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, b, m = (pdf[c].to_numpy() for c in ("gx", "gy", "b", "m"))
        sides = _sides(x, y)
        inner = sides < len(x)
        start = np.full(len(x), b.sum() / max(m.sum(), 1))
        v = solve(sides, inner.astype(float), m + inner.sum(0), b, start, _close(tol, x, y))
        return pd.DataFrame({"gx": x, "gy": y, "v": v})

    return run


def _block(pdf: pd.DataFrame, overlap: int, close: float) -> pd.DataFrame:
    """One block with its overlap: cells on the outermost ring keep their height."""
    x, y, b, m, v = (pdf[c].to_numpy() for c in ("gx", "gy", "b", "m", "v"))
    core = pdf["core"].to_numpy()
    sides = _sides(x, y)
    cx, cy = x[core], y[core]
    far = np.maximum(np.maximum(cx.min() - x, x - cx.max()), np.maximum(cy.min() - y, y - cy.max()))
    free = far < overlap
    there = sides < len(x)
    ends = np.append(~free, False)[sides]
    held = np.append(np.where(free, 0.0, v), 0.0)[sides]
    rhs = np.where(free, b + (held * (there & ends)).sum(0), v)
    weights = (there & ~ends).astype(float) * free
    own = np.where(free, m + there.sum(0), 1.0)
    out = solve(sides, weights, own, rhs, v, close)
    return pdf[["gx", "gy", "region", "b", "m", "w8"]].assign(v=out)[core]


def _residual(pdf: pd.DataFrame) -> pd.DataFrame:
    x, y, b, m, v = (pdf[c].to_numpy() for c in ("gx", "gy", "b", "m", "v"))
    sides = _sides(x, y)
    there = sides < len(x)
    r = b + (np.append(v, 0.0)[sides] * there).sum(0) - (m + there.sum(0)) * v
    return pdf[["gx", "gy", "region", "w8"]].assign(r=r)[pdf["core"].to_numpy()]


def _coarse(pdf: pd.DataFrame) -> pd.DataFrame:
    x, y = pdf["cx"].to_numpy(), pdf["cy"].to_numpy()
    sides = _sides(x, y)
    weights = np.stack([pdf[c].to_numpy() for c in ("up", "left", "right", "down")]).astype(float)
    own = pdf["m"].to_numpy() + weights.sum(0)
    r = pdf["r"].to_numpy()
    e = solve(sides, weights, own, r, np.zeros(len(r)), 1e-6 * float(np.abs(r).max()))
    return pdf[["region", "cx", "cy"]].assign(e=e)


def _cycles(eq: DataFrame, tol: float, block: int, direct_cells: int) -> DataFrame:
    """Large voids. ``eq`` has w8, the factor from a residual to a bound of the error."""
    overlap = max(1, block // 4)
    if eq.isEmpty():
        return eq.select("gx", "gy", F.col("b").alias("v"))
    rows = eq.groupBy("region").agg(F.count("*").alias("n"), (F.sum("b") / F.greatest(F.sum("m"), F.lit(1))).alias("v"))
    largest = rows.agg(F.max("n")).first()[0]
    step = 4
    while largest > direct_cells * step * step // 4:
        step *= 2
    here = [F.floor(F.col("gx") / step).alias("cx"), F.floor(F.col("gy") / step).alias("cy")]
    state = cut(eq.join(rows.select("region", "v"), "region").select("gx", "gy", "region", "b", "m", "w8", "v"))
    # the coarse system: how many pairs of neighbours lie across each side, and the rim
    side = {"up": (0, -1), "left": (-1, 0), "right": (1, 0), "down": (0, 1)}
    probe = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), (F.col("gx") + dx).alias("nx"), (F.col("gy") + dy).alias("ny")) for n, (dx, dy) in side.items()]))
    out = (F.floor(F.col("p.nx") / step) != F.col("cx")) | (F.floor(F.col("p.ny") / step) != F.col("cy"))
    pairs = state.select("region", *here, probe.alias("p")).where(out).select("region", "cx", "cy", "p.side", F.col("p.nx").alias("gx"), F.col("p.ny").alias("gy"))
    across = pairs.join(state.select("gx", "gy"), ["gx", "gy"]).groupBy("region", "cx", "cy").pivot("side", list(side)).count()
    rim = state.groupBy("region", *here).agg(F.sum("m").alias("m"))
    system = cut(rim.join(across, ["region", "cx", "cy"], "left").fillna(0, list(side)))
    close = tol / eq.agg(F.max("w8")).first()[0] / 10
    best, still = float("inf"), 0
    kept = "gx long, gy long, region long, b double, m long, w8 double, v double"
    while True:
        near = halo_blocks(state, block, 1)
        r = near.groupBy("region", "bx", "by").applyInPandas(_residual, "gx long, gy long, region long, w8 double, r double")
        r = cut(r.groupBy("region", *here).agg(F.sum("r").alias("r"), F.max(F.abs(F.col("r")) * F.col("w8")).alias("bound")))
        bound = r.agg(F.max("bound")).first()[0] or 0.0
        best, still = (bound, 0) if bound < 0.9 * best else (best, still + 1)
        if bound <= tol or still > 10:
            return state.select("gx", "gy", "v")
        e = system.join(r.select("region", "cx", "cy", "r"), ["region", "cx", "cy"]).groupBy("region").applyInPandas(_coarse, "region long, cx long, cy long, e double")
        moved = state.withColumns({"cx": F.floor(F.col("gx") / step), "cy": F.floor(F.col("gy") / step)}).join(e, ["region", "cx", "cy"])
        moved = moved.select("gx", "gy", "region", "b", "m", "w8", (F.col("v") + F.col("e")).alias("v"))
        wide = halo_blocks(moved, block, overlap)
        state = cut(wide.groupBy("region", "bx", "by").applyInPandas(lambda pdf: _block(pdf, overlap, close) if pdf["core"].any() else pdf.iloc[:0][["gx", "gy", "region", "b", "m", "w8", "v"]], kept))


def heights(cells: DataFrame, voids: DataFrame, tol: float = 1e-3, block: int = 256, direct_cells: int = DIRECT_CELLS) -> DataFrame:
    """gx, gy, v of all cells of ``voids`` (gx, gy, region), none off the solution by more
    than ``tol`` as far as doubles reach. Neighbours that do not exist do not count; a
    void without any rim gets 0. Voids of up to ``direct_cells`` cells are solved whole."""
    eq = cut(equations(cells, voids))
    spans = [F.max(c) - F.min(c) for c in ("gx", "gy")]
    size = eq.groupBy("region").agg(F.count("*").alias("_n"), (F.pow(F.least(*spans) + 2, F.lit(2)) / 8).alias("w8"), F.sum("m").alias("_m"))
    size = cut(size)
    small = eq.join(size.where(F.col("_n") <= direct_cells).select("region"), "region", "left_semi")
    out = small.groupBy("region").applyInPandas(_direct(tol), "gx long, gy long, v double")
    large = size.where(F.col("_n") > direct_cells)
    if not large.isEmpty():
        out = out.unionByName(_cycles(eq.join(large.where("_m > 0").select("region", "w8"), "region"), tol, block, direct_cells))
        out = out.unionByName(eq.join(large.where("_m = 0").select("region"), "region", "left_semi").select("gx", "gy", F.lit(0.0).alias("v")))
    return out
