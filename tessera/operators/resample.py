"""Bins, spatial resampling and permutations that keep local structure."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(value: Column, low: Column, high: Column, n: int) -> Column:
    """Bin 1 to n of equal widths, closed on the right; the outer bins reach a little further."""
    inside = F.ceil((value - low) / (high - low) * n)
    return F.when(high > low, F.least(F.greatest(inside, F.lit(1)), F.lit(n))).otherwise(1).cast("int")


def binned(cells: DataFrame, nx: int = 10, ny: int = 10) -> DataFrame:
    """Cells with bx and by within their slide."""
    of = cells.groupBy("slide_id").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    both = cells.join(F.broadcast(of), "slide_id")
    return both.withColumn("bx", cut(F.col("x"), F.col("_x0"), F.col("_x1"), nx)).withColumn("by", cut(F.col("y"), F.col("_y0"), F.col("_y1"), ny)).drop("_x0", "_x1", "_y0", "_y1")


def bin_diagnostics(cells: DataFrame, nx: int = 10, ny: int = 10) -> DataFrame:
    """(slide_id, n_bins, occupied, empty, sparse, least, most, mean, median, sd) of cells in occupied bins; sparse: fewer than 5."""
    counts = binned(cells, nx, ny).groupBy("slide_id", "bx", "by").agg(F.count("*").alias("n"))
    return counts.groupBy("slide_id").agg(F.lit(nx * ny).alias("n_bins"), F.count("*").alias("occupied"), (nx * ny - F.count("*")).alias("empty"), F.sum((F.col("n") < 5).cast("long")).alias("sparse"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.stddev_samp("n").alias("sd"))


def neighbor_bins(bins: DataFrame, nx: int, ny: int) -> DataFrame:
    """(bx, by, nbx, nby): each bin's neighbours within the grid, itself included."""
    around = bins.select("bx", "by", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o"))
    return around.select("bx", "by", (F.col("bx") + F.col("o.i")).alias("nbx"), (F.col("by") + F.col("o.j")).alias("nby")).where(f"nbx between 1 and {nx} and nby between 1 and {ny}")


def sigma_bins(cells: DataFrame, sigma: float, scale: float, least: int = 2) -> tuple[int, int]:
    """Bins whose sides are about twice sigma in the cells' own units."""
    e = cells.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    side = 2 * sigma / scale
    if not side or not math.isfinite(side):
        return 10, 10
    return max(least, round((e.w or 0) / side)), max(least, round((e.h or 0) / side))


def toroidal(cells: DataFrame, shift_x: float, shift_y: float) -> DataFrame:
    """(slide_id, cell_type, cell_id, source_id): each cell takes the values of the cell with the same place in the order by (x, y) after a shift around the torus by shares of the extent."""
    w = Window.partitionBy("slide_id", "cell_type")
    span = lambda c: F.max(c).over(w) - F.min(c).over(w)
    moved = lambda c, s: F.when(span(c) > 0, F.pmod(F.col(c) - F.min(c).over(w) + F.lit(s) * span(c), span(c))).otherwise(F.col(c))
    shifted = cells.select("slide_id", "cell_type", "cell_id", "x", "y", moved("x", shift_x).alias("sx"), moved("y", shift_y).alias("sy"))
    before = shifted.select("slide_id", "cell_type", F.col("cell_id"), F.row_number().over(Window.partitionBy("slide_id", "cell_type").orderBy("x", "y", "cell_id")).alias("place"))
    after = shifted.select("slide_id", "cell_type", F.col("cell_id").alias("source_id"), F.row_number().over(Window.partitionBy("slide_id", "cell_type").orderBy("sx", "sy", "cell_id")).alias("place"))
    return before.join(after, ["slide_id", "cell_type", "place"]).drop("place")


def generator(seed: int, *key) -> np.random.Generator:
    """A generator for a seed and a key, alike wherever it runs."""
    return np.random.default_rng([seed, *(zlib.crc32(str(k).encode()) for k in key)])


def match_by_quantile(original: np.ndarray, candidates: np.ndarray, n: int) -> np.ndarray:
    """For each of n original points the nearest unused candidate by quantile position in x and y; candidates are used again, evenly, where there are too few."""
    def places(p: np.ndarray) -> np.ndarray:
        return np.stack([pd.Series(p[:, c]).rank(method="average").to_numpy() / (len(p) + 1) for c in range(2)], axis=1)

    a, b = places(original), places(candidates)
    left = np.full(len(b), 1 if len(b) >= n else -(-n // max(len(b), 1)))
    out = np.empty(n, int)
    for k in range(n):
        d = ((b - a[k % len(a)]) ** 2).sum(axis=1)
        d[left <= 0] = np.inf
        out[k] = int(d.argmin())
        left[out[k]] -= 1
    return out


def _resampled(x: np.ndarray, y: np.ndarray, nx: int, ny: int, rng: np.random.Generator, match: bool) -> np.ndarray:
    """Source positions: bins are shuffled among the occupied ones; a bin takes cells of its target bin, of the bins around it until there are enough, then again."""
    def bins(v: np.ndarray, n: int) -> np.ndarray:
        span = v.max() - v.min()
        return np.clip(np.ceil((v - v.min()) / span * n), 1, n).astype(int) if span > 0 else np.ones(len(v), int)

    bx, by = bins(x, nx), bins(y, ny)
    members: dict[tuple[int, int], np.ndarray] = {}
    for key in sorted(set(zip(bx.tolist(), by.tolist()))):
        members[key] = np.flatnonzero((bx == key[0]) & (by == key[1]))
    keys = list(members)
    targets = [keys[k] for k in rng.permutation(len(keys))]
    out = np.empty(len(x), int)
    for key, target in zip(keys, targets):
        own, pool = members[key], members[target]
        for near in ((i, j) for i in range(target[0] - 1, target[0] + 2) for j in range(target[1] - 1, target[1] + 2)):
            if len(pool) >= len(own):
                break
            if near in members and near != target:
                pool = np.concatenate([pool, members[near]])
        if match:
            out[own] = pool[match_by_quantile(np.stack([x[own], y[own]], axis=1), np.stack([x[pool], y[pool]], axis=1), len(own))]
        else:
            out[own] = rng.choice(pool, len(own), replace=len(pool) < len(own))
    return out


def permutation(x: np.ndarray, y: np.ndarray, method: str, rng: np.random.Generator, nx: int = 10, ny: int = 10, match: bool = False) -> np.ndarray:
    """Source positions of one draw: 'global' shuffle, 'bin' resampling or 'toroidal' shift."""
    if method == "global":
        return rng.permutation(len(x))
    if method == "bin":
        return _resampled(x, y, nx, ny, rng, match)
    if method == "toroidal":
        def moved(v: np.ndarray) -> np.ndarray:
            span = v.max() - v.min()
            by = rng.uniform(0.1, 0.9)
            return np.mod(v - v.min() + by * span, span) if span > 0 else v

        sx, sy = moved(x), moved(y)
        out = np.empty(len(x), int)
        out[np.lexsort((y, x))] = np.lexsort((sy, sx))
        return out
    raise ValueError("method is global, bin or toroidal")


def resample_spatial(cells: DataFrame, n: int, seed: int = 1, method: str = "bin", nx: int = 10, ny: int = 10, match: bool = False) -> DataFrame:
    """(perm_id, slide_id, cell_type, cell_id, source_id) of n draws; a task makes one draw for one slide and type."""
    small = cells.select("slide_id", "cell_type", "cell_id", "x", "y")
    dealt = small.withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def drawn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        source = permutation(pdf.x.to_numpy(), pdf.y.to_numpy(), method, generator(seed, *key), nx, ny, match)
        return pd.DataFrame({"perm_id": pdf.perm_id, "slide_id": pdf.slide_id, "cell_type": pdf.cell_type, "cell_id": pdf.cell_id, "source_id": pdf.cell_id.to_numpy()[source]})

    kind = dict(cells.dtypes)["cell_id"]
    return dealt.groupBy("perm_id", "slide_id", "cell_type").applyInPandas(drawn, f"perm_id int, slide_id string, cell_type string, cell_id {kind}, source_id {kind}")
