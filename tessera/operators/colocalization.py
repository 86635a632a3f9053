"""Co-localisation of two types: the inhomogeneous cross pair correlation against random labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.resample import generator

#: Cells of a slide that one task takes; larger slides have to be cut first.
MOST_CELLS = 60_000


def _intensity(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, sigma: float, window: tuple[float, float, float, float], cells: int = 128) -> np.ndarray:
    """Density of points by a Gaussian kernel on a grid, divided by the kernel's mass within the window, at given places."""
    x0, x1, y0, y1 = window
    grid, _, _ = np.histogram2d(x, y, bins=cells, range=[[x0, x1], [y0, y1]])

    def smooth(width: float) -> np.ndarray:
        d = (np.arange(cells)[:, None] - np.arange(cells)[None, :]) * width
        return np.exp(-0.5 * (d / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi))

    wx, wy = (x1 - x0) / cells, (y1 - y0) / cells
    kx, ky = smooth(wx), smooth(wy)
    density = (kx @ grid @ ky.T) / np.outer(kx.sum(axis=1) * wx, ky.sum(axis=1) * wy)
    ix = np.clip(((at_x - x0) / wx).astype(int), 0, cells - 1)
    iy = np.clip(((at_y - y0) / wy).astype(int), 0, cells - 1)
    return np.maximum(density[ix, iy], 1e-12)


def g_cross(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, r: np.ndarray, sigma: float, bandwidth: float) -> np.ndarray:
    """g12 at radii r, corrected at the edges by translation; Epanechnikov weights of the bandwidth in r."""
    window = (min(ax.min(), bx.min()), max(ax.max(), bx.max()), min(ay.min(), by.min()), max(ay.max(), by.max()))
    w, h = max(window[1] - window[0], 1e-9), max(window[3] - window[2], 1e-9)
    la, lb = _intensity(ax, ay, ax, ay, sigma, window), _intensity(bx, by, bx, by, sigma, window)
    out, far = np.zeros(len(r)), r.max() + bandwidth
    order = np.argsort(bx)
    bx, by, lb = bx[order], by[order], lb[order]
    for k in range(len(ax)):
        lo, hi = np.searchsorted(bx, (ax[k] - far, ax[k] + far))
        dx, dy = np.abs(bx[lo:hi] - ax[k]), np.abs(by[lo:hi] - ay[k])
        d = np.hypot(dx, dy)
        near = (d <= far) & (d > 0) & (dx < w) & (dy < h)
        if near.any():
            weight = 1 / (la[k] * lb[lo:hi][near] * (w - dx[near]) * (h - dy[near]))
            t = (r[:, None] - d[near][None, :]) / bandwidth
            out += np.where(np.abs(t) < 1, 0.75 * (1 - t * t) / bandwidth, 0) @ weight
    return out / (2 * np.pi * r)


def _curves(pdf: pd.DataFrame, a: str, b: str, r: np.ndarray, sigma: float, bandwidth: float, n_sim: int, seed: int, key: tuple) -> np.ndarray:
    """The observed curve and those of shuffled labels, one a row."""
    x, y, first = pdf.x.to_numpy(), pdf.y.to_numpy(), (pdf.cell_type == a).to_numpy()
    rng = generator(seed, *key)
    rows = []
    for k in range(n_sim + 1):
        m = first if k == 0 else rng.permutation(first)
        rows.append(g_cross(x[m], y[m], x[~m], y[~m], r, sigma, bandwidth))
    return np.array(rows)


def _by_pair(cells: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    wanted = cells.sparkSession.createDataFrame([(*p, t) for p in pairs for t in p], "ct1 string, ct2 string, cell_type string")
    if cells.groupBy("slide_id").count().where(F.col("count") > MOST_CELLS).limit(1).count():
        raise ValueError(f"a slide has more than {MOST_CELLS} cells: cut it with partition_slides first")
    return cells.select("slide_id", "cell_type", "cell_id", "x", "y").join(F.broadcast(wanted), "cell_type")


def colocalization(cells: DataFrame, pairs: list[tuple[str, str]], r_range: tuple[float, float] = (10, 60), units: float = 1.0, cell_diameter: float = 10.0, n_sim: int = 199, step: float = 2.0, least: int = 20, seed: int = 1) -> DataFrame:
    """(slide_id, ct1, ct2, score, n1, n2, r_min, r_max): mean over the radii of how many deviations g12 lies from random labelling; null with fewer than `least` cells of a type.

    Coordinates are divided by units. A task takes one slide and pair.
    """
    r = np.arange(r_range[0], r_range[1] + step / 2, step)

    def scored(key, pdf: pd.DataFrame) -> pd.DataFrame:
        slide, a, b = key
        pdf = pdf.sort_values("cell_id").assign(x=lambda d: d.x / units, y=lambda d: d.y / units)
        n1, n2 = int((pdf.cell_type == a).sum()), int((pdf.cell_type == b).sum())
        score = None
        if min(n1, n2) >= least:
            g = _curves(pdf, a, b, r, 2 * cell_diameter, step * 2, n_sim, seed, key)
            sd = g[1:].std(axis=0, ddof=1)
            z = np.where(sd > 0, (g[0] - g[1:].mean(axis=0)) / np.where(sd > 0, sd, 1), 0)
            score = float(z.mean())
        return pd.DataFrame([(slide, a, b, score, n1, n2, float(r_range[0]), float(r_range[1]))], columns=["slide_id", "ct1", "ct2", "score", "n1", "n2", "r_min", "r_max"])

    return _by_pair(cells, pairs).groupBy("slide_id", "ct1", "ct2").applyInPandas(scored, "slide_id string, ct1 string, ct2 string, score double, n1 long, n2 long, r_min double, r_max double")


def g_curves(cells: DataFrame, pairs: list[tuple[str, str]], r_range: tuple[float, float] = (0, 60), units: float = 1.0, cell_diameter: float = 10.0, n_sim: int = 99, step: float = 2.0, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """(slide_id, ct1, ct2, r, observed, null_mean, lower, upper, n1, n2): the curve and the envelope of random labelling."""
    r = np.arange(max(r_range[0], step), r_range[1] + step / 2, step)

    def curve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        slide, a, b = key
        pdf = pdf.sort_values("cell_id").assign(x=lambda d: d.x / units, y=lambda d: d.y / units)
        n1, n2 = int((pdf.cell_type == a).sum()), int((pdf.cell_type == b).sum())
        g = _curves(pdf, a, b, r, 2 * cell_diameter, step * 2, n_sim, seed, key) if n1 and n2 else np.full((2, len(r)), np.nan)
        low, high = np.quantile(g[1:], [(1 - confidence) / 2, (1 + confidence) / 2], axis=0)
        return pd.DataFrame({"slide_id": slide, "ct1": a, "ct2": b, "r": r, "observed": g[0], "null_mean": g[1:].mean(axis=0), "lower": low, "upper": high, "n1": n1, "n2": n2})

    return _by_pair(cells, pairs).groupBy("slide_id", "ct1", "ct2").applyInPandas(curve, "slide_id string, ct1 string, ct2 string, r double, observed double, null_mean double, lower double, upper double, n1 long, n2 long")


def g_summary(curves: DataFrame) -> DataFrame:
    """(slide_id, ct1, ct2, mean_g, max_g, min_g, r_at_max, n1, n2)."""
    return curves.groupBy("slide_id", "ct1", "ct2").agg(F.avg("observed").alias("mean_g"), F.max("observed").alias("max_g"), F.min("observed").alias("min_g"), F.max_by("r", "observed").alias("r_at_max"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
