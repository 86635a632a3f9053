"""Simulated cells with smooth spatial scores, for tests of recovery and of null behaviour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.material import materialized
from tessera.operators.kernel import KEYS, row_sums
from tessera.operators.resample import generator


def _smooth(x: np.ndarray, y: np.ndarray, noise: np.ndarray, bandwidth: float) -> np.ndarray:
    d2 = (x[:, None] - x[None, :]) ** 2 + (y[:, None] - y[None, :]) ** 2
    s = np.exp(-0.5 * d2 / bandwidth**2) @ noise
    return (s - s.mean()) / s.std()


def smooth_cells(spark: SparkSession, n: int = 200, genes: int = 50, loaded: int = 10, bandwidth: float = 1.5, strength: float = 0.5, slides: int = 1, types: tuple[str, ...] = ("TypeA", "TypeB"), null: bool = False, seed: int = 42) -> DataFrame:
    """Cells in a square of side 10 with a score smooth in space that the first `loaded` genes carry; a task makes a slide.

    With null each type has a smooth score of its own, independent of the others.
    """
    def made(frames):
        for frame in frames:
            for slide in frame["slide"]:
                rng = generator(seed, slide)
                x, y = rng.uniform(0, 10, n), rng.uniform(0, 10, n)
                kind = np.array(types)[np.arange(n) % len(types)]
                truth = np.zeros(n)
                if null:
                    for t in types:
                        at = kind == t
                        truth[at] = _smooth(x[at], y[at], rng.standard_normal(at.sum()), bandwidth)
                else:
                    truth = _smooth(x, y, rng.standard_normal(n), bandwidth)
                features = rng.normal(2, 0.5, (n, genes))
                features[:, :loaded] += strength * truth[:, None]
                yield pd.DataFrame({"cell_id": [f"S{slide}_cell_{k}" for k in range(n)], "slide_id": f"S{slide}", "cell_type": kind, "x": x, "y": y, "features": list(features), "spatial_score": truth})

    return spark.range(slides, numPartitions=min(slides, 64)).withColumnRenamed("id", "slide").mapInPandas(made, "cell_id string, slide_id string, cell_type string, x double, y double, features array<double>, spatial_score double")


def uncorrelated_scores(kernel: DataFrame, scores: DataFrame, row_normalize: bool = True, least: float = 1e-10) -> DataFrame:
    """(sigma, slide_id, cell_type, cell_id, cc, score): scores of the two types of each kernel block, moved so that s1'K s2 is 0.

    Either type gives up half of the product along its neighbours' averages; the first type then gives
    up what is left. Blocks whose product or averages are below `least` keep their scores.
    """
    if row_normalize:
        kernel = kernel.join(row_sums(kernel), [*KEYS, "i"]).withColumn("k", F.when(F.col("row_sum") > least, F.col("k") / F.col("row_sum")).otherwise(F.col("k")))
    kernel = materialized(kernel.select(*KEYS, "i", "j", "k"))
    blocks = kernel.select(*KEYS).distinct()
    of = lambda kind, cell: blocks.join(scores.withColumnRenamed("cell_type", kind).withColumnRenamed("cell_id", cell), ["sigma", "slide_id", kind])
    both = [*KEYS, "cc"]

    def averaged(own: DataFrame, cell: str, others: DataFrame, other: str) -> DataFrame:
        """own with a column: the kernel's sum of the others' scores."""
        along = kernel.join(others.select(*both, other, F.col("score").alias("t")), [*KEYS, other]).groupBy(*both, cell).agg(F.sum(F.col("k") * F.col("t")).alias("along"))
        return own.join(along, [*both, cell], "left").fillna(0.0, ["along"])

    def sums(side: DataFrame) -> DataFrame:
        return side.groupBy(*both).agg(F.sum(F.col("score") * F.col("along")).alias("c"), F.sum(F.col("along") * F.col("along")).alias("nn"))

    one, two = materialized(averaged(of("ct1", "i"), "i", of("ct2", "j"), "j")), materialized(averaged(of("ct2", "j"), "j", of("ct1", "i"), "i"))
    step = sums(one).join(sums(two).select(*both, F.col("nn").alias("mm")), both)
    moves = (F.abs("c") >= least) & (F.col("nn") >= least) & (F.col("mm") >= least)
    step = step.select(*both, F.when(moves, F.col("c") / 2 / F.col("nn")).otherwise(0.0).alias("a"), F.when(moves, F.col("c") / 2 / F.col("mm")).otherwise(0.0).alias("b"), moves.alias("moves"))
    moved = lambda side, cell, by: side.join(step, both, "left").select(*both, cell, "moves", (F.col("score") - F.coalesce(by, F.lit(0.0)) * F.col("along")).alias("score"))
    two = moved(two, "j", F.col("b"))
    one = materialized(averaged(moved(one, "i", F.col("a")), "i", two, "j"))
    left = sums(one).select(*both, F.when((F.abs("c") > least) & (F.col("nn") > least), F.col("c") / F.col("nn")).otherwise(0.0).alias("g"))
    one = one.join(left, both).withColumn("score", F.when(F.col("moves"), F.col("score") - F.col("g") * F.col("along")).otherwise(F.col("score")))
    return one.select("sigma", "slide_id", F.col("ct1").alias("cell_type"), F.col("i").alias("cell_id"), "cc", "score").union(two.select("sigma", "slide_id", F.col("ct2").alias("cell_type"), F.col("j").alias("cell_id"), "cc", "score"))


def orthogonal_weights(n: int, k: int, seed: int = 1) -> np.ndarray:
    """n by k weights of unit, mutually orthogonal columns."""
    q, _ = np.linalg.qr(generator(seed, "weights").standard_normal((n, k)))
    return q[:, :k]


def spectral_norm(k: np.ndarray, rounds: int = 100) -> float:
    """The largest singular value by power iteration."""
    v = np.ones(k.shape[1]) / np.sqrt(k.shape[1])
    for _ in range(rounds):
        u = k.T @ (k @ v)
        size = np.linalg.norm(u)
        if size == 0:
            return 0.0
        v = u / size
    return float(np.linalg.norm(k @ v))


def greedy_match(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each point of a an unused point of b, the closest pairs first."""
    d = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    out, used = np.full(len(a), -1), np.zeros(len(b), bool)
    for flat in np.argsort(d, axis=None, kind="stable"):
        i, j = divmod(int(flat), len(b))
        if out[i] < 0 and not used[j]:
            out[i], used[j] = j, True
    return out


def match_by_percentile(a: np.ndarray, b: np.ndarray, spread: float = 3.0) -> np.ndarray:
    """For each value of a the index of the unused value of b whose percentile is nearest; values of a beyond `spread` deviations get -1."""
    ok = np.abs(a - a.mean()) <= spread * a.std() if len(a) else np.zeros(0, bool)
    pa, pb = (pd.Series(v).rank(method="average").to_numpy() / (len(v) + 1) for v in (a, b))
    out, used = np.full(len(a), -1), np.zeros(len(b), bool)
    for k in np.flatnonzero(ok):
        d = np.where(used, np.inf, np.abs(pb - pa[k]))
        if len(d) and np.isfinite(d.min()):
            out[k] = int(d.argmin())
            used[out[k]] = True
    return out
