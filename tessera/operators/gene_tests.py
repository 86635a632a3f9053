"""Regression of a cell score on each gene, with covariates, by least squares or with random intercepts of groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.tails import t_two_sided


def gene_glm(cells: DataFrame, scores: DataFrame, covariates: list[str] | None = None) -> DataFrame:
    """(sigma, cell_type, cc, gene, estimate, p, n): least squares of the score on 1, the gene and the covariates.

    The sums of products of all columns are aggregated by gene on the cluster; each gene's normal
    equations, of a few unknowns, are solved in tasks.
    """
    covariates = covariates or []
    both = cells.select("slide_id", "cell_type", "cell_id", "features", *covariates).join(scores, ["slide_id", "cell_type", "cell_id"])
    long = both.select("sigma", "cell_type", "cc", "score", *covariates, F.posexplode("features").alias("gene", "value"))
    columns = ["value", *covariates, "score"]
    k = len(columns)
    sums = [F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]
    products = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"p{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    keys = ["sigma", "cell_type", "cc", "gene"]
    moments = long.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products)

    def solved(frames):
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                n = r["n"]
                m = np.zeros((k + 1, k + 1))
                m[0, 0] = n
                for i in range(k):
                    m[0, i + 1] = m[i + 1, 0] = r[f"s{i}"]
                    for j in range(i, k):
                        m[i + 1, j + 1] = m[j + 1, i + 1] = r[f"p{i}_{j}"]
                xx, xy, yy, df = m[:k, :k], m[:k, k], m[k, k], n - k
                estimate = p = None
                if df > 0 and np.linalg.matrix_rank(xx) == k:
                    inverse = np.linalg.inv(xx)
                    beta = inverse @ xy
                    variance = max(yy - beta @ xy, 0) / df
                    se = np.sqrt(variance * inverse[1, 1])
                    estimate = float(beta[1])
                    p = float(t_two_sided(beta[1] / se, df)[0]) if se > 0 else 0.0
                rows.append((*(r[c] for c in keys), estimate, p, n))
            yield pd.DataFrame(rows, columns=[*keys, "estimate", "p", "n"])

    return moments.mapInPandas(solved, "sigma double, cell_type string, cc int, gene int, estimate double, p double, n long")


def gene_mixed(cells: DataFrame, scores: DataFrame, group: str = "slide_id", covariates: list[str] | None = None) -> DataFrame:
    """(sigma, cell_type, cc, gene, estimate, p, variance_ratio, n, n_groups): the score on 1, the gene and the covariates, with a random intercept for each group.

    Sums of products are aggregated by gene and group on the cluster. A gene's task gets one row of
    sums for each group, never cells, and fits the two variances by restricted likelihood; p is of a t
    with Satterthwaite's degrees of freedom. Estimate and p are null where the columns are dependent.
    """
    columns = ["value", *(covariates or []), "score"]
    k = len(columns)
    both = cells.select("slide_id", "cell_type", "cell_id", "features", F.col(group).cast("string").alias("_group"), *columns[1:-1]).join(scores, ["slide_id", "cell_type", "cell_id"])
    long = both.select("sigma", "cell_type", "cc", "score", "_group", *columns[1:-1], F.posexplode("features").alias("gene", "value"))
    sums = [F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]
    products = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"p{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    keys = ["sigma", "cell_type", "cc", "gene"]
    moments = long.groupBy(*keys, "_group").agg(F.count("*").alias("n"), *sums, *products)

    def solved(key, pdf):
        sizes = pdf["n"].to_numpy(float)
        each = np.column_stack([sizes, *(pdf[f"s{i}"] for i in range(k))])
        m = np.zeros((k + 1, k + 1))
        m[0] = m[:, 0] = each.sum(axis=0)
        for i in range(k):
            for j in range(i, k):
                m[i + 1, j + 1] = m[j + 1, i + 1] = pdf[f"p{i}_{j}"].sum()
        return pd.DataFrame([(*key, *_random_intercepts(sizes, each, m), int(sizes.sum()), len(sizes))], columns=[*keys, "estimate", "p", "variance_ratio", "n", "n_groups"])

    return moments.groupBy(*keys).applyInPandas(solved, "sigma double, cell_type string, cc int, gene int, estimate double, p double, variance_ratio double, n long, n_groups long")


def _random_intercepts(sizes: np.ndarray, each: np.ndarray, m: np.ndarray) -> tuple:
    """(estimate of column 1, p, variance of the groups over that of the rest) from sums by group and products in all; the last column is the response."""
    n, k = sizes.sum(), m.shape[0] - 1
    if n <= k or np.linalg.matrix_rank(m[:k, :k]) < k:
        return None, None, None

    def products(ratio: float) -> np.ndarray:
        """Products of all columns, weighted by the inverse of the covariance over the variance of the rest."""
        return m - (each.T * (ratio / (1 + ratio * sizes))) @ each

    def rest(w: np.ndarray) -> float:
        return max(w[k, k] - w[:k, k] @ np.linalg.solve(w[:k, :k], w[:k, k]), 1e-300)

    def deviance(rest_variance: float, group_variance: float) -> float:
        ratio = group_variance / rest_variance
        w = products(ratio)
        return (n - k) * np.log(rest_variance) + np.log1p(ratio * sizes).sum() + np.linalg.slogdet(w[:k, :k])[1] + rest(w) / rest_variance

    def profile(ratio: float) -> float:
        variance = rest(products(ratio)) / (n - k)
        return deviance(variance, ratio * variance)

    tried = np.concatenate([[0.0], np.logspace(-6, 6, 49)])
    best = int(np.argmin([profile(r) for r in tried]))
    ratio = tried[best]
    if best:
        low, high = np.log(tried[best] / 10**0.25), np.log(tried[best] * 10**0.25)
        golden = (np.sqrt(5) - 1) / 2
        for _ in range(48):
            a, b = high - golden * (high - low), low + golden * (high - low)
            low, high = (low, b) if profile(np.exp(a)) < profile(np.exp(b)) else (a, high)
        ratio = np.exp((low + high) / 2)
    w = products(ratio)
    inverse = np.linalg.inv(w[:k, :k])
    estimate, variance = float((inverse @ w[:k, k])[1]), rest(w) / (n - k)
    spread = variance * inverse[1, 1]
    # what remains of an exact fit is rounding
    if spread <= 0 or rest(w) <= 1e-12 * m[k, k]:
        return estimate, 0.0, float(ratio)
    df = n - k
    if ratio > 0:
        df = min(_satterthwaite(lambda v: v[0] * np.linalg.inv(products(v[1] / v[0])[:k, :k])[1, 1], lambda v: deviance(*v), np.array([variance, ratio * variance]), df), df)
    return estimate, float(t_two_sided(estimate / np.sqrt(spread), df)[0]), float(ratio)


def _satterthwaite(spread, deviance, at: np.ndarray, otherwise: float) -> float:
    """Degrees of freedom of an estimate's variance, from differences at the fitted variances."""
    step = 1e-3 * at
    unit = np.diag(step)
    slope = np.array([(spread(at + unit[i]) - spread(at - unit[i])) / (2 * step[i]) for i in range(2)])
    curve = np.array([[(deviance(at + unit[i] + unit[j]) - deviance(at + unit[i] - unit[j]) - deviance(at - unit[i] + unit[j]) + deviance(at - unit[i] - unit[j])) / (4 * step[i] * step[j]) for j in range(2)] for i in range(2)])
    if np.linalg.det(curve) <= 0:
        return otherwise
    noise = slope @ (2 * np.linalg.inv(curve)) @ slope
    return max(2 * spread(at) ** 2 / noise, 1.0) if noise > 0 else otherwise
