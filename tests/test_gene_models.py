"""Mixed models by gene and scores without cross-type products, against dense matrices."""

import numpy as np
import pytest

from tessera.functions.tails import t_two_sided
from tessera.operators import gene_tests, simulate

GENES = 3


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    sizes = [5, 9, 14, 7, 11, 3]
    group = np.repeat(np.arange(len(sizes)), sizes)
    features = rng.normal(size=(len(group), GENES))
    x = rng.uniform(size=len(group))
    score = 0.4 * features[:, 0] + x + rng.normal(size=len(sizes))[group] + rng.normal(size=len(group))
    return group, features, x, score


def _frames(spark, group, features, x, score):
    cells = spark.createDataFrame([(f"S{g}", "T0", k, [float(v) for v in f], float(a)) for k, (g, f, a) in enumerate(zip(group, features, x))], "slide_id string, cell_type string, cell_id long, features array<double>, x double")
    scores = spark.createDataFrame([(0.1, f"S{g}", "T0", k, 1, float(s)) for k, (g, s) in enumerate(zip(group, score))], "sigma double, slide_id string, cell_type string, cell_id long, cc int, score double")
    return cells, scores


def _dense(group, design, score):
    """Estimate, its p and the ratio of variances, by the restricted likelihood of the whole covariance matrix."""
    same = (group[:, None] == group[None, :]).astype(float)
    n, k = design.shape

    def parts(rest, groups):
        inverse = np.linalg.inv(rest * np.eye(n) + groups * same)
        a = design.T @ inverse @ design
        beta = np.linalg.solve(a, design.T @ inverse @ score)
        left = score - design @ beta
        return np.linalg.slogdet(rest * np.eye(n) + groups * same)[1] + np.linalg.slogdet(a)[1] + left @ inverse @ left, beta, np.linalg.inv(a)[1, 1], left @ inverse @ left

    def profile(ratio):
        rest = parts(1.0, ratio)[3] / (n - k)
        return parts(rest, ratio * rest)[0]

    low, high = 0.0, 10.0
    for _ in range(12):
        grid = np.linspace(low, high, 21)
        best = int(np.argmin([profile(r) for r in grid]))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, 20)]
    ratio = (low + high) / 2
    at = np.array([1.0, ratio]) * parts(1.0, ratio)[3] / (n - k)
    h = 1e-3 * at
    e = np.diag(h)
    slope = np.array([(parts(*(at + e[i]))[2] - parts(*(at - e[i]))[2]) / (2 * h[i]) for i in range(2)])
    curve = np.array([[sum(s * t * parts(*(at + s * e[i] + t * e[j]))[0] for s in (1, -1) for t in (1, -1)) / (4 * h[i] * h[j]) for j in range(2)] for i in range(2)])
    _, beta, spread, _ = parts(*at)
    df = min(2 * spread**2 / (slope @ (2 * np.linalg.inv(curve)) @ slope), n - k)
    return beta[1], t_two_sided(beta[1] / np.sqrt(spread), df)[0], ratio


def test_mixed_model_is_that_of_the_whole_covariance(spark, rows):
    group, features, x, score = rows
    got = {r.gene: r for r in gene_tests.gene_mixed(*_frames(spark, *rows), covariates=["x"]).collect()}
    assert len(got) == GENES
    for g in range(GENES):
        estimate, p, ratio = _dense(group, np.column_stack([np.ones(len(group)), features[:, g], x]), score)
        assert np.allclose([got[g].estimate, got[g].variance_ratio], [estimate, ratio], rtol=1e-4)
        assert np.isclose(got[g].p, p, rtol=1e-2)
        assert (got[g].n, got[g].n_groups) == (len(group), 6)


def test_mixed_model_of_dependent_columns_and_empty_tables(spark, rows):
    group, features, x, score = rows
    flat = features.copy()
    flat[:, 1] = 2.0
    cells, scores = _frames(spark, group, flat, x, score)
    got = {r.gene: r for r in gene_tests.gene_mixed(cells, scores).collect()}
    assert got[1].estimate is None and got[1].p is None and got[0].p is not None
    assert gene_tests.gene_mixed(cells, scores.limit(0)).count() == 0


def test_mixed_model_without_group_effects_is_least_squares(spark, rows):
    group, features, x, _ = rows
    score = features[:, 0] + np.random.default_rng(8).normal(size=len(group))
    for g in range(6):  # no group differs in its mean of what the first gene leaves
        score[group == g] -= (score - features[:, 0])[group == g].mean()
    frames = _frames(spark, group, features, x, score)
    mixed = {r.gene: r for r in gene_tests.gene_mixed(*frames).collect()}
    plain = {r.gene: r for r in gene_tests.gene_glm(*frames).collect()}
    assert mixed[0].variance_ratio == 0 and np.isclose(mixed[0].estimate, plain[0].estimate) and np.isclose(mixed[0].p, plain[0].p)


@pytest.mark.parametrize("row_normalize", [True, False])
def test_scores_lose_their_cross_product(spark, row_normalize):
    rng = np.random.default_rng(11)
    k = np.where(rng.uniform(size=(7, 5)) < 0.6, rng.uniform(size=(7, 5)), 0)
    k[3] = 0  # a cell without neighbours
    s1, s2 = rng.normal(size=7), rng.normal(size=5)
    kernel = spark.createDataFrame([(0.1, "S", "A", "B", i, 100 + j, float(k[i, j])) for i in range(7) for j in range(5) if k[i, j]], "sigma double, slide_id string, ct1 string, ct2 string, i long, j long, k double")
    scores = spark.createDataFrame([(0.1, "S", t, c, 1, float(v)) for t, first, s in (("A", 0, s1), ("B", 100, s2)) for c, v in enumerate(s, first)], "sigma double, slide_id string, cell_type string, cell_id long, cc int, score double")
    got = {r.cell_id: r.score for r in simulate.uncorrelated_scores(kernel, scores, row_normalize).collect()}
    assert len(got) == 12
    a, b = np.array([got[i] for i in range(7)]), np.array([got[100 + j] for j in range(5)])
    m = k / np.where(k.sum(axis=1) > 0, k.sum(axis=1), 1)[:, None] if row_normalize else k
    assert abs(a @ m @ b) < 1e-10 < abs(s1 @ m @ s2)
    along1, along2, c = m @ s2, m.T @ s1, s1 @ m @ s2
    assert np.allclose(b, s2 - c / 2 / (along2 @ along2) * along2)
    assert a[3] == s1[3]
