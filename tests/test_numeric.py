"""Driver-side algebra against direct computations; no session needed."""

import numpy as np
import pandas as pd
import pytest

from tessera.functions.tails import incomplete_beta, t_two_sided
from tessera.operators import cca, inference, resample, simulate
from tessera.operators.colocalization import g_cross


def test_incomplete_beta_against_sums():
    # I_x(a, b) of whole a and b is a binomial tail
    from math import comb

    for a, b, x in [(2, 3, 0.3), (5, 1, 0.9), (4, 6, 0.5)]:
        n = a + b - 1
        assert incomplete_beta(a, b, x) == pytest.approx(sum(comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1)), rel=1e-12)


def test_t_tail_with_one_degree_is_cauchy():
    t = np.array([0.0, 1.0, 3.0])
    assert t_two_sided(t, 1) == pytest.approx(1 - 2 * np.arctan(t) / np.pi)


def test_two_types_are_singular_vectors_and_orthogonal():
    y = np.random.default_rng(1).standard_normal((6, 6))
    w = cca.solve({("a", "b"): y}, 3)
    s = np.linalg.svd(y)[1]
    assert np.abs(w["a"].T @ w["a"] - np.eye(3)).max() < 1e-10
    assert [abs(w["a"][:, k] @ y @ w["b"][:, k]) for k in range(3)] == pytest.approx(s[:3])


def test_one_type_takes_largest_eigenvalues():
    m = np.diag([1.0, -5.0, 3.0])
    w = cca.solve({("a", "a"): m}, 2)
    assert np.abs(w["a"]) == pytest.approx(np.array([[0, 1], [0, 0], [1, 0]]))


def test_metric_is_a_change_of_scale():
    rng = np.random.default_rng(2)
    y, d = rng.standard_normal((5, 5)), rng.uniform(0.5, 2, 5)
    white = cca.solve({("a", "b"): y / np.sqrt(np.outer(d, d))}, 2)
    raw = cca.solve({("a", "b"): y}, 2, metric={"a": d, "b": d})
    for t in "ab":
        for k in range(2):
            u, v = white[t][:, k], raw[t][:, k] * np.sqrt(d)
            assert min(np.abs(u - v).max(), np.abs(u + v).max()) < 1e-9


def test_three_types_reach_a_fixed_point():
    rng = np.random.default_rng(3)
    y = {p: rng.standard_normal((4, 4)) for p in [("a", "b"), ("a", "c"), ("b", "c")]}
    w = {t: m[:, 0] for t, m in cca.solve(y, 1, tol=1e-12, most=5000).items()}
    both = y | {(b, a): m.T for (a, b), m in y.items()}
    for t in "abc":
        g = sum(both[t, u] @ w[u] for u in "abc" if u != t)
        assert abs(g @ w[t]) / np.linalg.norm(g) == pytest.approx(1, abs=1e-6)


def test_deflation_removes_the_axis():
    y = {("a", "b"): np.random.default_rng(4).standard_normal((5, 5))}
    w = {t: m[:, 0] for t, m in cca.solve(y, 1).items()}
    left = cca.deflated(y, w)["a", "b"]
    assert np.abs(w["a"] @ left).max() < 1e-10 and np.abs(left @ w["b"]).max() < 1e-10
    assert np.allclose(left, cca.deflated(y, w, rank_one=True)["a", "b"])


def test_first_axis_can_be_given():
    y = {("a", "b"): np.random.default_rng(5).standard_normal((5, 5))}
    first = {"a": np.eye(5)[0], "b": np.eye(5)[1]}
    w = cca.solve(y, 2, first=first)
    assert abs(w["a"][0, 0]) == 1 and abs(w["a"][0, 1]) < 1e-10


def test_more_axes_than_components():
    with pytest.raises(ValueError):
        cca.solve({("a", "b"): np.ones((2, 2))}, 3)


def test_sign_flip_of_equal_effects():
    got = inference.replicate_test([1.0, 1.0, 1.0])
    assert got["p_value"] == 1 / 8 and got["estimate"] == 1


def test_permutations_are_reproducible_and_keep_cells():
    rng = np.random.default_rng(6)
    x, y = rng.uniform(0, 10, 80), rng.uniform(0, 10, 80)
    for method in ("global", "toroidal"):
        p = resample.permutation(x, y, method, resample.generator(1, 2))
        assert sorted(p) == list(range(80))
        assert (p == resample.permutation(x, y, method, resample.generator(1, 2))).all()
    for match in (False, True):
        p = resample.permutation(x, y, "bin", resample.generator(1, 3), 4, 4, match)
        assert len(p) == 80 and p.min() >= 0 and p.max() < 80


def test_degenerate_extent_is_identity():
    p = resample.permutation(np.zeros(5), np.zeros(5), "toroidal", resample.generator(1))
    assert list(p) == [0, 1, 2, 3, 4]


def test_quantile_matching_uses_each_candidate_once():
    a = np.random.default_rng(7).uniform(size=(10, 2))
    assert sorted(resample.match_by_quantile(a, a[::-1], 10)) == list(range(10))


def test_spectral_norm():
    k = np.random.default_rng(8).standard_normal((6, 4))
    assert simulate.spectral_norm(k, 500) == pytest.approx(np.linalg.svd(k)[1][0])


def test_orthogonal_weights_and_matching():
    w = simulate.orthogonal_weights(8, 3)
    assert np.abs(w.T @ w - np.eye(3)).max() < 1e-12
    a = np.random.default_rng(9).uniform(size=(6, 2))
    assert list(simulate.greedy_match(a, a)) == list(range(6))
    assert list(simulate.match_by_percentile(np.arange(5.0), np.arange(5.0) * 7)) == list(range(5))


def test_random_labels_are_near_one():
    rng = np.random.default_rng(10)
    p = rng.uniform(0, 100, (1500, 2))
    g = g_cross(p[:750, 0], p[:750, 1], p[750:, 0], p[750:, 1], np.array([10.0, 20.0]), 30.0, 4.0)
    assert np.abs(g - 1).max() < 0.25


def test_step_down_p_monotone():
    assert pd.Series([0.01, 0.2, 0.05]).cummax().tolist() == [0.01, 0.2, 0.2]
