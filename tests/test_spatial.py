"""Spatial operators against dense computations on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.quantiles import exact_quantile
from tessera.operators import cca, cells as cell_ops, correlation, distance, inference, kernel, neighbors, pca, resample, simulate, transfer


def table(spark, n=80, dims=2, slides=1, types=2, seed=1, genes=6):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        p = [float(v) for v in rng.uniform(0, 1, dims)]
        rows.append((k, f"s{k % slides}", f"t{k % types}", *p, [float(v) for v in rng.normal(2, 1, genes)]))
    axes = ", ".join(f"{c} double" for c in "xyz"[:dims])
    return spark.createDataFrame(rows, f"cell_id long, slide_id string, cell_type string, {axes}, features array<double>"), rows


def brute(rows, dims, radius):
    out = {}
    for a in rows:
        for b in rows:
            if a[0] != b[0] and a[1] == b[1]:
                d = math.sqrt(sum((a[3 + k] - b[3 + k]) ** 2 for k in range(dims)))
                if d <= radius:
                    out[a[0], b[0]] = d
    return out


@pytest.mark.parametrize("dims,radius", [(2, 0.25), (3, 0.45)])
def test_range_join_is_the_theta_join(spark, dims, radius):
    df, rows = table(spark, 80, dims, slides=2)
    got = {(r.i, r.j): r.d for r in neighbors.range_join(df, df, radius, same=True).collect()}
    want = brute(rows, dims, radius)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_coincident_and_empty(spark):
    df, _ = table(spark, 6)
    same = df.withColumn("x", F.lit(0.5)).withColumn("y", F.lit(0.5))
    assert neighbors.range_join(same, same, 0.1, same=True).count() == 30
    assert neighbors.range_join(df.where("false"), df, 0.1).count() == 0


def test_knn(spark):
    df, rows = table(spark, 60)
    got = {}
    for r in neighbors.knn(df, 3).collect():
        got.setdefault(r.i, []).append((r.rank, r.j))
    pairs = brute(rows, 2, 9)
    for i in range(60):
        want = sorted((d, j) for (a, j), d in pairs.items() if a == i)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_exact_quantile(spark):
    rng = np.random.default_rng(3)
    values = {g: rng.normal(size=n) for g, n in (("a", 1), ("b", 2), ("c", 5000))}
    values["d"] = np.array([1.0] * 50 + [2.0] * 50)
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    for p in (0.0, 0.001, 0.37, 0.85, 1.0):
        got = {r.g: r.q for r in exact_quantile(df, ["g"], "v", p).collect()}
        assert got == pytest.approx({g: float(np.quantile(vs, p)) for g, vs in values.items()}, abs=1e-12)


@pytest.fixture(scope="module")
def fitted(spark):
    df = simulate.smooth_cells(spark, 120, 12, slides=1, strength=2.0).cache()
    of = pca.fit_pca(df, 5)
    scores = pca.project(df, of).cache()
    k, scale, kept = kernel.gaussian_kernel(df, [0.05, 0.1], [("TypeA", "TypeB")])
    return df, of, scores, k.cache(), scale, kept


def dense(df, k, sigma):
    rows = df.select("cell_id", "cell_type").orderBy("cell_id").collect()
    a = [r.cell_id for r in rows if r.cell_type == "TypeA"]
    b = [r.cell_id for r in rows if r.cell_type == "TypeB"]
    m = np.zeros((len(a), len(b)))
    for r in k.where(F.col("sigma") == sigma).collect():
        m[a.index(r.i), b.index(r.j)] = r.k
    return a, b, m


def test_kernel_by_its_definition(fitted):
    df, _, _, k, scale, kept = fitted
    rows = {r.cell_id: r for r in df.collect()}
    a, b, m = dense(df, k, kept[0])
    d = np.array([[math.dist((rows[i].x, rows[i].y), (rows[j].x, rows[j].y)) for j in b] for i in a])
    low = np.quantile(d, min(1e-3, 2 / max(d.shape)))
    assert scale == pytest.approx(0.01 / low)
    want = np.exp(-0.5 * (np.maximum(d, low) * scale / kept[0]) ** 2)
    want[want < 1e-7] = 0
    want = np.minimum(want, np.quantile(want[want > 0], 0.85))
    assert np.abs(m - want).max() < 1e-9


def test_axes_operator_and_correlation(fitted):
    df, of, scores, k, _, kept = fitted
    sigma = kept[0]
    a, b, m = dense(df, k, sigma)
    x = {r.cell_id: np.array(r.pc) for r in scores.collect()}
    xa, xb = np.array([x[i] for i in a]), np.array([x[j] for j in b])
    y = cca.operators(k, scores)
    assert np.abs(y[sigma]["S0"]["TypeA", "TypeB"] - xa.T @ m @ xb).max() < 1e-8
    w = cca.kernel_cca(y, 2).weights
    norms = kernel.centered_norm(k, distance.blocks(df, [("TypeA", "TypeB")]))
    got = {(r.sigma, r.cc): r.ncorr for r in correlation.normalized_correlation(correlation.correlation_parts(k, cca.cell_scores(scores, w), norms)).collect()}
    centred = m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    for cc in range(2):
        u, v = xa @ w[sigma]["TypeA"][:, cc], xb @ w[sigma]["TypeB"][:, cc]
        assert got[sigma, cc + 1] == pytest.approx(u @ m @ v / (np.linalg.norm(u) * np.linalg.norm(v) * np.linalg.norm(centred)))
    # the planted pattern is found
    truth = {r.cell_id: r.spatial_score for r in df.collect()}
    assert abs(np.corrcoef(xa @ w[sigma]["TypeA"][:, 0], [truth[i] for i in a])[0, 1]) > 0.8


def test_pca_is_the_svd(fitted):
    df, of, *_ = fitted
    x = np.array([r.features for r in df.where("cell_type = 'TypeA'").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    s = np.linalg.svd(z - z.mean(0), compute_uv=False) / np.sqrt(len(z) - 1)
    assert of["TypeA"].sdev == pytest.approx(s[:5])


def test_permutations_and_conditional_test(spark, fitted):
    df, _, scores, k, _, _ = fitted
    norms = kernel.centered_norm(k, distance.blocks(df, [("TypeA", "TypeB")]))
    problem = inference.Problem(scores, df, k, norms, ("TypeA", "TypeB"))
    y = cca.operators(k, scores)
    for sigma in y:
        assert np.abs(problem.y(sigma, problem.x) - y[sigma]["S0"]["TypeA", "TypeB"]).max() < 1e-8
    got = inference.conditional_test(spark, problem, cca.kernel_cca(y, 2).weights, 19, method="global").orderBy("cc").collect()
    assert got[0].p_raw == pytest.approx(0.05) and got[0].p_stepdown <= got[1].p_stepdown
    fair = inference.fair_sigma(inference.permuted_statistics(spark, problem, 8, method="toroidal"))
    assert fair.count() == 8


def test_permutations_of_a_large_kernel_give_the_same(spark, fitted, monkeypatch):
    df, _, scores, k, _, _ = fitted
    norms = kernel.centered_norm(k, distance.blocks(df, [("TypeA", "TypeB")]))
    weights = cca.kernel_cca(cca.operators(k, scores), 2).weights
    small = inference.Problem(scores, df, k, norms, ("TypeA", "TypeB"))
    monkeypatch.setattr(inference, "TRIPLETS", 100)
    large = inference.Problem(scores, df, k, norms, ("TypeA", "TypeB"))
    assert small.large is None and large.large is not None and not large.kernels
    for options in ({"n_axes": 2, "observed": weights}, {"method": "toroidal", "which": "both"}):
        a, b = ({(r.perm_id, r.sigma, r.cc): r.stat for r in inference.permuted_statistics(spark, p, 5, **options).collect()} for p in (small, large))
        assert a.keys() == b.keys() and all(abs(a[at] - b[at]) < 1e-8 for at in a)
    a, b = (inference.conditional_test(spark, p, weights, 9).orderBy("cc").collect() for p in (small, large))
    assert [r.p_raw for r in a] == [r.p_raw for r in b] and [r.observed_stat for r in a] == pytest.approx([r.observed_stat for r in b])


def test_sinkhorn_rows_sum_to_one(fitted):
    df, _, _, k, _, kept = fitted
    s = correlation.sinkhorn(k.where(F.col("sigma") == kept[-1]), most=300, tol=1e-6)
    sums = [r.row_sum for r in kernel.row_sums(s).collect()]
    assert max(abs(v - 1) for v in sums) < 1e-3


def test_validation(spark):
    df, _ = table(spark, 12)
    with pytest.raises(ValueError, match="finite"):
        cell_ops.validate(df.withColumn("x", F.when(F.col("cell_id") == 3, float("nan")).otherwise(F.col("x"))))
    with pytest.raises(ValueError, match=r"\|"):
        cell_ops.validate(df.withColumn("cell_type", F.lit("a|b")))
    with pytest.raises(ValueError, match="no cell has"):
        cell_ops.subset(df, ["t0", "nothing"], least=1)
    with pytest.raises(ValueError, match="fewer"):
        cell_ops.subset(df, ["t0"], least=7)
    e, m = df.select("cell_id", "features"), df.select("cell_id", "cell_type")
    assert cell_ops.new_cells(e, df.select("cell_id", F.col("x").alias("X"), "y"), m).count() == 12
    with pytest.raises(ValueError, match="match"):
        cell_ops.new_cells(e.where("cell_id < 5"), df.select("cell_id", "x", "y"), m)
    with pytest.raises(ValueError, match="repeated"):
        cell_ops.new_cells(e.union(e), df.select("cell_id", "x", "y"), m)


def test_quantile_normalisation_to_itself(spark):
    rows = [(k, g, float(v)) for g in range(2) for k, v in enumerate(np.random.default_rng(g).normal(size=30))]
    df = spark.createDataFrame(rows, "cell_id long, gene int, value double")
    got = {(r.cell_id, r.gene): r.value for r in transfer.quantile_normalize(df, df).collect()}
    assert got == pytest.approx({(k, g): v for k, g, v in rows})


def test_bins(spark):
    df, _ = table(spark, 50)
    binned = resample.binned(df, 5, 5).collect()
    assert {r.bx for r in binned} <= set(range(1, 6)) and len(binned) == 50
    around = resample.neighbor_bins(spark.createDataFrame([(1, 1), (3, 3)], "bx int, by int"), 5, 5)
    assert {r.bx: r["count"] for r in around.groupBy("bx").count().collect()} == {1: 4, 3: 9}


def test_entry_and_registrations():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.oracle_sql()) >= 45
