"""Registered queries do the whole tables, not a subset by id."""

import numpy as np

from tessera.operators import inference, scores
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def test_median_split_keeps_all_scores(spark):
    got = catalog.queries()["insitu_median_split"](spark, SF).collect()
    middle = {t: np.median([r.score for r in got if r.cell_type == t]) for t in ("T0", "T1")}
    assert len(got) == catalog._cells(spark, SF).count() and all(r.score is not None for r in got)
    assert all(r.score_label == ("high_" if r.score > middle[r.cell_type] else "low_") + r.cell_type for r in got if abs(r.score - middle[r.cell_type]) > 1e-5)


def test_cells_without_score_are_unknown(spark):
    cells = spark.createDataFrame([(1, "S", "T0", [0.0]), (2, "S", "T0", [0.0]), (3, "S", "T0", [0.0])], "cell_id long, slide_id string, cell_type string, features array<double>")
    given = spark.createDataFrame([(0.05, "S", 1, 1, 0.0), (0.05, "S", 2, 1, 1.0)], "sigma double, slide_id string, cell_id long, cc int, score double")
    assert {r.cell_id: r.score_label for r in scores.cell_scores_in_place(cells, given).collect()} == {1: "low_T0", 2: "high_T0", 3: "unknown_T0"}


def test_quantile_normalize_has_all_genes(spark):
    cells = catalog._cells(spark, SF)
    genes = cells.agg(catalog.F.max(catalog.F.size("features"))).first()[0]
    n = cells.where("cell_type = 'T1'").count()
    got = catalog.queries()["quantile_normalize"](spark, SF)
    assert got.count() == n * genes and got.select("gene").distinct().count() == genes


def test_transferred_scores_of_all_genes(spark):
    a, b = (np.array([r.features for r in catalog._cells(spark, SF).where(f"cell_type = '{t}'").orderBy("cell_id").collect()], float) for t in ("T0", "T1"))
    w = (np.arange(a.shape[1]) - 3) / 10
    w[np.abs(w) <= 0.05] = 0
    rank = np.array([np.searchsorted(np.sort(c), c) for c in b.T]).T
    placed = np.stack([np.interp(r / (len(b) - 1) * (len(a) - 1), np.arange(len(a)), np.sort(c)) for r, c in zip(rank.T, a.T)], axis=1)
    sd = a.std(axis=0, ddof=1)
    want = ((placed - a.mean(axis=0)) / np.where(sd < 1e-8, 1, sd)) @ w
    got = [r.score for r in catalog.queries()["transfer_scores"](spark, SF).orderBy("cell_id").collect()]
    assert np.allclose(got, want, atol=1e-5)


def test_sign_flips_of_all_nations(spark):
    got = catalog.queries()["sign_flip_exact"](spark, SF).first()
    assert got.n == spark.read.parquet(f"{SF}/customer.parquet").select("c_nationkey").distinct().count() == 25


def test_sign_flips_against_enumeration(spark):
    e = np.random.default_rng(4).normal(0.2, 1, 17)
    e[3] = e[9]
    means = (1 - 2 * ((np.arange(2**17)[:, None] >> np.arange(17)) & 1)) @ e / 17
    got = inference.sign_flips(spark.createDataFrame(list(enumerate(e.tolist())), "replicate long, effect double")).first()
    assert got.n == 17 and abs(got.mean_effect - e.mean()) < 1e-12 and got.p == (means >= e.mean() - 1e-12).mean()
