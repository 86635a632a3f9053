"""Rules at the edges: isolated cells, slides without variation, ids that several slides share, cuts, pools."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cca, cells as cell_ops, correlation, distance, inference, kernel, resample

TRIPLETS = "sigma double, slide_id string, ct1 string, ct2 string, i long, j long, k double"
SCORES = "sigma double, slide_id string, cell_type string, cell_id long, cc int, score double"


def test_isolated_cells_are_smoothed_to_0(spark):
    k = spark.createDataFrame([(0.1, "s", "a", "b", 1, 11, 0.5), (0.1, "s", "a", "b", 1, 12, 0.25)], TRIPLETS)
    scores = spark.createDataFrame([(0.1, "s", t, c, 1, v) for t, c, v in [("a", 1, 9.0), ("a", 2, 9.0), ("b", 11, 3.0), ("b", 12, 6.0)]], SCORES)
    assert {r.i: r.smooth for r in correlation.neighbor_average(k, scores).collect()} == {1: 4.0, 2: 0.0}


def test_slides_without_variation_leave_the_mean(spark):
    rows, cells = [], []
    for slide, flat in (("s", False), ("t", True)):
        for c in range(4):
            rows += [(0.1, slide, "a", "b", c, 10 + c, 1.0)]
            cells += [(0.1, slide, "a", c, 1, 1.0 if flat else float(c)), (0.1, slide, "b", 10 + c, 1, float(c))]
    k, scores = spark.createDataFrame(rows, TRIPLETS), spark.createDataFrame(cells, SCORES)
    got = correlation.bidirectional_correlation(k, scores)
    values = {r.slide_id: r.bidir for r in got.collect()}
    assert values["t"] is None and abs(values["s"] - 1) < 1e-12
    assert abs(correlation.mean_over_slides(got, "bidir").first().bidir - 1) < 1e-12
    assert {r.slide_id: r.bidir for r in correlation.bidirectional_correlation(k, scores, no_variation=0.0).collect()}["t"] == 0.0


def test_operators_of_shared_ids(spark, monkeypatch):
    """Slides with the same cell ids, cells without scores: both ways of finding scores give the dense products."""
    rng = np.random.default_rng(2)
    triplets = [(0.1, s, "a", "b", int(i), int(j), float(v)) for s in ("s", "t") for i, j, v in zip(rng.integers(0, 20, 200), rng.integers(20, 41, 200), rng.uniform(size=200))]
    scores = {(s, c): rng.normal(size=3) for s in ("s", "t") for c in range(40)}
    table = spark.createDataFrame([(s, "a" if c < 20 else "b", c, [float(x) for x in v]) for (s, c), v in scores.items()], "slide_id string, cell_type string, cell_id long, pc array<double>")
    k = spark.createDataFrame(triplets, TRIPLETS)
    for limit in (cca.BROADCAST_BYTES, 0):
        monkeypatch.setattr(cca, "BROADCAST_BYTES", limit)
        got = cca.operators(k, table)[0.1]
        for s in ("s", "t"):
            want = sum(v * np.outer(scores[s, i], scores[s, j]) for _, t, _, _, i, j, v in triplets if t == s and (s, j) in scores)
            assert np.allclose(got[s]["a", "b"], want)


@pytest.mark.parametrize("dims", [2, 3])
def test_slides_are_cut_until_parts_are_small(spark, dims):
    rng = np.random.default_rng(5)
    place = lambda: {"x": rng.uniform(0, 9), "y": rng.uniform(0, 1), "z": rng.uniform(0, 5)}
    rows = [(k, "big" if k < 1000 else "one" if k < 1040 else "spot", *((list(place().values()))[:dims] if k < 1040 else [1.0] * dims)) for k in range(1400)]
    df = spark.createDataFrame([(*r, "t", [0.0]) for r in rows], "cell_id long, slide_id string, " + ", ".join(f"{c} double" for c in "xyz"[:dims]) + ", cell_type string, features array<double>")
    got = cell_ops.partition_slides(df, 100).cache()
    sizes = {r.slide_id: r["count"] for r in got.groupBy("slide_id").count().collect()}
    assert sum(sizes.values()) == 1400 and max(sizes.values()) <= 100 and sizes["one"] == 40
    assert sum(s.startswith("big_blk") for s in sizes) == 16 and got.columns == df.columns
    if dims == 2:  # compact parts, not strips over the whole height of the wide slide
        spans = got.where("slide_id like 'big%'").groupBy("slide_id").agg((F.max("x") - F.min("x")).alias("w")).collect()
        assert max(r.w for r in spans) < 3


def test_pool_stops_when_there_are_enough(monkeypatch):
    """A bin takes its target's neighbours one by one, not all of them."""
    x = np.array([0.0, 0.1, 0.2, 0.3, 5.0, 9.0, 9.1, 9.2, 10.0, 5.1, 5.2, 5.3])
    y = np.zeros(12)
    pools = []

    class Draws:
        def permutation(self, n):
            return np.roll(np.arange(n), 1)

        def choice(self, pool, n, replace):
            pools.append((len(pool), n, replace))
            return pool[:n]

    resample._resampled(x, y, 12, 1, Draws(), False)
    members = np.unique(np.clip(np.ceil(x / 10 * 12), 1, 12).astype(int), return_counts=True)[1]
    assert all(p >= n or r for p, n, r in pools) and max(p for p, _, _ in pools) <= members.max() * 2


def test_lookup_of_distances_and_default_sigma(spark):
    rng = np.random.default_rng(7)
    rows = [(k, "s", f"t{k % 2}", float(rng.uniform()), float(rng.uniform()), [0.0]) for k in range(40)]
    df = spark.createDataFrame(rows, "cell_id long, slide_id string, cell_type string, x double, y double, features array<double>")
    d, _ = distance.distance_pairs(df, [("t0", "t1")], None)
    back = {(r.i, r.j): r.d for r in kernel.lookup(d, None, "t1", "t0").collect()}
    assert back == {(r.j, r.i): r.d for r in d.collect()} and kernel.lookup(d, None, "t0", "t1").count() == 400
    with pytest.raises(ValueError):
        kernel.lookup(d, None, "t0", "t9")
    assert abs(kernel.default_sigma(d, ("t0", "t1")) - np.quantile([r.d for r in d.collect()], 0.05)) < 1e-12


def test_permutations_take_one_slide(spark):
    k = spark.createDataFrame([(0.1, s, "a", "b", 1, 2, 0.5) for s in ("s", "t")], TRIPLETS)
    with pytest.raises(ValueError, match="one slide"):
        inference.Problem(None, None, k, None, ("a", "b"))
