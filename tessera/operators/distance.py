"""Distances between cells: low percentiles of blocks, floor, rescaling, the morphology filter.

A block is the cells of one slide and an ordered pair of types; within a type both directions count
and a cell is not paired with itself.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.material import materialized
from tessera.functions.quantiles import exact_quantile
from tessera.operators.cells import coordinates
from tessera.operators.neighbors import distance, hops, knn_graph, range_join

BLOCK = ["slide_id", "ct1", "ct2"]
#: Slides have to have more cells of a type than this for a block, where there are several slides.
FEW = 5


def blocks(cells: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(slide_id, ct1, ct2, n1, n2, n_pairs, p) of the blocks that are used; p is the share of the low percentile."""
    sizes = cells.groupBy("slide_id", "cell_type").agg(F.count("*").alias("n"))
    several = cells.select("slide_id").distinct().count() > 1
    wanted = cells.sparkSession.createDataFrame(pairs, "ct1 string, ct2 string")
    one = sizes.select("slide_id", F.col("cell_type").alias("ct1"), F.col("n").alias("n1"))
    two = sizes.select("slide_id", F.col("cell_type").alias("ct2"), F.col("n").alias("n2"))
    found = one.join(two, "slide_id").join(F.broadcast(wanted), ["ct1", "ct2"]).where((F.col("n1") > (FEW if several else 0)) & (F.col("n2") > (FEW if several else 0)))
    self_block = F.col("ct1") == F.col("ct2")
    n_pairs = F.when(self_block, F.col("n1") * (F.col("n1") - 1)).otherwise(F.col("n1") * F.col("n2"))
    p = F.when(self_block, F.lit(1e-4)).otherwise(F.least(F.lit(1e-3), 2 / F.greatest("n1", "n2")))
    return found.select(*BLOCK, "n1", "n2", n_pairs.alias("n_pairs"), p.alias("p"))


def block_pairs(cells: DataFrame, pairs: list[tuple[str, str]], radius: float) -> DataFrame:
    """(slide_id, ct1, ct2, i, j, d) within radius, raw distances, of the wanted pairs of types."""
    left = cells.where(F.col("cell_type").isin(sorted({a for a, _ in pairs})))
    right = cells.where(F.col("cell_type").isin(sorted({b for _, b in pairs})))
    found = range_join(left, right, radius, same=any(a == b for a, b in pairs))
    keep = F.lit(False)
    for a, b in pairs:
        keep = keep | ((F.col("ct1") == a) & (F.col("ct2") == b))
    return found.where(keep)


def low_percentiles(cells: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(slide_id, ct1, ct2, d_min, low): the smallest distance over 0 and the low percentile of each block.

    A distance of 0 counts as d_min. Only the smallest distances are enumerated: the radius of the
    range join grows until every block has as many as its percentile needs.
    """
    of = materialized(blocks(cells, pairs))
    rows = of.collect()  # a row for each slide and pair of types
    if not rows:
        return of.select(*BLOCK, F.lit(0.0).alias("d_min"), F.lit(0.0).alias("low"))
    dims = coordinates(cells)
    extent = cells.agg(*[(F.max(c) - F.min(c)).alias(c) for c in dims]).first()
    widest = math.sqrt(sum((extent[c] or 0.0) ** 2 for c in dims)) or 1.0
    share = max((math.floor((r.n_pairs - 1) * r.p) + 2) / max(r.n_pairs, 1) for r in rows)
    radius = min(widest, 1.5 * widest * share ** (1 / len(dims)))
    need = {(r.slide_id, r.ct1, r.ct2): min(math.floor((r.n_pairs - 1) * r.p) + 2, r.n_pairs) for r in rows}
    while True:
        near = materialized(block_pairs(cells, pairs, radius))
        counts = {(r.slide_id, r.ct1, r.ct2): (r.n, r.least) for r in near.groupBy(*BLOCK).agg(F.count("*").alias("n"), F.max("d").alias("least")).collect()}
        if radius >= widest or all(counts.get(b, (0, 0))[0] >= n and counts.get(b, (0, 0))[1] > 0 for b, n in need.items()):
            break
        radius = min(widest * 1.000001, radius * 2)
    near = near.join(F.broadcast(of.select(*BLOCK, "n_pairs", "p")), BLOCK)
    least = near.where("d > 0").groupBy(*BLOCK).agg(F.min("d").alias("d_min"))
    near = near.join(F.broadcast(least), BLOCK).withColumn("d", F.greatest("d", "d_min"))
    low = exact_quantile(near, [*BLOCK, "n_pairs", "p", "d_min"], "d", F.col("p"), F.col("n_pairs"), "low")
    return low.select(*BLOCK, "d_min", "low")


def scale_factor(lows: DataFrame, target: float = 0.01) -> float:
    """target over the smallest low percentile of all blocks of all slides."""
    least = lows.where("low > 0").agg(F.min("low").alias("m")).first().m
    return target / least if least else 1.0


def distance_pairs(cells: DataFrame, pairs: list[tuple[str, str]], reach: float | None, normalize: bool = True, target: float = 0.01, truncate: bool = True, scales: dict[str, float] | None = None) -> tuple[DataFrame, float]:
    """(slide_id, ct1, ct2, i, j, d) up to the rescaled distance `reach` (None: all pairs), and the scale factor.

    Zero distances become the block's smallest other; with truncate those under the block's low
    percentile become it; with normalize all are multiplied so that the smallest low percentile of all
    blocks is target. scales multiplies coordinates by axis first.
    """
    for c, by in (scales or {}).items():
        if by <= 0:
            raise ValueError("scales are over 0")
        cells = cells.withColumn(c, F.col(c) * by)
    lows = materialized(low_percentiles(cells, pairs))
    scale = scale_factor(lows, target) if normalize else 1.0
    if reach is None:
        found = all_pairs(cells, pairs)
    else:
        found = block_pairs(cells, pairs, reach / scale * (1 + 1e-9))
    found = found.join(F.broadcast(lows), BLOCK)
    d = F.greatest(F.col("d"), F.col("d_min"), *([F.col("low")] if truncate else []))
    return found.select(*BLOCK, "i", "j", (d * scale).alias("d")), scale


def all_pairs(cells: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Every pair of the wanted blocks: for the morphology filter and small tables only."""
    dims = coordinates(cells)
    keep = F.lit(False)
    for a, b in pairs:
        keep = keep | ((F.col("a.cell_type") == a) & (F.col("b.cell_type") == b))
    both = cells.alias("a").join(cells.alias("b"), (F.col("a.slide_id") == F.col("b.slide_id")) & (F.col("a.cell_id") != F.col("b.cell_id")) & keep)
    return both.select(F.col("a.slide_id"), F.col("a.cell_type").alias("ct1"), F.col("b.cell_type").alias("ct2"), F.col("a.cell_id").alias("i"), F.col("b.cell_id").alias("j"), distance(dims).alias("d"))


def morphology_fit(cells: DataFrame, distances: DataFrame, k: int = 10, threshold: float = 10) -> tuple[DataFrame, DataFrame]:
    """distances with hops on the slide's graph of k nearest cells (null: further than threshold), and (slide_id, ct1, ct2, n, slope, intercept, r2) of straight-line distance by hops."""
    graph = hops(knn_graph(cells, k), math.floor(threshold))
    both = distances.join(graph, ["slide_id", "i", "j"], "left")
    fit = both.where(F.col("hops") <= threshold).groupBy(*BLOCK).agg(F.count("*").alias("n"), F.regr_slope("d", "hops").alias("slope"), F.regr_intercept("d", "hops").alias("intercept"), F.regr_r2("d", "hops").alias("r2"))
    return both, fit


def morphology_filter(cells: DataFrame, distances: DataFrame, k: int = 10, threshold: float = 10, cutoff: float = 7) -> DataFrame:
    """Distances where pairs that are near in space but far on the tissue get the block's largest distance.

    Far: more than threshold hops. Near: closer than what the fit gives for cutoff hops. A block with
    fewer than 10 pairs to fit stays as it is.
    """
    both, fit = morphology_fit(cells, distances, k, threshold)
    most = distances.groupBy(*BLOCK).agg(F.max("d").alias("_most"))
    both = both.join(F.broadcast(fit), BLOCK, "left").join(F.broadcast(most), BLOCK)
    wrong = F.col("hops").isNull() & (F.col("n") >= 10) & (F.col("d") < F.col("intercept") + F.col("slope") * cutoff)
    return both.select(*BLOCK, "i", "j", F.when(F.coalesce(wrong, F.lit(False)), F.col("_most")).otherwise(F.col("d")).alias("d"))
