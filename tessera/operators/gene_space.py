"""Axes directly on genes over several slides: the mean of the slides' correlations is made as large as it gets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.material import materialized
from tessera.functions.quantiles import exact_quantile
from tessera.operators.cca import Pair, operators
from tessera.operators.resample import generator

#: Slides with fewer cells of any type are left out.
LEAST_CELLS = 10
#: Genes up to which gene by gene operators are formed (8 bytes a cell of them, for each slide and pair).
MOST_GENES = 2_000


def prevalence(long: DataFrame, clip: float | None = 0.98, least_prevalence: float = 0.008, least_cells: int = 20) -> DataFrame:
    """(gene, share, cells, top) of the genes above 0 in enough of all cells; top: the clip quantile of a gene's positive values. long: gene, v."""
    of = long.groupBy("gene").agg(F.avg((F.col("v") > 0).cast("double")).alias("share"), F.sum((F.col("v") > 0).cast("long")).alias("cells"))
    top = exact_quantile(long.where("v > 0"), ["gene"], "v", clip if clip is not None else 1.0, name="top")
    return of.where((F.col("share") >= least_prevalence) & (F.col("cells") >= least_cells)).join(top, "gene")


def clipped(long: DataFrame, kept: DataFrame) -> DataFrame:
    """The values of the genes in kept, those above a gene's top become it."""
    return long.join(F.broadcast(kept), "gene").withColumn("v", F.least("v", "top"))


def prepare_genes(cells: DataFrame, clip: float | None = 0.98, least_prevalence: float = 0.008, least_cells: int = 20) -> tuple[DataFrame, list[int]]:
    """Cells with features of the genes in use, clipped and standardised within slide and type; and those genes.

    A gene is used where it is above 0 in enough of all cells. Values above the gene's `clip` quantile of
    its positive values become that; what doesn't vary becomes 0. Slides that lack cells of a type go.
    """
    types = cells.select("cell_type").distinct().count()
    sizes = cells.groupBy("slide_id", "cell_type").agg(F.count("*").alias("n"))
    good = sizes.where(F.col("n") >= LEAST_CELLS).groupBy("slide_id").agg(F.count("*").alias("t")).where(F.col("t") == types).select("slide_id")
    used = cells.join(F.broadcast(good), "slide_id", "left_semi")
    long = used.select("slide_id", "cell_type", "cell_id", F.posexplode("features").alias("gene", "v"))
    kept = materialized(prevalence(long, clip, least_prevalence, least_cells))
    genes = [r.gene for r in kept.select("gene").orderBy("gene").collect()]  # a row for each gene
    used_values = clipped(long, kept)
    stats = used_values.groupBy("slide_id", "cell_type", "gene").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    z = used_values.join(F.broadcast(stats), ["slide_id", "cell_type", "gene"]).withColumn("z", F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0))
    rows = z.groupBy("slide_id", "cell_type", "cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("gene", "z"))), lambda x: x["z"]).alias("features"))
    return rows.join(cells.drop("features", "cell_type"), ["slide_id", "cell_id"]), genes


class GeneOperators:
    """Covariances across types (by slide) and within types of standardised genes."""

    def __init__(self, cells: DataFrame, kernel: DataFrame, sigma: float):
        scores = cells.select("slide_id", "cell_type", "cell_id", F.col("features").alias("pc"))
        self.cross = operators(kernel.where(F.col("sigma") == sigma), scores)[sigma]
        own = cells.select("slide_id", "cell_type", F.col("cell_id").alias("i"), F.col("cell_id").alias("j"), F.lit(1.0).alias("k"), F.lit(float(sigma)).alias("sigma"))
        itself = own.select("sigma", "slide_id", F.col("cell_type").alias("ct1"), F.col("cell_type").alias("ct2"), "i", "j", "k")
        self.own = {s: {a: m for (a, _), m in of.items()} for s, of in operators(itself, scores)[sigma].items()}
        self.slides = sorted(self.cross)
        self.types = list(dict.fromkeys(t for s in self.slides for p in self.cross[s] for t in p))

    def objective(self, w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean correlation over slides and pairs, and its gradient by type."""
        total, terms = 0.0, 0
        slope = {t: np.zeros_like(w[t]) for t in self.types}
        for s in self.slides:
            for (a, b), m in self.cross[s].items():
                ca, cb = self.own[s][a], self.own[s][b]
                va, vb = w[a] @ ca @ w[a], w[b] @ cb @ w[b]
                below = np.sqrt(va * vb)
                if below <= 1e-12:
                    continue
                rho = w[a] @ m @ w[b] / below
                total += rho
                terms += 1
                slope[a] += m @ w[b] / below
                slope[b] += m.T @ w[a] / below
        return total / max(terms, 1), {t: g / max(terms, 1) for t, g in slope.items()}


def gene_space_axes(ops: GeneOperators, n_axes: int = 2, most: int = 3000, tol: float = 1e-6, seed: int = 1) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights (genes x axes) of each type and the objective of each axis.

    All types are updated from the last round's weights; later axes stay orthogonal to earlier ones; the
    sign makes the objective not negative.
    """
    size = next(iter(ops.own[ops.slides[0]].values())).shape[0]
    axes: dict[str, list[np.ndarray]] = {t: [] for t in ops.types}
    values = []
    for axis in range(n_axes):
        rng = generator(seed, axis)

        def apart(t: str, v: np.ndarray) -> np.ndarray:
            for u in axes[t]:
                v = v - u * (u @ v)
            n = np.linalg.norm(v)
            return v / n if n > 0 else v

        w = {t: apart(t, rng.standard_normal(size)) for t in ops.types}
        value, slope = ops.objective(w)
        if value < 0:
            w[ops.types[0]] = -w[ops.types[0]]
            value, slope = ops.objective(w)
        for _ in range(most):
            new = {t: apart(t, slope[t]) for t in ops.types}
            moved = max(min(np.abs(new[t] - w[t]).max(), np.abs(new[t] + w[t]).max()) for t in ops.types)
            w = new
            value, slope = ops.objective(w)
            if moved <= tol:
                break
        if value < 0:
            w[ops.types[0]] = -w[ops.types[0]]
            value = -value
        for t in ops.types:
            axes[t].append(w[t])
        values.append(value)
    return {t: np.stack(a, axis=1) for t, a in axes.items()}, values


def gene_space_cca(cells: DataFrame, kernel: DataFrame, sigma: float, n_axes: int = 2, **options) -> tuple[dict[str, np.ndarray], list[float]]:
    """Axes of prepared cells; ValueError above MOST_GENES genes."""
    width = cells.select(F.size("features").alias("n")).first().n
    if width > MOST_GENES:
        raise ValueError(f"more than {MOST_GENES} genes: choose genes or work on components")
    return gene_space_axes(GeneOperators(cells, kernel, sigma), n_axes, **options)


def gene_space_scores(cells: DataFrame, axes: dict[str, np.ndarray], sigma: float) -> DataFrame:
    """(sigma, slide_id, cell_type, cell_id, cc, score), standardised within slide and type."""
    from tessera.operators.cca import cell_scores

    raw = cell_scores(cells.select("slide_id", "cell_type", "cell_id", F.col("features").alias("pc")), {sigma: axes})
    w = Window.partitionBy("slide_id", "cell_type", "cc")
    sd = F.stddev_samp("score").over(w)
    return raw.withColumn("score", F.when(sd > 0, (F.col("score") - F.avg("score").over(w)) / sd).otherwise(0.0))


def unordered(pairs: list[Pair]) -> list[Pair]:
    return [p for p in pairs if p[0] != p[1]]
