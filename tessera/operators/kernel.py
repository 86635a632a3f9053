"""Gaussian kernels between cells as triplets (sigma, slide_id, ct1, ct2, i, j, k)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.material import materialized
from tessera.functions.quantiles import exact_quantile
from tessera.operators.distance import BLOCK, blocks, distance_pairs

KEYS = ["sigma", *BLOCK]
LOWER = 1e-7


def reach(sigma: float, lower: float = LOWER) -> float:
    """Distance beyond which the kernel is under the lower limit."""
    return sigma * math.sqrt(-2 * math.log(lower))


def kernel_of(d: Column, sigma: Column) -> Column:
    return F.exp(-0.5 * (d / sigma) * (d / sigma))


def kernel_from_distances(distances: DataFrame, sigmas: list[float], lower: float = LOWER) -> DataFrame:
    """Kernel values of at least the lower limit, for each sigma, of distances enumerated once."""
    each = distances.withColumn("sigma", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    return each.select(*KEYS, "i", "j", kernel_of(F.col("d"), F.col("sigma")).alias("k")).where(F.col("k") >= lower)


def sigma_guard(kernel: DataFrame, of: DataFrame, lower: float = LOWER, least_neighbors: float = 2, every_block: bool = False) -> list[float]:
    """The sigmas that are dense enough: cells have `least_neighbors` on average.

    With one slide a sigma goes if any block is too sparse; with several if all blocks are, unless
    every_block.
    """
    counts = kernel.where(F.col("k") > lower).groupBy(*KEYS).agg(F.count("*").alias("n"))
    sigmas = kernel.select("sigma").distinct()
    both = sigmas.crossJoin(F.broadcast(of)).join(counts, KEYS, "left")
    total = F.col("n1") * F.col("n2")
    valid = F.coalesce(F.col("n"), F.lit(0)) / total >= least_neighbors * F.least("n1", "n2") / total
    several = of.select("slide_id").distinct().count() > 1
    agree = F.bool_or if several and not every_block else F.bool_and
    rows = both.groupBy("sigma").agg(agree(valid).alias("ok")).where("ok").select("sigma").collect()  # a row for each sigma
    return sorted(r.sigma for r in rows)


def clip_upper(kernel: DataFrame, quantile: float = 0.85) -> DataFrame:
    """Values above the block's quantile become it."""
    top = exact_quantile(kernel, KEYS, "k", quantile, name="_q")
    return kernel.join(F.broadcast(top), KEYS).withColumn("k", F.least("k", "_q")).drop("_q")


def row_sums(kernel: DataFrame) -> DataFrame:
    return kernel.groupBy(*KEYS, "i").agg(F.sum("k").alias("row_sum"))


def col_sums(kernel: DataFrame) -> DataFrame:
    return kernel.groupBy(*KEYS, "j").agg(F.sum("k").alias("col_sum"))


def normalize_rows(kernel: DataFrame, lower: float = LOWER) -> DataFrame:
    """Rows divided by their sums where these are over 1e-4; then values under the lower limit go."""
    both = kernel.join(row_sums(kernel), [*KEYS, "i"])
    return both.withColumn("k", F.when(F.col("row_sum") > 1e-4, F.col("k") / F.col("row_sum")).otherwise(F.col("k"))).drop("row_sum").where(F.col("k") >= lower)


def normalize_cols(kernel: DataFrame, lower: float = LOWER) -> DataFrame:
    both = kernel.join(col_sums(kernel), [*KEYS, "j"])
    return both.withColumn("k", F.when(F.col("col_sum") > 1e-4, F.col("k") / F.col("col_sum")).otherwise(F.col("k"))).drop("col_sum").where(F.col("k") >= lower)


def normalize_global(kernel: DataFrame, lower: float = LOWER) -> DataFrame:
    """Values divided by the median of the block's row sums over 1e-5."""
    middle = exact_quantile(row_sums(kernel).where("row_sum > 1e-5"), KEYS, "row_sum", 0.5, name="_m")
    return kernel.join(F.broadcast(middle), KEYS).withColumn("k", F.col("k") / F.col("_m")).drop("_m").where(F.col("k") >= lower)


def gaussian_kernel(
    cells: DataFrame, sigmas: list[float], pairs: list[tuple[str, str]], lower: float = LOWER, upper_quantile: float | None = 0.85, normalize: str | None = None,
    least_neighbors: float | None = 2, normalize_distance: bool = True, target: float = 0.01, truncate: bool = True, single_precision: bool = False, scales: dict[str, float] | None = None, every_block: bool = False,
) -> tuple[DataFrame, float, list[float]]:
    """Kernel triplets, the distances' scale factor and the sigmas that pass the guard.

    Neighbours are enumerated once, at the largest sigma's reach, and reused for every sigma. normalize:
    None, 'global', 'row' or 'col'. single_precision keeps k as a 32-bit number.
    """
    distances, scale = distance_pairs(cells, pairs, reach(max(sigmas), lower), normalize_distance, target, truncate, scales)
    kernel = materialized(kernel_from_distances(distances, sigmas, lower))
    kept = list(sigmas)
    if least_neighbors is not None:
        kept = sigma_guard(kernel, blocks(cells, pairs).select(*BLOCK, "n1", "n2"), lower, least_neighbors, every_block)
        kernel = kernel.where(F.col("sigma").isin(kept))
    if upper_quantile is not None:
        kernel = materialized(clip_upper(kernel, upper_quantile))
    if normalize:
        kernel = {"global": normalize_global, "row": normalize_rows, "col": normalize_cols}[normalize](kernel, lower)
        kernel = materialized(kernel)
    if single_precision:
        kernel = kernel.withColumn("k", F.col("k").cast("float"))
    return kernel, scale, kept


def self_kernel(cells: DataFrame, sigmas: list[float], types: list[str], **options) -> tuple[DataFrame, float, list[float]]:
    """Kernels within each of several types, with a scale factor of their own; a sigma goes if any block is too sparse."""
    return gaussian_kernel(cells, sigmas, [(t, t) for t in types], every_block=True, **options)


def transposed(kernel: DataFrame) -> DataFrame:
    """The kernel of the reversed pair."""
    return kernel.select("sigma", "slide_id", F.col("ct2").alias("ct1"), F.col("ct1").alias("ct2"), F.col("j").alias("i"), F.col("i").alias("j"), "k")


def lookup(triplets: DataFrame, sigma: float | None, ct1: str, ct2: str, slide: str | None = None) -> DataFrame:
    """The triplets of one pair of types, of the reversed pair where only that is there; those of distances (with d, without sigma) where sigma is None."""
    of = triplets.where(((F.col("sigma") == sigma) if sigma is not None else F.lit(True)) & ((F.col("slide_id") == slide) if slide else F.lit(True)))
    forward = of.where((F.col("ct1") == ct1) & (F.col("ct2") == ct2))
    if not forward.isEmpty():
        return forward
    backward = of.where((F.col("ct1") == ct2) & (F.col("ct2") == ct1))
    if backward.isEmpty():
        raise ValueError(f"no triplets of {ct1} and {ct2}" + (f" at {sigma}" if sigma is not None else ""))
    other = {"ct1": "ct2", "ct2": "ct1", "i": "j", "j": "i"}
    return backward.select(*[F.col(other.get(c, c)).alias(c) for c in triplets.columns])


def default_sigma(distances: DataFrame, pair: tuple[str, str], quantile: float = 0.05) -> float:
    """The sigma of a kernel that is given none: the low quantile of the distances over 0 of the first pair of types. distances: of distance_pairs without a reach."""
    of = distances.where((F.col("ct1") == pair[0]) & (F.col("ct2") == pair[1]) & (F.col("d") > 0)).withColumn("_all", F.lit(1))
    found = exact_quantile(of, ["_all"], "d", quantile).first()
    if found is None:
        raise ValueError(f"no distances of {pair[0]} and {pair[1]}")
    return float(found.q)


def multiply(kernel: DataFrame, vectors: DataFrame, value: str = "v") -> DataFrame:
    """K v by row: (sigma, slide_id, ct1, ct2, i, value). vectors: slide_id, cell_id, value."""
    v = vectors.select("slide_id", F.col("cell_id").alias("j"), F.col(value).alias("_v"))
    return kernel.join(v, ["slide_id", "j"]).groupBy(*KEYS, "i").agg(F.sum(F.col("k") * F.col("_v")).alias(value))


def centered_norm(kernel: DataFrame, of: DataFrame) -> DataFrame:
    """(sigma, slide_id, ct1, ct2, norm): Frobenius norm of the doubly centred kernel, from sums alone. of: blocks with n1 and n2."""
    rows, cols = row_sums(kernel), col_sums(kernel)
    total = kernel.groupBy(*KEYS).agg(F.sum(F.col("k") * F.col("k")).alias("kk"), F.sum("k").alias("g"))
    rr = rows.groupBy(*KEYS).agg(F.sum(F.col("row_sum") * F.col("row_sum")).alias("rr"))
    cc = cols.groupBy(*KEYS).agg(F.sum(F.col("col_sum") * F.col("col_sum")).alias("cc"))
    both = total.join(rr, KEYS).join(cc, KEYS).join(F.broadcast(of.select(*BLOCK, "n1", "n2")), BLOCK)
    square = F.col("kk") - F.col("rr") / F.col("n2") - F.col("cc") / F.col("n1") + F.col("g") * F.col("g") / (F.col("n1") * F.col("n2"))
    return both.select(*KEYS, F.sqrt(F.greatest(square, F.lit(0.0))).alias("norm"))


def centered(kernel: DataFrame, of: DataFrame) -> DataFrame:
    """Row, column and grand means beside each triplet: (…, k, rm, cm, gm)."""
    rows = row_sums(kernel).join(F.broadcast(of.select(*BLOCK, "n1", "n2")), BLOCK).select(*KEYS, "i", (F.col("row_sum") / F.col("n2")).alias("rm"))
    cols = col_sums(kernel).join(F.broadcast(of.select(*BLOCK, "n1", "n2")), BLOCK).select(*KEYS, "j", (F.col("col_sum") / F.col("n1")).alias("cm"))
    grand = kernel.groupBy(*KEYS).agg(F.sum("k").alias("g")).join(F.broadcast(of.select(*BLOCK, "n1", "n2")), BLOCK).select(*KEYS, (F.col("g") / (F.col("n1") * F.col("n2"))).alias("gm"))
    return kernel.join(rows, [*KEYS, "i"]).join(cols, [*KEYS, "j"]).join(F.broadcast(grand), KEYS)
