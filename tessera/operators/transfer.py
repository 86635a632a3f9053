"""Gene scores learned on a reference carried to other cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import correlation
from tessera.operators.kernel import centered_norm

#: Values (cells times genes) of a group that are ranked by a window; each gene is a group of its own.
LEAST_SD = 1e-8


def common_genes(reference: DataFrame, target: DataFrame) -> DataFrame:
    """(gene) in both long tables."""
    return reference.select("gene").distinct().join(target.select("gene").distinct(), "gene", "left_semi")


def quantile_normalize(reference: DataFrame, target: DataFrame) -> DataFrame:
    """target (cell_id, gene, value) with each value put at its rank's place among the reference's values of the gene.

    The share of smaller values, (rank - 1) / (n - 1) with the smallest rank for ties, is carried to the
    reference's order statistics, linear between two of them.
    """
    share = target.withColumn("_p", F.percent_rank().over(Window.partitionBy("gene").orderBy("value")))
    order = reference.select("gene", F.col("value").alias("_v"), (F.row_number().over(Window.partitionBy("gene").orderBy("value")) - 1).alias("_at"))
    n = reference.groupBy("gene").agg(F.count("value").alias("_n"))
    placed = share.join(F.broadcast(n), "gene").withColumn("_h", F.col("_p") * (F.col("_n") - 1)).withColumn("_lo", F.floor("_h"))
    low = order.select("gene", F.col("_at").alias("_lo"), F.col("_v").alias("_a"))
    high = order.select("gene", (F.col("_at") - 1).alias("_lo"), F.col("_v").alias("_b"))
    both = placed.join(low, ["gene", "_lo"]).join(high, ["gene", "_lo"], "left")
    value = F.col("_a") + (F.col("_h") - F.col("_lo")) * (F.coalesce("_b", "_a") - F.col("_a"))
    return both.select("cell_id", "gene", value.alias("value"))


def transfer_scores(reference: DataFrame, target: DataFrame, weights: DataFrame, normalize: bool = True, least_weight: float = 0.0) -> DataFrame:
    """(cell_id, cc, score) of target cells: values standardised by the reference's mean and deviation, times gene weights (gene, cc, w).

    reference and target: cell_id, gene, value of one type. Genes in both are used; deviations under
    1e-8 count as 1; weights of least_weight or less in size count as 0.
    """
    genes = common_genes(reference, target)
    reference, target = (df.join(F.broadcast(genes), "gene", "left_semi") for df in (reference, target))
    stats = reference.groupBy("gene").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    used = quantile_normalize(reference, target) if normalize else target
    z = (F.col("value") - F.col("_m")) / F.when(F.col("_s") < LEAST_SD, 1.0).otherwise(F.col("_s"))
    w = weights.where(F.abs("w") > least_weight)
    return used.join(F.broadcast(stats), "gene").join(F.broadcast(w), "gene").groupBy("cell_id", "cc").agg(F.sum(z * F.col("w")).alias("score"))


def placed_scores(parts: dict[str, DataFrame], cells: DataFrame, sigma: float) -> DataFrame:
    """(sigma, slide_id, cell_type, cell_id, cc, score) of transferred scores by cell type, as the correlations take them."""
    out = None
    for cell_type, scores in parts.items():
        one = scores.select("cell_id", "cc", "score", F.lit(cell_type).alias("cell_type"))
        out = one if out is None else out.unionByName(one)
    return out.join(cells.select("cell_id", "slide_id", "cell_type"), ["cell_id", "cell_type"]).select(F.lit(float(sigma)).alias("sigma"), "slide_id", "cell_type", "cell_id", "cc", "score")


def transferred_correlation(kernel: DataFrame, scores: DataFrame, of: DataFrame) -> DataFrame:
    """(sigma, slide_id, ct1, ct2, cc, ncorr) of transferred scores over the target's kernel; of: blocks of it."""
    return correlation.normalized_correlation(correlation.correlation_parts(kernel, scores, centered_norm(kernel, of)))


def transferred_bidirectional(kernel: DataFrame, scores: DataFrame, normalize: str = "row_or_col", row_cutoff: float | None = 5e-3, col_cutoff: float = 5e-3) -> DataFrame:
    """(sigma, slide_id, ct1, ct2, cc, bidir) of transferred scores between types; correlation.mean_over_slides aggregates it."""
    return correlation.bidirectional_correlation(kernel, scores, normalize, row_cutoff, col_cutoff)


def transferred_self_bidirectional(self_kernel: DataFrame, scores: DataFrame, normalize: str = "row_or_col", cutoff: float = 5e-3) -> DataFrame:
    """The same within types."""
    return correlation.self_bidirectional_correlation(self_kernel, scores, normalize, cutoff)
