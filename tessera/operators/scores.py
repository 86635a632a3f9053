"""Gene scores, scores in place, score look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.quantiles import exact_quantile


def long_expression(cells: DataFrame) -> DataFrame:
    """(slide_id, cell_type, cell_id, gene, value); gene is the position in features."""
    return cells.select("slide_id", "cell_type", "cell_id", F.posexplode("features").alias("gene", "value"))


def regression_gene_scores(cells: DataFrame, scores: DataFrame) -> DataFrame:
    """(sigma, cell_type, gene, cc, beta): slope of each gene on the cell score; 0 where the score doesn't vary.

    Sums by type and gene in one aggregation; slopes of all axes and sigmas share the explode.
    """
    s = scores.select("slide_id", "cell_type", "cell_id", "sigma", "cc", "score")
    both = cells.select("slide_id", "cell_type", "cell_id", "features").join(s, ["slide_id", "cell_type", "cell_id"]).select("sigma", "cell_type", "cc", "score", F.posexplode("features").alias("gene", "value"))
    return both.groupBy("sigma", "cell_type", "cc", "gene").agg(F.when(F.var_pop("score") > 0, F.regr_slope("value", "score")).otherwise(0.0).alias("beta")).select("sigma", "cell_type", "gene", "cc", "beta")


def cell_scores_in_place(cells: DataFrame, scores: DataFrame, cc: int = 1) -> DataFrame:
    """Cells with their score and a label high_TYPE or low_TYPE by the type's median over all slides, unknown_TYPE without a score."""
    one = scores.where(F.col("cc") == cc).select("sigma", "slide_id", "cell_id", "score")
    middle = exact_quantile(one.join(cells.select("slide_id", "cell_id", "cell_type"), ["slide_id", "cell_id"]), ["sigma", "cell_type"], "score", 0.5, name="_m")
    both = cells.drop("features").join(one, ["slide_id", "cell_id"], "left").join(F.broadcast(middle), ["sigma", "cell_type"], "left")
    label = F.when(F.col("score").isNull(), "unknown_").when(F.col("score") > F.col("_m"), "high_").otherwise("low_")
    return both.withColumn("score_label", F.concat(label, "cell_type")).drop("_m")


def select_scores(scores: DataFrame, sigma: float | None = None, cell_type: str | None = None, slide: str | None = None, cc: int | None = None, cells: list | None = None) -> DataFrame:
    """Scores of one sigma, type, slide and axis, and of certain cells; ValueError where a cell has none."""
    for column, value in (("sigma", sigma), ("cell_type", cell_type), ("slide_id", slide), ("cc", cc)):
        if value is not None:
            scores = scores.where(F.col(column) == value)
    if cells is not None:
        wanted = scores.sparkSession.createDataFrame([(c,) for c in cells], f"cell_id {dict(scores.dtypes)['cell_id']}")
        missing = wanted.join(scores, "cell_id", "left_anti").limit(5).collect()
        if missing:
            raise ValueError(f"cells without a score: {', '.join(str(r.cell_id) for r in missing)}")
        scores = scores.join(F.broadcast(wanted), "cell_id", "left_semi")
    return scores


def standardized_by_slide(scores: DataFrame) -> DataFrame:
    """Scores with mean 0 and deviation 1 within slide, type, sigma and axis."""
    w = Window.partitionBy("sigma", "slide_id", "cell_type", "cc")
    return scores.withColumn("score", F.coalesce((F.col("score") - F.avg("score").over(w)) / F.when(F.stddev_samp("score").over(w) > 0, F.stddev_samp("score").over(w)), F.lit(0.0)))
