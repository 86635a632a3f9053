"""Exact quantiles by group without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the counting pass.
CELLS = 4096


def exact_quantile(df: DataFrame, keys: list[str], value: str, p: float | Column, total: Column | None = None, name: str = "q") -> DataFrame:
    """(keys, name): the type-7 quantile of value in each group.

    A counting pass deals each group's values into equal cells between its extremes; only the values of
    the cells that hold the two order statistics around the quantile are ranked. total is the number of
    values where df holds only the smallest of them (a column of the group's keys); else df's own count.
    p may be a column of the keys too.
    """
    p = F.lit(p) if isinstance(p, (int, float)) else p
    edges = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    edges = edges.withColumn("_h", ((total if total is not None else F.col("_n")) - 1) * p)
    edges = edges.select(*keys, "_lo", "_hi", "_h")
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS), F.lit(CELLS - 1))).otherwise(0)
    dealt = df.where(F.col(value).isNotNull()).join(F.broadcast(edges), keys).withColumn("_cell", cell.cast("int"))
    counts = dealt.groupBy(*keys, "_cell").agg(F.count("*").alias("_c"), F.first("_h").alias("_h"))
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_before", F.col("_end") - F.col("_c"))
    wanted = counts.where((F.col("_before") <= F.floor("_h") + 1) & (F.col("_end") > F.floor("_h"))).select(*keys, "_cell", "_before")
    ranked = dealt.join(F.broadcast(wanted), [*keys, "_cell"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(value)) - 1)
    low = F.max(F.when(F.col("_rank") == F.floor("_h"), F.col(value)))
    high = F.max(F.when(F.col("_rank") == F.floor("_h") + 1, F.col(value)))
    found = ranked.groupBy(*keys).agg(low.alias("_a"), high.alias("_b"), F.first("_h").alias("_h"))
    return found.select(*keys, (F.col("_a") + (F.col("_h") - F.floor("_h")) * (F.coalesce("_b", "_a") - F.col("_a"))).alias(name))
