"""Neighbour joins on points: fixed radius, nearest, k nearest, hops on a neighbour graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.material import materialized
from tessera.operators.cells import coordinates


def distance(dims: list[str], a: str = "a", b: str = "b") -> Column:
    total = F.lit(0.0)
    for c in dims:
        total = total + (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}"))
    return F.sqrt(total)


def range_join(left: DataFrame, right: DataFrame, radius: float | Column, same: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(slide_id, ct1, ct2, i, j, d, kept columns) of all pairs of a slide within radius; with same, a cell is not its own neighbour.

    Points fall into grid cells as wide as the radius and meet those of the adjoining cells by an
    equality join, so that the number of candidates follows the density, not the square of the cells.
    radius may be a column of the left table (and of the right one, by the same rule).
    """
    dims = [c for c in coordinates(left) if c in right.columns]
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    grid = lambda df: df.select("slide_id", "cell_type", "cell_id", *dims, *keep, *[F.floor(F.col(c) / r).alias(f"_{c}") for c in dims])
    a, b = grid(left), grid(right)
    for c in dims:
        a = a.withColumn(f"_{c}", F.explode(F.array(F.col(f"_{c}") - 1, F.col(f"_{c}"), F.col(f"_{c}") + 1)))
    cells = [f"_{c}" for c in dims]
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ["slide_id", *cells]]
    both = a.alias("a").join(b.alias("b"), on)
    d = distance(dims)
    limit = r if not isinstance(radius, Column) else F.col("_r")
    out = both.select(F.col("a.slide_id"), F.col("a.cell_type").alias("ct1"), F.col("b.cell_type").alias("ct2"), F.col("a.cell_id").alias("i"), F.col("b.cell_id").alias("j"), d.alias("d"), *[F.col(f"a.{c}").alias(c) for c in keep], *([radius_of(radius).alias("_r")] if isinstance(radius, Column) else [])).where(F.col("d") <= limit)
    return (out.where("i != j") if same else out).drop("_r")


def radius_of(radius: Column) -> Column:
    return radius


def knn(cells: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """(slide_id, i, j, d, rank): the k nearest other cells of each cell, ties by id.

    The search starts with a radius that holds 4 k cells on average and doubles it for the cells that
    have fewer than k within it, until the whole slide is covered.
    """
    dims = coordinates(cells)
    extent = cells.groupBy("slide_id").agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in dims]).collect()
    if not extent:
        return range_join(cells, cells, 1.0, same=True).select("slide_id", "i", "j", "d", F.lit(1).alias("rank"))
    sizes = {r.slide_id: min(k, r.n - 1) for r in extent}
    widest = max(math.sqrt(sum((r[c] or 0.0) ** 2 for c in dims)) for r in extent) or 1.0
    if radius is None:
        radius = max(max((r[c] or 0.0) for c in dims) * (4 * k / r.n / (3.14 if len(dims) == 2 else 4.19)) ** (1 / len(dims)) for r in extent) or widest
    need = F.create_map(*[F.lit(v) for s, m in sizes.items() for v in (s, m)])
    order = Window.partitionBy("slide_id", "i").orderBy("d", "j")
    left, out = cells, None
    while True:
        near = range_join(left, cells, radius, same=True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("slide_id", "i", "j", "d", "rank")
        done = near.groupBy("slide_id", "i").agg(F.count("*").alias("n")).where(F.col("n") >= need[F.col("slide_id")]).select("slide_id", F.col("i").alias("cell_id"))
        if radius > widest:
            found = near
        else:
            found = near.join(done.withColumnRenamed("cell_id", "i"), ["slide_id", "i"], "left_semi")
        out = found if out is None else out.union(found)
        if radius > widest:
            return out
        left = left.join(done, ["slide_id", "cell_id"], "left_anti")
        if left.isEmpty():
            return out
        radius *= 2


def knn_graph(cells: DataFrame, k: int = 10) -> DataFrame:
    """(slide_id, src, dst): edges both ways between each cell and its k nearest."""
    near = knn(cells, k).select("slide_id", F.col("i").alias("src"), F.col("j").alias("dst"))
    return near.union(near.select("slide_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def hops(edges: DataFrame, most: int) -> DataFrame:
    """(slide_id, i, j, hops) of pairs at most `most` hops apart on the graph, i to itself left out."""
    edges = edges.select("slide_id", F.col("src").alias("at"), F.col("dst").alias("next"))
    edges = materialized(edges)
    seen = frontier = edges.select("slide_id", F.col("at").alias("i"), F.col("next").alias("j"), F.lit(1).alias("hops")).where("i != j").distinct()
    for n in range(2, int(most) + 1):
        step = frontier.join(edges, (frontier["slide_id"] == edges["slide_id"]) & (frontier["j"] == edges["at"])).select(frontier["slide_id"], "i", F.col("next").alias("j"), F.lit(n).alias("hops")).where("i != j").distinct()
        frontier = step.join(seen.select("slide_id", "i", "j"), ["slide_id", "i", "j"], "left_anti")
        frontier = materialized(frontier)
        seen = materialized(seen.union(frontier))
    return seen


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """(slide_id, i, ct2, d): the distance from each cell of left to the nearest other cell of each type of right."""
    dims = [c for c in coordinates(left) if c in right.columns]
    out, types = None, [r[0] for r in right.select("cell_type").distinct().orderBy("cell_type").collect()]
    for t in types:
        one = right.where(F.col("cell_type") == t)
        found = _nearest_of(left, one, dims).withColumn("ct2", F.lit(t))
        out = found if out is None else out.union(found)
    return out


def _nearest_of(left: DataFrame, right: DataFrame, dims: list[str]) -> DataFrame:
    extent = left.select("slide_id", *dims).union(right.select("slide_id", *dims)).groupBy("slide_id").agg(*[(F.max(c) - F.min(c)).alias(c) for c in dims], F.count("*").alias("n")).collect()
    widest = max((math.sqrt(sum(r[c] ** 2 for c in dims)) for r in extent), default=1.0) or 1.0
    radius = max((max(r[c] for c in dims) * (8 / r.n) ** (1 / len(dims)) for r in extent), default=1.0) or widest
    out = None
    while True:
        near = range_join(left, right, radius, same=True).groupBy("slide_id", "i").agg(F.min("d").alias("d"))
        out = near if out is None else out.union(near)
        if radius > widest:
            return out
        left = left.join(near.select("slide_id", F.col("i").alias("cell_id")), ["slide_id", "cell_id"], "left_anti")
        if left.isEmpty():
            return out
        radius *= 4


def nn_cross_fraction(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(slide_id, fraction): mean of the shares of a's cells nearer to b than to a, and of b's nearer to a than to b."""
    two = cells.where(F.col("cell_type").isin(a, b))
    near = nearest(two, two).join(two.select("slide_id", F.col("cell_id").alias("i"), "cell_type"), ["slide_id", "i"])
    own = F.min(F.when(F.col("ct2") == F.col("cell_type"), F.col("d")))
    other = F.min(F.when(F.col("ct2") != F.col("cell_type"), F.col("d")))
    each = near.groupBy("slide_id", "cell_type", "i").agg(own.alias("own"), other.alias("other"))
    share = each.groupBy("slide_id", "cell_type").agg(F.avg((F.col("other") < F.col("own")).cast("double")).alias("share"))
    return share.groupBy("slide_id").agg(F.avg("share").alias("fraction"))
