"""Cell tables: building, validation, subsets, slides, slicing of large slides.

A cell table has cell_id, slide_id, cell_type, x, y, optionally z, and features (array<double>, one
entry for each gene of a fixed list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.material import materialized
from tessera.functions.quantiles import exact_quantile

COORDINATES = ("x", "y", "z")


def coordinates(cells: DataFrame) -> list[str]:
    return [c for c in COORDINATES if c in cells.columns]


def _spread(v: Column) -> tuple[Column, Column]:
    """Coordinates in the unit square by whole-number arithmetic, alike in any engine."""
    return ((v * v * 37 + v * 101) % 99991) / 99991.0, ((v * v * v * 11 + v * 59) % 99989) / 99989.0


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the embeddings table: two types, five slides."""
    v = F.col("vec_id").cast("bigint")
    x, y = _spread(v)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        v.alias("cell_id"), F.concat(F.lit("S"), (F.col("label") % 5).cast("string")).alias("slide_id"), F.concat(F.lit("T"), (F.col("label") % 2).cast("string")).alias("cell_type"), x.alias("x"), y.alias("y"), F.col("embedding").cast("array<double>").alias("features")
    )


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the customer table: market segments as types, nations as slides, the balance as a single feature."""
    v = F.col("c_custkey").cast("bigint")
    x, y = _spread(v)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(v.alias("cell_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("slide_id"), F.col("c_mktsegment").alias("cell_type"), x.alias("x"), y.alias("y"), F.array(F.col("c_acctbal")).alias("features"))


def new_cells(expression: DataFrame, locations: DataFrame, meta: DataFrame, slide_col: str | None = None) -> DataFrame:
    """One validated cell table of three inputs that share cell_id.

    expression: cell_id, features. locations: cell_id, x, y[, z], whatever the case of the names. meta:
    cell_id, cell_type and other columns, with the slide in slide_col. Raises ValueError on repeated
    ids, on ids that don't match in all three, on '|' in types or slides and on values that are not finite.
    """
    locations = locations.toDF(*[c.lower() if c.lower() in COORDINATES else c for c in locations.columns])
    slide = F.col(slide_col).cast("string") if slide_col else F.lit("slide1")
    meta = meta.withColumn("slide_id", slide)
    for name, part in (("expression", expression), ("locations", locations), ("meta", meta)):
        n = part.agg(F.count("*").alias("n"), F.count_distinct("cell_id").alias("d")).first()
        if n.n != n.d:
            raise ValueError(f"{name} has repeated or null cell ids")
    for name, part in (("locations", locations), ("meta", meta)):
        for a, b in ((expression, part), (part, expression)):
            if not a.join(b, "cell_id", "left_anti").isEmpty():
                raise ValueError(f"cell ids of expression and {name} don't match")
    cells = meta.join(locations.select("cell_id", *[c for c in COORDINATES if c in locations.columns]), "cell_id").join(expression.select("cell_id", "features"), "cell_id")
    validate(cells)
    return cells


def validate(cells: DataFrame) -> None:
    """Raises ValueError where names hold '|' or a coordinate or feature is null, NaN or infinite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    bad = F.lit(False)
    for c in coordinates(cells):
        bad = bad | ~finite(F.col(c))
    bad = bad | F.exists("features", lambda v: ~finite(v))
    got = cells.agg(F.sum(bad.cast("long")).alias("values"), F.sum((F.col("cell_type").contains("|") | F.col("slide_id").contains("|")).cast("long")).alias("names")).first()
    if got["values"]:
        raise ValueError(f"{got['values']} cells have values that are not finite")
    if got["names"]:
        raise ValueError("names of types and slides may not contain '|'")


def from_transposed(genes: DataFrame, gene_col: str = "gene") -> tuple[DataFrame, list[str]]:
    """Cells by genes of a table with a row for each gene and a column for each cell; and the genes in order."""
    names = [r[0] for r in genes.select(gene_col).orderBy(gene_col).collect()]
    ids = [c for c in genes.columns if c != gene_col]
    long = genes.unpivot([gene_col], ids, "cell_id", "value")
    ordered = F.sort_array(F.collect_list(F.struct(gene_col, F.col("value").cast("double").alias("value"))))
    return long.groupBy("cell_id").agg(F.transform(ordered, lambda s: s["value"]).alias("features")), names


def rename_spatial(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first two or three of the columns become x, y and z."""
    for old, new in zip(columns[:3], COORDINATES):
        df = df.withColumnRenamed(old, new)
    return df


def subset(cells: DataFrame, types: list[str], least: int = 10, by_slide: bool = False) -> DataFrame:
    """Cells of the types of interest. Raises ValueError for types that are missing or have too few cells (least, times the slides with by_slide)."""
    kept = cells.where(F.col("cell_type").isin(list(types)))
    counts = {r.cell_type: r["n"] for r in kept.groupBy("cell_type").agg(F.count("*").alias("n")).collect()}
    if missing := [t for t in types if t not in counts]:
        raise ValueError(f"types that no cell has: {', '.join(missing)}")
    need = least * (cells.select("slide_id").distinct().count() if by_slide else 1)
    if few := [t for t, n in counts.items() if n < need]:
        raise ValueError(f"types with fewer than {need} cells: {', '.join(sorted(few))}")
    return kept


def cells_per_slide_type(cells: DataFrame) -> DataFrame:
    return cells.groupBy("slide_id", "cell_type").agg(F.count("*").alias("n_cells"))


def summary(cells: DataFrame) -> DataFrame:
    """One row: cells, types, slides, features, extent."""
    return cells.agg(F.count("*").alias("n_cells"), F.count_distinct("cell_type").alias("n_types"), F.count_distinct("slide_id").alias("n_slides"), F.max(F.size("features")).alias("n_features"), *[f(c).alias(f"{c}_{n}") for c in coordinates(cells) for n, f in (("min", F.min), ("max", F.max))])


def type_pairs(cells: DataFrame, types: list[str] | None = None) -> list[tuple[str, str]]:
    """Unordered pairs of types in the order given (or by name); a single type is paired with itself."""
    types = types or [r[0] for r in cells.select("cell_type").distinct().orderBy("cell_type").collect()]
    return [(a, b) for k, a in enumerate(types) for b in types[k + 1 :]] or [(types[0], types[0])]


def partition_slides(cells: DataFrame, max_cells: int = 50_000) -> DataFrame:
    """Cells with slides of at most max_cells: a larger one is cut in two again and again, and its parts are named slide_blkN.

    Each part with too many cells is cut at the median of the coordinate that varies most within it, so
    that parts are compact in two or three dimensions and every cut halves them. Cells with one place
    in common are dealt by a hash of their ids. A slide with few enough cells keeps its name.
    """
    dims = coordinates(cells)
    at = cells.select("slide_id", "cell_id", *dims, F.lit("").alias("_part"), F.lit(False).alias("_done"))
    keys = ["slide_id", "_part"]
    while True:
        sizes = at.where("not _done").groupBy(*keys).agg(F.count("*").alias("_n"), *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"_s{c}") for c in dims])
        large = materialized(sizes.where(F.col("_n") > max_cells))
        if large.isEmpty():
            break
        widest = F.greatest(*[F.col(f"_s{c}") for c in dims])
        both = at.join(F.broadcast(large), keys, "left")
        along = F.lit(None).cast("double")
        for c in reversed(dims):
            along = F.when((F.col(f"_s{c}") == widest) & (widest > 0), F.col(c)).otherwise(along)
        both = both.withColumn("_along", F.when(F.col("_n").isNotNull(), F.coalesce(along, F.xxhash64("cell_id", F.length("_part")).cast("double"))))
        middle = exact_quantile(both.where("_along is not null"), keys, "_along", 0.5, name="_middle")
        side = F.when(F.col("_along") <= F.col("_middle"), "0").otherwise("1")
        # a cut that leaves one side empty, as most cells share a coordinate, is followed by one along a hash
        both = both.join(F.broadcast(middle), keys, "left").withColumn("_side", F.when(F.col("_along").isNotNull(), side))
        halves = both.where("_side is not null").groupBy(*keys).agg(F.count_distinct("_side").alias("_sides"))
        both = both.join(F.broadcast(halves), keys, "left")
        dealt = F.when(F.col("_sides") == 1, F.pmod(F.xxhash64("cell_id", F.length("_part")), F.lit(2)).cast("string")).otherwise(F.col("_side"))
        at = materialized(both.select("slide_id", "cell_id", *dims, F.concat("_part", F.coalesce(dealt, F.lit(""))).alias("_part"), F.col("_n").isNull().alias("_done")))
    names = at.select(*keys).distinct().withColumn("_number", F.row_number().over(Window.partitionBy("slide_id").orderBy("_part")))
    new = F.when(F.col("_part") == "", F.col("slide_id")).otherwise(F.concat_ws("_blk", "slide_id", F.col("_number").cast("string")))
    named = at.select("slide_id", "cell_id", "_part").join(F.broadcast(names), keys).select("slide_id", "cell_id", new.alias("_new"))
    return cells.join(named, ["slide_id", "cell_id"]).withColumn("slide_id", F.col("_new")).select(*cells.columns)


def outliers(df: DataFrame, value: str, keys: list[str], threshold: float, method: str = "zscore") -> DataFrame:
    """df with value null where it lies more than threshold standard deviations, or quartile ranges beyond the quartiles, from its group."""
    if method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
        out = F.abs(F.col(value) - F.col("_m")) > threshold * F.col("_s")
    elif method == "iqr":
        stats = exact_quantile(df, keys, value, 0.25, name="_m").join(exact_quantile(df, keys, value, 0.75, name="_s"), keys)
        out = (F.col(value) < F.col("_m") - threshold * (F.col("_s") - F.col("_m"))) | (F.col(value) > F.col("_s") + threshold * (F.col("_s") - F.col("_m")))
    else:
        raise ValueError("method is zscore or iqr")
    return df.join(stats, keys).withColumn(value, F.when(~F.coalesce(out, F.lit(False)), F.col(value))).drop("_m", "_s")
