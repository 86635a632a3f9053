"""Reading and writing cell tables and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cells(spark: SparkSession, path: str, columns: dict[str, str] | None = None, format: str = "parquet", features: list[str] | None = None) -> DataFrame:
    """Cells from Parquet, CSV or JSON. columns maps our names to the file's; features lists columns that become the features array."""
    raw = spark.read.options(header=True, inferSchema=True).csv(path) if format == "csv" else spark.read.format(format).load(path)
    columns = {c: c for c in ("cell_id", "slide_id", "cell_type", "x", "y", "z", "features") if c in raw.columns} | (columns or {})
    picked = [F.col(old).alias(new) for new, old in columns.items() if not (features and new == "features")]
    if features:
        picked.append(F.array(*[F.col(c).cast("double") for c in features]).alias("features"))
    cells = raw.select(*picked)
    return cells if "slide_id" in cells.columns else cells.withColumn("slide_id", F.lit("slide1"))


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """Parquet partitioned by columns, rows of a partition together."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """User-made distances: slide_id, ct1, ct2, i, j, d. Negative or missing ones raise ValueError."""
    found = spark.read.parquet(path).select("slide_id", "ct1", "ct2", "i", "j", "d")
    if not found.where("d is null or isnan(d) or d < 0").isEmpty():
        raise ValueError("distances are numbers of 0 or more")
    return found
