"""A stream of slides gives what all slides at once give."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import cca, kernel, simulate
from tessera.sources import tables
from tessera.streaming.slides import SlideAccumulator


def test_stream_equals_batch(spark, tmp_path):
    """Slides of different density, a restart between them: the operators are those of one kernel over all slides."""
    pairs = [("TypeA", "TypeB")]
    cells = simulate.smooth_cells(spark, 60, 5, slides=3).withColumn("x", F.when(F.col("slide_id") == "S1", F.col("x") * 3).otherwise(F.col("x"))).cache()
    project = lambda df: df.select("slide_id", "cell_type", "cell_id", F.col("features").alias("pc"))
    whole, scale, _ = kernel.gaussian_kernel(cells, [0.2], pairs, least_neighbors=None)
    want = cca.operators(whole, project(cells))[0.2]

    def run(slides):
        for slide in slides:
            cells.where(F.col("slide_id") == slide).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = SlideAccumulator(spark, str(tmp_path / "state"), scale, [0.2], pairs, project, 1)
        stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        seen.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
        return seen

    assert set(run(["S0", "S1"]).y[0.2]) == {"S0", "S1"}
    seen = run(["S2"])  # after a restart the first two are known from the state
    assert seen.y[0.2].keys() == want.keys() == {"S0", "S1", "S2"}
    for slide in want:
        assert np.abs(seen.y[0.2][slide]["TypeA", "TypeB"] - want[slide]["TypeA", "TypeB"]).max() < 1e-8
    assert seen.weights()[0.2]["TypeA"].shape == (5, 1)


def test_sources(spark, tmp_path):
    cells = simulate.smooth_cells(spark, 20, 3, slides=2)
    tables.write_partitioned(cells, str(tmp_path / "cells"), ["slide_id"])
    back = tables.read_cells(spark, str(tmp_path / "cells"))
    assert back.count() == 40 and set(back.columns) == {"cell_id", "slide_id", "cell_type", "x", "y", "features"}
    flat = cells.select("cell_id", "cell_type", "x", "y", F.col("features")[0].alias("g0"), F.col("features")[1].alias("g1"))
    flat.write.option("header", True).csv(str(tmp_path / "csv"))
    from_csv = tables.read_cells(spark, str(tmp_path / "csv"), format="csv", features=["g0", "g1"])
    assert from_csv.first().slide_id == "slide1" and len(from_csv.first().features) == 2
