"""Slides as a stream: operators are sums over slides, so axes can follow as slides arrive."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.cca import Pair, operators, solve, summed
from tessera.operators.cells import coordinates
from tessera.operators.kernel import gaussian_kernel


class SlideAccumulator:
    """Operators of the slides seen so far. A slide that comes again replaces what it gave before, so a repeated batch changes nothing.

    Distances are multiplied by a fixed scale, as the smallest percentile of all slides isn't known before
    the last one has come: with the scale that gaussian_kernel gives for all slides, the stream gives the
    operators of all slides at once. Each batch's operators are written to `state`, from which a new
    accumulator goes on after a restart.
    """

    def __init__(self, spark: SparkSession, state: str, scale: float, sigmas: list[float], pairs: list[Pair], project: Callable[[DataFrame], DataFrame], n_axes: int = 2):
        """state: a folder of the store that the stream's checkpoint is in. project: cells to slide_id, cell_type, cell_id, pc."""
        self.spark, self.state, self.scale = spark, state.rstrip("/"), float(scale)
        self.sigmas, self.pairs, self.project, self.n_axes = sigmas, pairs, project, n_axes
        self.y: dict[float, dict[str, dict[Pair, np.ndarray]]] = {}
        place = spark._jvm.org.apache.hadoop.fs.Path(self.state)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            last = spark.read.parquet(self.state)  # a row for each operator of each batch
            for r in last.orderBy("batch").collect():
                self._take(r.sigma, r.slide_id, (r.ct1, r.ct2), np.array(r.m).reshape(r.width, -1))

    def _take(self, sigma: float, slide: str, pair: Pair, m: np.ndarray) -> None:
        self.y.setdefault(sigma, {}).setdefault(slide, {})[pair] = m

    def batch(self, cells: DataFrame, number: int) -> None:
        """Whole slides, as foreachBatch gives them."""
        if cells.isEmpty():
            return
        cells = cells.cache()
        scaled = cells.withColumns({c: F.col(c) * self.scale for c in coordinates(cells)})
        kernel, _, _ = gaussian_kernel(scaled, self.sigmas, self.pairs, least_neighbors=None, normalize_distance=False)
        rows = []
        for sigma, slides in operators(kernel, self.project(cells)).items():
            for slide, of in slides.items():
                for pair, m in of.items():
                    self._take(sigma, slide, pair, m)
                    rows.append((float(sigma), slide, *pair, len(m), [float(v) for v in m.ravel()]))
        self.spark.createDataFrame(rows, "sigma double, slide_id string, ct1 string, ct2 string, width int, m array<double>").write.mode("overwrite").parquet(f"{self.state}/batch={number}")
        cells.unpersist()

    def weights(self) -> dict[float, dict[str, np.ndarray]]:
        return {s: solve(summed(of), self.n_axes) for s, of in self.y.items()}

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over a stream of cells, each slide within one file or batch, until it is used up."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
