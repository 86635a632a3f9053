"""Principal components by type: moments and Gram matrices by partial sums, eigenvectors of the small matrix on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A gene whose deviation or share of non-zero values is under these is not scaled.
LEAST_SD, LEAST_SHARE = 1e-3, 0.01


@dataclass
class Components:
    """Of one type: means, scales, rotation (genes x components) and component deviations."""

    mean: np.ndarray
    scale: np.ndarray
    rotation: np.ndarray
    sdev: np.ndarray
    n: int


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gram(cells: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each type: cells, sums, counts of non-zeros and Gram matrix of the features. Partial matrices are added up by row on the executors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, types = matrix(batch.column(1)), np.array(batch.column(0).to_pylist(), object)
            for t in set(types):
                part = x[types == t]
                one = np.vstack([part.T @ part, part.sum(axis=0), (part != 0).sum(axis=0), np.full(part.shape[1], len(part))])
                sums[t] = sums[t] + one if t in sums else one
        for t, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(m), pa.string()), pa.array(range(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["cell_type", "row", "v"])

    def total(table: pa.Table) -> pa.Table:
        return pa.table({"cell_type": table["cell_type"][:1], "row": table["row"][:1], "v": pa.array([matrix(table["v"]).sum(axis=0)], pa.list_(pa.float64()))})

    schema = "cell_type string, row int, v array<double>"
    rows = cells.select("cell_type", "features").mapInArrow(partial, schema).groupBy("cell_type", "row").applyInArrow(total, schema).collect()
    out = {}
    for t in sorted({r.cell_type for r in rows}):
        m = np.array([r.v for r in sorted((r for r in rows if r.cell_type == t), key=lambda r: r.row)])
        out[t] = (int(m[-1, 0]), m[-3], m[-2], m[:-3])
    return out


def fit_pca(cells: DataFrame, n_components: int = 40, center: bool = True, scale: bool = True) -> dict[str, Components]:
    """Components of each type, of one rank for all: the least of n_components and of each type's cells and genes less one."""
    grams = gram(cells)
    rank = min([n_components, *(min(n - 1, len(s) - 1) for n, s, _, _ in grams.values())])
    out = {}
    for t, (n, sums, nonzero, g) in grams.items():
        mean = sums / n
        cov = (g - n * np.outer(mean, mean)) / (n - 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd = np.where((sd < LEAST_SD) | (nonzero / n < LEAST_SHARE), 1.0, sd) if scale else np.ones(len(sd))
        second = cov if center else g / (n - 1)
        values, vectors = np.linalg.eigh(second / np.outer(sd, sd))
        order = np.argsort(-values)[:rank]
        rotation = vectors[:, order]
        rotation = rotation * np.where(rotation[np.abs(rotation).argmax(axis=0), np.arange(rank)] < 0, -1, 1)
        out[t] = Components(mean if center else np.zeros(len(mean)), sd, rotation, np.sqrt(np.maximum(values[order], 0)), n)
    return out


def project(cells: DataFrame, of: dict[str, Components], whiten: bool = True, center_slides: bool = False) -> DataFrame:
    """(slide_id, cell_type, cell_id, pc array<double>): component scores, divided by their deviations with whiten, centred within slides on request."""
    weights = {t: c.rotation / (np.where(c.sdev > 0, c.sdev, 1.0) if whiten else 1.0) for t, c in of.items()}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, types = matrix(batch.column(3)), np.array(batch.column(1).to_pylist(), object)
            out = np.zeros((len(x), next(iter(weights.values())).shape[1]))
            for t in set(types):
                at = types == t
                out[at] = ((x[at] - of[t].mean) / of[t].scale) @ weights[t]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(out), pa.list_(pa.float64()))], names=["slide_id", "cell_type", "cell_id", "pc"])

    kind = dict(cells.dtypes)["cell_id"]
    scores = cells.where(F.col("cell_type").isin(sorted(of))).select("slide_id", "cell_type", "cell_id", "features").mapInArrow(scored, f"slide_id string, cell_type string, cell_id {kind}, pc array<double>")
    if not center_slides:
        return scores
    means = scores.select("slide_id", "cell_type", F.posexplode("pc").alias("p", "v")).groupBy("slide_id", "cell_type", "p").agg(F.avg("v").alias("m")).groupBy("slide_id", "cell_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("_m"))
    return scores.join(F.broadcast(means), ["slide_id", "cell_type"]).select("slide_id", "cell_type", "cell_id", F.zip_with("pc", "_m", lambda a, b: a - b).alias("pc"))


def gene_moments(cells: DataFrame) -> DataFrame:
    """(cell_type, gene, n, mean, sd, share): share of non-zero values; sd is 1 where it or the share is too small."""
    long = cells.select("cell_type", F.posexplode("features").alias("gene", "v"))
    stats = long.groupBy("cell_type", "gene").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.avg((F.col("v") != 0).cast("double")).alias("share"))
    return stats.withColumn("sd", F.when((F.col("sd") < LEAST_SD) | (F.col("share") < LEAST_SHARE), F.lit(1.0)).otherwise(F.col("sd")))
