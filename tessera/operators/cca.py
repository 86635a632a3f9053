"""Kernel canonical axes between and within types.

The cluster computes the operators Y = X1' K X2 of each sigma, slide and pair by partial products; they
are components by components, so the axes are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.kernel import KEYS
from tessera.operators.pca import matrix

#: Scores of this many bytes at most are sent to all executors; larger ones are joined.
BROADCAST_BYTES = 256_000_000

Pair = tuple[str, str]


def operators(kernel: DataFrame, scores: DataFrame) -> dict[float, dict[str, dict[Pair, np.ndarray]]]:
    """Y of every sigma, slide and pair of types: sum over triplets of k x_i x_j'.

    scores: slide_id, cell_type, cell_id, pc; a cell is found by its slide and id, and triplets of cells
    without scores count for nothing. Each task adds up its triplets' outer products by dense products of
    batches; the partial matrices are added row by row on the executors, one matrix for each key reaches
    the driver.
    """
    width = scores.select(F.size("pc").alias("w")).first().w
    columns = [*KEYS, "x", "y", "k"]
    if scores.count() * width * 8 <= BROADCAST_BYTES:
        table = scores.select("slide_id", "cell_id", "pc").toArrow()
        slides, ids, x = np.array(table["slide_id"].to_pylist()), np.array(table["cell_id"].to_pylist()), matrix(table["pc"])
        of_slide = {}
        for s in sorted(set(slides.tolist())):
            at = np.flatnonzero(slides == s)
            at = at[np.argsort(ids[at], kind="stable")]
            of_slide[s] = ids[at], x[at]
        sent = scores.sparkSession.sparkContext.broadcast(of_slide)
        source = kernel.select(*KEYS, F.col("i").alias("x"), F.col("j").alias("y"), "k")

        def sides(batch: pa.RecordBatch, slide: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            known, x = sent.value.get(slide, (np.empty(0), np.empty((0, width))))
            found, ok = [], np.ones(len(at), bool)
            for name in "xy":
                ids = np.array(batch.column(name).take(pa.array(at)).to_pylist())
                place = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
                ok &= known[place] == ids if len(known) else False
                found.append(place)
            return x[found[0][ok]], x[found[1][ok]], at[ok]
    else:
        one = scores.select("slide_id", F.col("cell_id").alias("i"), F.col("pc").alias("x"))
        two = scores.select("slide_id", F.col("cell_id").alias("j"), F.col("pc").alias("y"))
        source = kernel.join(one, ["slide_id", "i"]).join(two, ["slide_id", "j"]).select(*columns)

        def sides(batch: pa.RecordBatch, slide: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return matrix(batch.column("x").take(pa.array(at))), matrix(batch.column("y").take(pa.array(at))), at

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEYS)))
            number = {k: n for n, k in enumerate(dict.fromkeys(keys))}
            of = np.array([number[k] for k in keys])
            k = batch.column("k").to_numpy().astype(float)
            for key, n in number.items():
                x, y, at = sides(batch, key[1], np.flatnonzero(of == n))
                got = x.T @ (y * k[at, None])
                sums[key] = sums[key] + got if key in sums else got
        for key, m in sums.items():  # by row, so that no task gets all partial matrices of a key
            yield pa.RecordBatch.from_arrays([*(pa.array([key[c]] * width, pa.float64() if c == 0 else pa.string()) for c in range(len(KEYS))), pa.array(range(width), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=[*KEYS, "row", "m"])

    def total(table: pa.Table) -> pa.Table:
        return pa.table({**{c: table[c][:1] for c in [*KEYS, "row"]}, "m": pa.array([matrix(table["m"]).sum(axis=0)], pa.list_(pa.float64()))})

    schema = "sigma double, slide_id string, ct1 string, ct2 string, row int, m array<double>"
    out: dict[float, dict[str, dict[Pair, np.ndarray]]] = {}
    for r in source.mapInArrow(partial, schema).groupBy(*KEYS, "row").applyInArrow(total, schema).collect():
        out.setdefault(r.sigma, {}).setdefault(r.slide_id, {}).setdefault((r.ct1, r.ct2), np.zeros((width, width)))[r.row] = r.m
    return out


def summed(slides: dict[str, dict[Pair, np.ndarray]], without: tuple[str, ...] = ()) -> dict[Pair, np.ndarray]:
    """The operators of all slides added up, those within a type made symmetric."""
    out: dict[Pair, np.ndarray] = {}
    for slide in sorted(slides):
        if slide not in without:
            for pair, y in slides[slide].items():
                out[pair] = out[pair] + y if pair in out else y
    return {p: (y + y.T) / 2 if p[0] == p[1] else y for p, y in out.items()}


def _types(y: dict[Pair, np.ndarray]) -> list[str]:
    return list(dict.fromkeys(t for p in y for t in p))


def _both_ways(y: dict[Pair, np.ndarray]) -> dict[Pair, np.ndarray]:
    return y | {(b, a): m.T for (a, b), m in y.items() if a != b}


def deflated(y: dict[Pair, np.ndarray], w: dict[str, np.ndarray], metric: dict[str, np.ndarray] | None = None, rank_one: bool = False) -> dict[Pair, np.ndarray]:
    """The operators without the directions w: their rank-one term, or all that meets them on either side.

    metric has each type's squared component deviations where scores aren't whitened; projections are
    then oblique, images of the orthogonal ones.
    """
    out = {}
    for (a, b), m in y.items():
        d1, d2 = (metric[t] if metric else np.ones(len(w[t])) for t in (a, b))
        q1, q2 = w[a] / np.sqrt((w[a] * d1 * w[a]).sum()), w[b] / np.sqrt((w[b] * d2 * w[b]).sum())
        p1, p2 = d1 * q1, d2 * q2
        middle = np.outer(p1, p2) * (q1 @ m @ q2)
        out[a, b] = m - middle if rank_one else m - np.outer(p1, q1 @ m) - np.outer(m @ q2, p2) + middle
    return out


def _unit(v: np.ndarray, d: np.ndarray | None) -> np.ndarray:
    size = np.sqrt((v * v).sum() if d is None else (v * d * v).sum())
    return v / size if size > 0 else v


def _power(y: dict[Pair, np.ndarray], metric: dict[str, np.ndarray] | None, tol: float, most: int, step: float) -> dict[str, np.ndarray]:
    """One axis of three or more types: each type's weights in turn from the others' newest."""
    both, types = _both_ways(y), _types(y)
    w = {}
    for t in types:
        stacked = np.vstack([both[u, t] for u in types if u != t])
        w[t] = _unit(np.linalg.svd(stacked, full_matrices=False)[2][0], metric[t] if metric else None)
    for _ in range(most):
        moved = 0.0
        for t in types:
            d = metric[t] if metric else None
            new = sum(both[t, u] @ w[u] for u in types if u != t)
            new = _unit(new / d if d is not None else new, d)
            if step < 1:
                new = _unit((1 - step) * w[t] + step * new, d)
            moved = max(moved, min(np.abs(new - w[t]).max(), np.abs(new + w[t]).max()))
            w[t] = new
        if moved <= tol:
            break
    return w


def solve(y: dict[Pair, np.ndarray], n_axes: int = 2, metric: dict[str, np.ndarray] | None = None, first: dict[str, np.ndarray] | None = None, tol: float = 1e-5, most: int = 200, step: float = 1.0) -> dict[str, np.ndarray]:
    """Weights (components x axes) of each type.

    One type: the algebraically largest eigenvectors. Two: singular vectors. More: power iteration and
    deflation. first fixes the first axis (supervised); later ones are found after its deflation.
    """
    types = _types(y)
    if n_axes > min(min(m.shape) for m in y.values()):
        raise ValueError("more axes than components")
    scale = {t: 1 / np.sqrt(metric[t]) if metric else np.ones(next(m.shape[p.index(t)] for p, m in y.items() if t in p)) for t in types}
    axes: dict[str, list[np.ndarray]] = {t: [] for t in types}
    if first is not None:
        for t in types:
            axes[t].append(_unit(np.asarray(first[t], float), metric[t] if metric else None))
        y = deflated(y, {t: axes[t][0] for t in types}, metric)
    left = n_axes - len(axes[types[0]])
    if left and len(types) == 1:
        t = types[0]
        m = y[t, t] * np.outer(scale[t], scale[t])
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        axes[t] += list((vectors[:, np.argsort(-values)[:left]] * scale[t][:, None]).T)
    elif left and len(types) == 2:
        (a, b), m = next(iter(y.items()))
        u, _, v = np.linalg.svd(m * np.outer(scale[a], scale[b]), full_matrices=False)
        axes[a] += list((u[:, :left] * scale[a][:, None]).T)
        axes[b] += list((v[:left].T * scale[b][:, None]).T)
    else:
        for _ in range(left):
            w = _power(y, metric, tol, most, step)
            for t in types:
                axes[t].append(w[t])
            y = deflated(y, w, metric)
    # the sign: the largest weight of the first type is positive
    out = {t: np.stack(axes[t], axis=1) for t in types}
    lead = out[types[0]]
    sign = np.where(lead[np.abs(lead).argmax(axis=0), np.arange(lead.shape[1])] < 0, -1.0, 1.0)
    return {t: m * sign for t, m in out.items()}


@dataclass
class Axes:
    """Weights by sigma and type, and what failed."""

    weights: dict[float, dict[str, np.ndarray]]
    failed: dict[float, str]


def kernel_cca(y: dict[float, dict[str, dict[Pair, np.ndarray]]], n_axes: int = 2, **options) -> Axes:
    """Axes for every sigma. A sigma that can't be solved is noted; ValueError if none can."""
    weights, failed = {}, {}
    for sigma in sorted(y):
        try:
            weights[sigma] = solve(summed(y[sigma]), n_axes, **options)
        except (ValueError, np.linalg.LinAlgError) as error:
            failed[sigma] = str(error)
    if not weights:
        raise ValueError(f"no sigma can be solved: {failed}")
    return Axes(weights, failed)


def cell_scores(scores: DataFrame, weights: dict[float, dict[str, np.ndarray]]) -> DataFrame:
    """(sigma, slide_id, cell_type, cell_id, cc, score) of all axes; cc counts from 1."""
    rows = [(float(s), t, cc + 1, [float(v) for v in m[:, cc]]) for s, of in weights.items() for t, m in of.items() for cc in range(m.shape[1])]
    w = scores.sparkSession.createDataFrame(rows, "sigma double, cell_type string, cc int, w array<double>")
    dot = F.aggregate(F.zip_with("pc", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return scores.join(F.broadcast(w), "cell_type").select("sigma", "slide_id", "cell_type", "cell_id", "cc", dot.alias("score"))


def gene_weights(of: dict, weights: dict[float, dict[str, np.ndarray]], whitened: bool = True) -> list[tuple[float, str, int, int, float]]:
    """(sigma, cell_type, gene, cc, weight): axes carried back to the genes by the rotation."""
    out = []
    for sigma, types in weights.items():
        for t, m in types.items():
            back = of[t].rotation @ (m / of[t].sdev[:, None] if whitened else m)
            out += [(sigma, t, g, cc + 1, float(back[g, cc])) for g in range(back.shape[0]) for cc in range(back.shape[1])]
    return out


def pairs_of(types: list[str]) -> list[Pair]:
    return list(combinations(types, 2)) or [(types[0], types[0])]
