"""Significance of axes: permutations of cells, step-down tests, replicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.cca import Pair, deflated, solve, summed
from tessera.operators.pca import matrix
from tessera.operators.resample import generator, permutation


def p_values(nulls: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p_greater, p_less, p_two_sided) of observed (keys, obs) against nulls (keys, stat): (1 + extremer) / (1 + all)."""
    both = observed.join(nulls, keys, "left").where("stat is null or not isnan(stat)")
    got = both.groupBy(*keys).agg(F.count("stat").alias("m"), F.sum((F.col("stat") >= F.col("obs")).cast("long")).alias("g"), F.sum((F.col("stat") <= F.col("obs")).cast("long")).alias("l"))
    greater, less = (1 + F.coalesce("g", F.lit(0))) / (1 + F.col("m")), (1 + F.coalesce("l", F.lit(0))) / (1 + F.col("m"))
    return got.select(*keys, greater.alias("p_greater"), less.alias("p_less"), F.least(F.lit(1.0), 2 * F.least(greater, less)).alias("p_two_sided"))


def step_down(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(cc, p_raw, p_stepdown, significant) of (cc, p_raw): running maximum of p over the axes; significant up to the first over alpha."""
    top = F.max("p_raw").over(Window.orderBy("cc").rowsBetween(Window.unboundedPreceding, 0))  # a row for each axis
    return p.select("cc", "p_raw", top.alias("p_stepdown")).withColumn("significant", F.col("p_stepdown") <= alpha)


def _half_sums(effects: np.ndarray) -> np.ndarray:
    """The sums of all sign patterns; the first has no sign flipped."""
    sums = np.zeros(1)
    for e in effects:
        sums = np.concatenate([sums + e, sums - e])
    return sums


def sign_flips(effects: DataFrame) -> DataFrame:
    """One row (mean_effect, n, p): the share of all 2^n sign patterns whose mean is at least the observed one. effects: (replicate, effect), at most 40 rows.

    Patterns are counted, not enumerated: the sums of one half of the replicates are sorted, and each sum
    of the other half looks up how many of them reach the observed total.
    """
    spark = effects.sparkSession
    rows = effects.orderBy("replicate").select("effect").limit(41).collect()
    n = len(rows)
    if n > 40:
        raise ValueError("exact sign flips take 40 replicates at most")
    e = np.array([r.effect for r in rows if r.effect is not None], float)
    schema = "mean_effect double, n long, p double"
    if not len(e):
        return spark.createDataFrame([], schema)
    one, other = _half_sums(e[: len(e) // 2]), _half_sums(e[len(e) // 2 :])
    least = one[0] + other[0] - 1e-12 * len(e)
    one.sort()
    reached = len(one) * len(other) - int(np.searchsorted(one, least - other).sum())
    return spark.createDataFrame([(float(e.mean()), n, reached / 2 ** len(e))], schema)


#: Kernels of up to this number of triplets go to every task whole; larger ones stay on the cluster, a part of them in each task.
TRIPLETS = 20_000_000


class Problem:
    """One slide's scores and places of one pair of types as arrays, and its kernels: what a permutation task needs.

    Kernels of over TRIPLETS triplets stay a table (`large`), over which the operators of many draws are
    added up at once; the others are arrays by sigma.
    """

    def __init__(self, scores: DataFrame, cells: DataFrame, kernel: DataFrame, norms: DataFrame, pair: Pair):
        """kernel and norms: triplets and (sigma, ct1, ct2, norm) of the pair."""
        if len(found := [r.slide_id for r in kernel.select("slide_id").distinct().limit(2).collect()]) > 1:
            raise ValueError(f"permutations take one slide, not {', '.join(found)} and others: take replicates for several")
        self.pair = pair
        self.x, self.places, self.ids = {}, {}, {}
        for t in dict.fromkeys(pair):
            table = scores.where(F.col("cell_type") == t).join(cells.select("slide_id", "cell_id", "x", "y"), ["slide_id", "cell_id"]).select("cell_id", "pc", "x", "y").toArrow().sort_by("cell_id")
            self.ids[t] = np.array(table["cell_id"].to_pylist())
            self.x[t] = matrix(table["pc"])
            self.places[t] = (table["x"].to_numpy(), table["y"].to_numpy())
        self.kernels, self.norms = {}, {r.sigma: r.norm for r in norms.where((F.col("ct1") == pair[0]) & (F.col("ct2") == pair[1])).collect()}
        of = kernel.where((F.col("ct1") == pair[0]) & (F.col("ct2") == pair[1])).select("sigma", "i", "j", "k")
        self.large = of if of.count() > TRIPLETS else None
        if self.large is not None:
            self.sigmas = sorted(float(r.sigma) for r in of.select("sigma").distinct().collect())
            return
        table = of.toArrow()
        sigma = table["sigma"].to_numpy()
        i, j, k = (np.array(table[c].to_pylist()) if c != "k" else table[c].to_numpy() for c in "ijk")
        for s in sorted(set(sigma.tolist())):
            at = sigma == s
            self.kernels[s] = (np.searchsorted(self.ids[pair[0]], i[at]), np.searchsorted(self.ids[pair[1]], j[at]), k[at].astype(float))
        self.sigmas = sorted(self.kernels)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"large": None}

    def y(self, sigma: float, x: dict[str, np.ndarray]) -> np.ndarray:
        i, j, k = self.kernels[sigma]
        a, b = x[self.pair[0]], x[self.pair[1]]
        kb = np.zeros((len(a), b.shape[1]))
        order = np.argsort(i, kind="stable")
        i, j, k = i[order], j[order], k[order]
        if len(i):
            edges = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            kb[i[edges]] = np.add.reduceat(b[j] * k[:, None], edges, axis=0)
        m = a.T @ kb
        return (m + m.T) / 2 if self.pair[0] == self.pair[1] else m

    def drawn(self, method: str, which: str, rng: np.random.Generator, nx: int, ny: int, match: bool) -> dict[str, np.ndarray]:
        """Scores with the cells of one or both types permuted; 'pc' shuffles each component by itself."""
        moved = {"second_only": self.pair[1:], "first_only": self.pair[:1], "both": self.pair}[which]
        out = dict(self.x)
        for t in dict.fromkeys(moved):
            if method == "pc":
                out[t] = np.stack([c[rng.permutation(len(c))] for c in self.x[t].T], axis=1)
            else:
                out[t] = self.x[t][permutation(*self.places[t], method, rng, nx, ny, match)]
        return out

    def statistic(self, sigma: float, y: np.ndarray, w: dict[str, np.ndarray], x: dict[str, np.ndarray], cc: int) -> float:
        a, b = self.pair
        below = np.linalg.norm(x[a] @ w[a][:, cc]) * np.linalg.norm(x[b] @ w[b][:, cc]) * self.norms[sigma]
        return float(w[a][:, cc] @ y @ w[b][:, cc] / below) if below > 0 else 0.0


def _added(problem: Problem, draws: int, of_draw, sigmas: list[float]) -> dict[tuple[int, float], np.ndarray]:
    """{(draw, sigma): y} of a large kernel: each task adds up its triplets for all draws, batch by batch; matrices of components meet by draw and sigma.

    of_draw(problem, draw) gives a draw's scores by type. Every task draws anew by seed, one draw at a time
    for a batch, so that it holds places of cells, not scores of all draws.
    """
    a, b = problem.pair
    width = problem.x[a].shape[1]
    sent = problem.large.sparkSession.sparkContext.broadcast(problem)

    def partial(batches):
        p, sums, batch_of = sent.value, {}, []

        def add() -> None:
            sigma, i, j, k = (np.concatenate(c) for c in zip(*batch_of))
            batch_of.clear()
            i, j = np.searchsorted(p.ids[a], i), np.searchsorted(p.ids[b], j)
            at = {s: np.flatnonzero(sigma == s) for s in sigmas}
            for draw in range(draws):
                x = of_draw(p, draw)
                for s, rows in at.items():
                    m = np.zeros((width, x[b].shape[1]))
                    for few in np.array_split(rows, max(1, -(-len(rows) // 100_000))):
                        m += x[a][i[few]].T @ (x[b][j[few]] * k[few, None])
                    sums[draw, s] = sums[draw, s] + m if (draw, s) in sums else m

        for batch in batches:
            if batch.num_rows:
                batch_of.append([np.array(batch.column(c).to_pylist()) for c in range(4)])
            if sum(len(x[0]) for x in batch_of) > 1_000_000:
                add()
        if batch_of:
            add()
        keys = list(sums)
        rows = [m.ravel() for m in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in keys], pa.int64()), pa.array([s for _, s in keys], pa.float64()), pa.array(rows, pa.list_(pa.float64()))], names=["draw", "sigma", "m"])

    each = problem.large.select("sigma", "i", "j", "k").mapInArrow(partial, "draw long, sigma double, m array<double>")
    cells = each.select("draw", "sigma", F.posexplode("m").alias("at", "v")).groupBy("draw", "sigma", "at").agg(F.sum("v").alias("v"))
    out: dict[tuple[int, float], np.ndarray] = {}
    for r in cells.collect():
        out.setdefault((r.draw, r.sigma), np.zeros(width * problem.x[b].shape[1]))[r.at] = r.v
    out = {key: m.reshape(width, -1) for key, m in out.items()}
    return {key: (m + m.T) / 2 if a == b else m for key, m in out.items()}


def permuted_statistics(spark: SparkSession, problem: Problem, n: int, n_axes: int = 1, method: str = "bin", which: str = "second_only", nx: int = 10, ny: int = 10, match: bool = False, seed: int = 1, sigmas: list[float] | None = None, observed: dict[float, dict[str, np.ndarray]] | None = None) -> DataFrame:
    """(perm_id, sigma, cc, stat) of n refits on permuted cells, spread over tasks.

    With observed weights each axis is conditional: the fixed observed axes before it are deflated from
    the permuted operator and the first axis of the rest is fitted. Without, all axes are refitted.
    """
    used = sigmas or problem.sigmas

    def of_draw(p: Problem, perm: int) -> dict[str, np.ndarray]:
        return p.drawn(method, which, generator(seed, perm), nx, ny, match)

    def fitted(p: Problem, perm: int, x: dict[str, np.ndarray], sigma: float, y: np.ndarray) -> list[tuple]:
        rest = {p.pair: y}
        if observed is None:
            w = solve(rest, n_axes)
            return [(perm, sigma, cc + 1, p.statistic(sigma, y, w, x, cc)) for cc in range(n_axes)]
        rows = []
        for cc in range(n_axes):
            w = solve(rest, 1)
            rows.append((perm, sigma, cc + 1, p.statistic(sigma, y, w, x, 0)))
            rest = deflated(rest, {t: m[:, cc] for t, m in observed[sigma].items()})
        return rows

    if problem.large is not None:
        y = _added(problem, n, lambda p, draw: of_draw(p, draw + 1), used)
        rows = []
        for perm in range(1, n + 1):
            x = of_draw(problem, perm)
            for sigma in used:
                rows += fitted(problem, perm, x, sigma, y[perm - 1, sigma])
        return spark.createDataFrame(rows, "perm_id long, sigma double, cc int, stat double")
    sent = spark.sparkContext.broadcast(problem)

    def run(frames):
        p = sent.value
        for frame in frames:
            rows = []
            for perm in frame["perm_id"]:
                x = of_draw(p, perm)
                for sigma in used:
                    rows += fitted(p, perm, x, sigma, p.y(sigma, x))
            yield pd.DataFrame(rows, columns=["perm_id", "sigma", "cc", "stat"])

    perms = spark.range(1, n + 1, numPartitions=max(1, min(n // 4, 4 * spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "perm_id")
    return perms.mapInPandas(run, "perm_id long, sigma double, cc int, stat double")


def fair_sigma(statistics: DataFrame) -> DataFrame:
    """(perm_id, cc, sigma, stat): the best sigma of each draw, chosen as for the observed cells."""
    return statistics.groupBy("perm_id", "cc").agg(F.max_by("sigma", "stat").alias("sigma"), F.max("stat").alias("stat"))


def conditional_test(spark: SparkSession, problem: Problem, weights: dict[float, dict[str, np.ndarray]], n: int = 999, alpha: float = 0.05, **options) -> DataFrame:
    """(cc, observed_stat, observed_sigma, p_raw, p_stepdown, mc_floor, significant) of the axes, each given those before it."""
    n_axes = next(iter(next(iter(weights.values())).values())).shape[1]
    rows, large = [], {}
    if problem.large is not None:
        large = _added(problem, 1, lambda p, _: p.x, [float(sigma) for sigma in weights])
    for sigma, w in weights.items():
        y = large[0, float(sigma)] if large else problem.y(sigma, problem.x)
        rows += [(cc + 1, float(sigma), problem.statistic(sigma, y, w, problem.x, cc)) for cc in range(n_axes)]
    observed = spark.createDataFrame(rows, "cc int, sigma double, stat double").groupBy("cc").agg(F.max("stat").alias("obs"), F.max_by("sigma", "stat").alias("observed_sigma"))
    nulls = fair_sigma(permuted_statistics(spark, problem, n, n_axes, observed=weights, **options)).select("cc", "stat")
    p = p_values(nulls, observed.select("cc", "obs"), ["cc"]).select("cc", F.col("p_greater").alias("p_raw"))
    return step_down(p, alpha).join(F.broadcast(observed), "cc").select("cc", F.col("obs").alias("observed_stat"), "observed_sigma", "p_raw", "p_stepdown", F.lit(1 / (n + 1)).alias("mc_floor"), "significant")


def replicate_effects(y: dict[float, dict[str, dict[Pair, np.ndarray]]], squares, norms: dict[tuple, float], cc: int = 1) -> list[tuple[str, float, float, float]]:
    """(heldout slide, chosen sigma, training statistic, held-out effect): axes and sigma from the other slides, judged on the one left out.

    squares(slide, type) gives the Gram matrix of a slide's scores; norms the normaliser of (sigma, slide, ct1, ct2).
    """
    slides = sorted({s for of in y.values() for s in of})
    out = []
    for held in slides:
        best = None
        for sigma in sorted(y):
            w = solve(summed(y[sigma], without=(held,)), cc)
            value = np.mean([_ratio(y[sigma][s], w, lambda t, s=s: squares(s, t), lambda p, s=s: norms[(sigma, s, *p)], cc) for s in slides if s != held and s in y[sigma]])
            if best is None or value > best[0]:
                best = (value, sigma, w)
        value, sigma, w = best
        effect = _ratio(y[sigma][held], w, lambda t: squares(held, t), lambda p: norms[(sigma, held, *p)], cc)
        out.append((held, float(sigma), float(value), float(effect)))
    return out


def _ratio(y: dict[Pair, np.ndarray], w: dict[str, np.ndarray], square, norm, cc: int) -> float:
    values = []
    for (a, b), m in y.items():
        u, v = w[a][:, cc - 1], w[b][:, cc - 1]
        below = np.sqrt(u @ square(a) @ u) * np.sqrt(v @ square(b) @ v) * norm((a, b))
        values.append(u @ m @ v / below if below > 1e-9 else 0.0)
    return float(np.mean(values))


def replicate_test(effects: list[float], alternative: str = "greater", n_resamples: int = 9999, confidence: float = 0.95, seed: int = 1) -> dict[str, float]:
    """Mean effect, p by sign flips (all of them for up to 15 replicates), and a bootstrap interval by median-unbiased quantiles."""
    e, rng = np.array(effects, float), generator(seed, "replicates")
    n = len(e)
    if n <= 15:
        signs = 1 - 2 * ((np.arange(2**n)[:, None] >> np.arange(n)) & 1)
        means, extra = signs @ e / n, 0
    else:
        means, extra = rng.choice([-1, 1], (n_resamples, n)) @ e / n, 1
    greater = ((means >= e.mean() - 1e-12).sum() + extra) / (len(means) + extra)
    less = ((means <= e.mean() + 1e-12).sum() + extra) / (len(means) + extra)
    p = {"greater": greater, "less": less, "two.sided": min(1.0, 2 * min(greater, less))}[alternative]
    boot = e[rng.integers(0, n, (n_resamples, n))].mean(axis=1)
    low, high = np.quantile(boot, [(1 - confidence) / 2, (1 + confidence) / 2], method="median_unbiased")
    return {"estimate": float(e.mean()), "p_value": float(p), "ci_low": float(low), "ci_high": float(high), "n": n}
