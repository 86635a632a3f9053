"""How strongly cell scores of two types go together in space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.material import materialized
from tessera.operators.distance import BLOCK
from tessera.operators.kernel import KEYS, centered_norm, col_sums, row_sums

#: A denominator under this gives a correlation of 0.
TINY = 1e-9
#: Sinkhorn's scaling leaves rows and columns out whose sum is not over this.
LEAST_SUM = 2.0**-52


def _sides(kernel: DataFrame, scores: DataFrame) -> DataFrame:
    """Triplets with the scores a of row cells and b of column cells, for each axis."""
    a = scores.select("sigma", "slide_id", F.col("cell_type").alias("ct1"), F.col("cell_id").alias("i"), "cc", F.col("score").alias("a"))
    b = scores.select("sigma", "slide_id", F.col("cell_type").alias("ct2"), F.col("cell_id").alias("j"), "cc", F.col("score").alias("b"))
    return kernel.join(a, ["sigma", "slide_id", "ct1", "i"]).join(b, ["sigma", "slide_id", "ct2", "j", "cc"])


def correlation_parts(kernel: DataFrame, scores: DataFrame, norms: DataFrame) -> DataFrame:
    """(sigma, slide_id, ct1, ct2, cc, numerator, aa, bb, norm): what normalised correlations are made of."""
    numerator = _sides(kernel, scores).groupBy(*KEYS, "cc").agg(F.sum(F.col("k") * F.col("a") * F.col("b")).alias("numerator"))
    squares = scores.groupBy("sigma", "slide_id", "cell_type", "cc").agg(F.sum(F.col("score") * F.col("score")).alias("s"))
    aa = squares.select("sigma", "slide_id", F.col("cell_type").alias("ct1"), "cc", F.col("s").alias("aa"))
    bb = squares.select("sigma", "slide_id", F.col("cell_type").alias("ct2"), "cc", F.col("s").alias("bb"))
    return numerator.join(aa, ["sigma", "slide_id", "ct1", "cc"]).join(bb, ["sigma", "slide_id", "ct2", "cc"]).join(F.broadcast(norms), KEYS)


def normalized_correlation(parts: DataFrame) -> DataFrame:
    """(sigma, slide_id, ct1, ct2, cc, ncorr)."""
    below = F.sqrt("aa") * F.sqrt("bb") * F.col("norm")
    return parts.select(*KEYS, "cc", F.when(F.abs(below) < TINY, 0.0).otherwise(F.col("numerator") / below).alias("ncorr"))


def aggregate_correlation(parts: DataFrame) -> DataFrame:
    """(sigma, ct1, ct2, cc, ncorr): sums over slides in both parts, times the mean normaliser."""
    total = parts.groupBy("sigma", "ct1", "ct2", "cc").agg(F.sum("numerator").alias("n"), (F.sqrt(F.sum("aa")) * F.sqrt(F.sum("bb")) * F.avg("norm")).alias("d"))
    return total.select("sigma", "ct1", "ct2", "cc", F.when(F.abs("d") < TINY, 0.0).otherwise(F.col("n") / F.col("d")).alias("ncorr"))


def best_sigma(correlations: DataFrame) -> DataFrame:
    """One row (sigma, mean_ncorr): the sigma with the largest mean correlation of the first axis over pairs and slides; the smaller one of equals."""
    means = correlations.where("cc = 1").groupBy("sigma").agg(F.avg("ncorr").alias("mean_ncorr"))
    return means.orderBy(F.desc("mean_ncorr"), "sigma").limit(1)


def whitened_norm(kernel: DataFrame, self_kernels: DataFrame, of: DataFrame) -> DataFrame:
    """(sigma, slide_id, ct1, ct2, norm): the centred kernel's norm under the kernels within both types.

    With K_c = K - r1' - 1c' + g: the squared norm is the sum over (Rx K_c Ry) and K_c. It is found from
    the sparse product M = Rx K Ry where K is not 0, and sums of Rx and Ry for the rest; M alone is a
    join of three. self_kernels: triplets with ct1 = ct2, of the same sigmas and slides; a kernel within
    one type is its own. Missing self kernels leave a block out.
    """
    both = self_kernels.select("sigma", "slide_id", F.col("ct1").alias("t"), "i", "j", "k")
    r = both.union(both.select("sigma", "slide_id", "t", F.col("j").alias("i"), F.col("i").alias("j"), "k")).groupBy("sigma", "slide_id", "t", "i", "j").agg((F.sum("k") / 2).alias("k"))
    sizes = F.broadcast(of.select(*BLOCK, "n1", "n2"))
    rx = r.select("sigma", "slide_id", F.col("t").alias("ct1"), F.col("i").alias("p"), F.col("j").alias("i"), F.col("k").alias("kx"))
    ry = r.select("sigma", "slide_id", F.col("t").alias("ct2"), F.col("i").alias("j"), F.col("j").alias("q"), F.col("k").alias("ky"))
    half = kernel.join(rx, ["sigma", "slide_id", "ct1", "i"]).groupBy(*KEYS, "p", "j").agg(F.sum(F.col("kx") * F.col("k")).alias("h"))
    half = materialized(half)
    m = half.join(ry, ["sigma", "slide_id", "ct2", "j"]).groupBy(*KEYS, "p", "q").agg(F.sum(F.col("h") * F.col("ky")).alias("m"))
    m = materialized(m)
    rows = row_sums(kernel).join(sizes, BLOCK).select(*KEYS, "i", (F.col("row_sum") / F.col("n2")).alias("rm"))
    cols = col_sums(kernel).join(sizes, BLOCK).select(*KEYS, "j", (F.col("col_sum") / F.col("n1")).alias("cm"))
    grand = kernel.groupBy(*KEYS).agg(F.sum("k").alias("g")).join(sizes, BLOCK).select(*KEYS, (F.col("g") / (F.col("n1") * F.col("n2"))).alias("gm"))
    values = kernel.select(*KEYS, F.col("i").alias("p"), F.col("j").alias("q"), "k")
    at = m.join(values, [*KEYS, "p", "q"], "left").join(rows.withColumnRenamed("i", "p"), [*KEYS, "p"], "left").join(cols.withColumnRenamed("j", "q"), [*KEYS, "q"], "left").join(F.broadcast(grand), KEYS)
    rm, cm = F.coalesce("rm", F.lit(0.0)), F.coalesce("cm", F.lit(0.0))
    # <M, K> + 2 <M, U V'> with U = [-r, 1], V = [1, g - c]
    first = at.groupBy(*KEYS).agg(F.sum(F.col("m") * (F.coalesce("k", F.lit(0.0)) + 2 * (F.col("gm") - cm - rm))).alias("s"))
    # the rest: sum of (U' Rx U) * (V' Ry V), 2 by 2 matrices
    e = rx.join(F.broadcast(of.select(*BLOCK)), ["slide_id", "ct1"]).select(*KEYS, "p", "i", F.col("kx").alias("v"))
    e = e.join(rows.select(*KEYS, F.col("i").alias("p"), F.col("rm").alias("r1")), [*KEYS, "p"], "left").join(rows.select(*KEYS, "i", F.col("rm").alias("r2")), [*KEYS, "i"], "left")
    r1, r2 = F.coalesce("r1", F.lit(0.0)), F.coalesce("r2", F.lit(0.0))
    left = e.groupBy(*KEYS).agg(F.sum(F.col("v") * r1 * r2).alias("u00"), F.sum(-F.col("v") * r1).alias("u01"), F.sum("v").alias("u11"))
    f = ry.join(F.broadcast(of.select(*BLOCK)), ["slide_id", "ct2"]).select(*KEYS, "j", "q", F.col("ky").alias("v")).join(F.broadcast(grand), KEYS)
    f = f.join(cols.select(*KEYS, "j", F.col("cm").alias("c1")), [*KEYS, "j"], "left").join(cols.select(*KEYS, F.col("j").alias("q"), F.col("cm").alias("c2")), [*KEYS, "q"], "left")
    c1, c2 = F.col("gm") - F.coalesce("c1", F.lit(0.0)), F.col("gm") - F.coalesce("c2", F.lit(0.0))
    right = f.groupBy(*KEYS).agg(F.sum("v").alias("v00"), F.sum(F.col("v") * c2).alias("v01"), F.sum(F.col("v") * c1 * c2).alias("v11"))
    rest = F.col("u00") * F.col("v00") + 2 * F.col("u01") * F.col("v01") + F.col("u11") * F.col("v11")
    return first.join(left, KEYS).join(right, KEYS).select(*KEYS, F.sqrt(F.greatest(F.col("s") + rest, F.lit(0.0))).alias("norm"))


def kernel_norms(kernel: DataFrame, of: DataFrame, self_kernels: DataFrame | None = None) -> DataFrame:
    """(sigma, slide_id, ct1, ct2, norm, whitened): whitened where kernels within both types are known, always within one type."""
    own = kernel.where("ct1 = ct2")
    known = own if self_kernels is None else own.union(self_kernels.select(own.columns)).dropDuplicates([*KEYS, "i", "j"])
    plain = centered_norm(kernel, of).withColumn("whitened", F.lit(False))
    white = whitened_norm(kernel, known, of).withColumn("whitened", F.lit(True))
    return white.union(plain.join(white, KEYS, "left_anti"))


def sinkhorn(kernel: DataFrame, tol: float = 1e-8, most: int = 1000) -> DataFrame:
    """The kernel scaled by row and column factors in turn, each block until neither moves by tol or more; sums of up to LEAST_SUM give a factor of 0."""
    def inverse(side: str, by: DataFrame, other: str, name: str, factor: str) -> DataFrame:
        sums = left.join(by, [*KEYS, other]).groupBy(*KEYS, side).agg(F.sum(F.col("k") * F.col(factor)).alias("s"))
        return materialized(sums.select(*KEYS, side, F.when(F.col("s") > LEAST_SUM, 1 / F.col("s")).otherwise(0.0).alias(name)))

    def moved(new: DataFrame, old: DataFrame, side: str, name: str) -> DataFrame:
        was = old.withColumnRenamed(name, "was")
        return new.join(was, [*KEYS, side]).groupBy(*KEYS).agg(F.max(F.abs(F.col(name) - F.col("was"))).alias("m"))

    left, scaled = kernel, None
    u = kernel.select(*KEYS, "i").distinct().withColumn("u", F.lit(1.0))
    v = kernel.select(*KEYS, "j").distinct().withColumn("v", F.lit(1.0))
    for n in range(1, most + 1):
        last_u, last_v = u, v
        u = inverse("i", v, "j", "u", "v")
        v = inverse("j", u, "i", "v", "u")
        moves = moved(u, last_u, "i", "u").union(moved(v, last_v, "j", "v")).groupBy(*KEYS).agg(F.max("m").alias("m")).collect()  # a row for each block
        still = [tuple(r)[:-1] for r in moves if r.m >= tol] if n < most else []
        if len(still) < len(moves):
            done = left.join(u, [*KEYS, "i"]).join(v, [*KEYS, "j"]).select(*KEYS, "i", "j", (F.col("k") * F.col("u") * F.col("v")).alias("k"))
            if still:
                open_blocks = F.broadcast(kernel.sparkSession.createDataFrame(still, kernel.select(*KEYS).schema))
                done = done.join(open_blocks, KEYS, "left_anti")
                left, u, v = (df.join(open_blocks, KEYS, "left_semi") for df in (left, u, v))
            scaled = done if scaled is None else scaled.unionByName(done)
        if not still:
            break
    return kernel if scaled is None else scaled


def filtered(kernel: DataFrame, row_cutoff: float, col_cutoff: float, together: bool = False) -> DataFrame:
    """Triplets of the rows and columns whose sums are over the cutoffs; columns are summed over the rows kept, unless together."""
    rows = row_sums(kernel).where(F.col("row_sum") > row_cutoff).select(*KEYS, "i")
    if together:
        cols = col_sums(kernel).where(F.col("col_sum") > col_cutoff).select(*KEYS, F.col("j"))
        ok = rows.join(cols.withColumnRenamed("j", "i"), [*KEYS, "i"])
        return kernel.join(ok, [*KEYS, "i"], "left_semi").join(ok.withColumnRenamed("i", "j"), [*KEYS, "j"], "left_semi")
    kept = kernel.join(rows, [*KEYS, "i"], "left_semi")
    cols = col_sums(kept).where(F.col("col_sum") > col_cutoff).select(*KEYS, "j")
    return kept.join(cols, [*KEYS, "j"], "left_semi")


def bidirectional_correlation(kernel: DataFrame, scores: DataFrame, normalize: str = "row_or_col", row_cutoff: float | None = 5e-2, col_cutoff: float = 5e-2, together: bool = False, no_variation: float | None = None) -> DataFrame:
    """(sigma, slide_id, ct1, ct2, cc, bidir): mean of cor(K' a, b) and cor(a, K b), K's rows or columns of sum 1, or scaled by Sinkhorn and Knopp, or as they are ('none').

    Rows and columns with small sums are left out first (row_cutoff None: none; their cells then count
    with a sum of 0). Where scores or sums don't vary a correlation is no_variation: null, so that such
    slides don't enter means, or a number.
    """
    k = kernel if row_cutoff is None else materialized(filtered(kernel, row_cutoff, col_cutoff, together))
    if normalize == "sinkhorn_knopp":
        k = sinkhorn(k)
    by_row, by_col = k, k
    if normalize == "row_or_col":
        by_row = k.join(row_sums(k), [*KEYS, "i"]).withColumn("k", F.col("k") / F.col("row_sum")).drop("row_sum")
        by_col = k.join(col_sums(k), [*KEYS, "j"]).withColumn("k", F.col("k") / F.col("col_sum")).drop("col_sum")
    a = scores.select("sigma", "slide_id", F.col("cell_type").alias("ct1"), F.col("cell_id").alias("i"), "cc", F.col("score").alias("a"))
    b = scores.select("sigma", "slide_id", F.col("cell_type").alias("ct2"), F.col("cell_id").alias("j"), "cc", F.col("score").alias("b"))
    ka = by_row.join(a, ["sigma", "slide_id", "ct1", "i"]).groupBy(*KEYS, "j", "cc").agg(F.sum(F.col("k") * F.col("a")).alias("ka"))
    kb = by_col.join(b, ["sigma", "slide_id", "ct2", "j"]).groupBy(*KEYS, "i", "cc").agg(F.sum(F.col("k") * F.col("b")).alias("kb"))
    how = "inner"
    if row_cutoff is None:  # cells without neighbours count too
        pairs = F.broadcast(kernel.select(*KEYS).distinct())
        a, b, how = a.join(pairs, ["sigma", "slide_id", "ct1"]), b.join(pairs, ["sigma", "slide_id", "ct2"]), "left"
        one = b.join(ka, [*KEYS, "j", "cc"], how).select(*KEYS, "cc", F.coalesce("ka", F.lit(0.0)).alias("p"), F.col("b").alias("q"))
        two = a.join(kb, [*KEYS, "i", "cc"], how).select(*KEYS, "cc", F.coalesce("kb", F.lit(0.0)).alias("p"), F.col("a").alias("q"))
    else:
        one = ka.join(b, ["sigma", "slide_id", "ct2", "j", "cc"]).select(*KEYS, "cc", F.col("ka").alias("p"), F.col("b").alias("q"))
        two = kb.join(a, ["sigma", "slide_id", "ct1", "i", "cc"]).select(*KEYS, "cc", F.col("kb").alias("p"), F.col("a").alias("q"))
    # a single cell correlates as 1
    spread = F.stddev_pop("p") * F.stddev_pop("q")
    cor = F.when(F.count("*") < 2, 1.0).when(spread < 1e-12, F.lit(no_variation).cast("double")).otherwise(F.covar_pop("p", "q") / spread)
    both = one.groupBy(*KEYS, "cc").agg(cor.alias("c1")).join(two.groupBy(*KEYS, "cc").agg(cor.alias("c2")), [*KEYS, "cc"])
    return both.select(*KEYS, "cc", ((F.col("c1") + F.col("c2")) / 2).alias("bidir"))


def self_bidirectional_correlation(self_kernel: DataFrame, scores: DataFrame, normalize: str = "row_or_col", cutoff: float = 5e-3, no_variation: float | None = None) -> DataFrame:
    """The same within types; rows and columns are filtered together."""
    return bidirectional_correlation(self_kernel, scores, normalize, cutoff, cutoff, together=True, no_variation=no_variation)


def mean_over_slides(correlations: DataFrame, value: str) -> DataFrame:
    """Mean of the slides' finite values."""
    ok = correlations.where(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.groupBy("sigma", "ct1", "ct2", "cc").agg(F.avg(value).alias(value))


def smoothed_scores(kernel: DataFrame, scores: DataFrame, cc: int = 1) -> DataFrame:
    """(sigma, slide_id, ct1, ct2, j, ak, b): each column cell's sum of k times the row cells' scores beside its own score; 0 without neighbours."""
    one = scores.where(F.col("cc") == cc)
    a = one.select("sigma", "slide_id", F.col("cell_type").alias("ct1"), F.col("cell_id").alias("i"), F.col("score").alias("a"))
    b = one.select("sigma", "slide_id", F.col("cell_type").alias("ct2"), F.col("cell_id").alias("j"), F.col("score").alias("b")).join(F.broadcast(kernel.select(*KEYS).distinct()), ["sigma", "slide_id", "ct2"])
    ak = kernel.join(a, ["sigma", "slide_id", "ct1", "i"]).groupBy(*KEYS, "j").agg(F.sum(F.col("k") * F.col("a")).alias("ak"))
    return b.join(ak, [*KEYS, "j"], "left").select(*KEYS, "j", F.coalesce("ak", F.lit(0.0)).alias("ak"), "b")


def neighbor_average(kernel: DataFrame, scores: DataFrame) -> DataFrame:
    """(sigma, slide_id, ct1, ct2, i, cc, smooth): mean of the neighbours' scores by kernel weight, 0 for a cell without neighbours."""
    b = scores.select("sigma", "slide_id", F.col("cell_type").alias("ct2"), F.col("cell_id").alias("j"), "cc", "score")
    mean = kernel.join(b, ["sigma", "slide_id", "ct2", "j"]).groupBy(*KEYS, "i", "cc").agg((F.sum(F.col("k") * F.col("score")) / F.sum("k")).alias("smooth"))
    cells = scores.select("sigma", "slide_id", F.col("cell_type").alias("ct1"), F.col("cell_id").alias("i"), "cc").join(F.broadcast(kernel.select(*KEYS).distinct()), ["sigma", "slide_id", "ct1"])
    return cells.join(mean, [*KEYS, "i", "cc"], "left").select(*KEYS, "i", "cc", F.coalesce("smooth", F.lit(0.0)).alias("smooth"))


def long_form(correlations: DataFrame) -> DataFrame:
    """Correlations with the pair's name beside them."""
    return correlations.withColumn("ct12", F.concat_ws("-", "ct1", "ct2"))
