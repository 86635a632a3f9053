"""DuckDB SQL of the spatial queries, from their definitions: all pairs of points, no grids, no shortcuts."""

from __future__ import annotations

_X = "((v * v * 37 + v * 101) % 99991) / 99991::double"
_Y = "((v * v * v * 11 + v * 59) % 99989) / 99989::double"
CELLS = f"cells as (select v as cell_id, 'S' || (label % 5) as slide_id, 'T' || (label % 2) as cell_type, {_X} as x, {_Y} as y, embedding as features from (select vec_id::bigint as v, label, embedding from embeddings))"
CUSTOMERS = f"cells as (select v as cell_id, 'N' || c_nationkey as slide_id, c_mktsegment as cell_type, {_X} as x, {_Y} as y from (select c_custkey::bigint as v, c_nationkey, c_mktsegment from customer))"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
ALL = f"everything as (select a.slide_id, a.cell_type as ct1, b.cell_type as ct2, a.cell_id as i, b.cell_id as j, {_D} as d from cells a join cells b on a.slide_id = b.slide_id and a.cell_id <> b.cell_id)"


def _low(within: bool) -> str:
    """Distances of the blocks in use, and their low percentiles."""
    which = "ct1 = ct2" if within else "ct1 = 'T0' and ct2 = 'T1'"
    return f"""raw as (
  select * from everything where {which}
), least as (
  select slide_id, ct1, ct2, min(d) filter (where d > 0) as d_min from raw group by all
), nonzero as (
  select raw.slide_id, raw.ct1, raw.ct2, i, j, greatest(d, d_min) as d, d_min from raw join least using (slide_id, ct1, ct2)
), lows as (
  select slide_id, ct1, ct2, any_value(d_min) as d_min, quantile_cont(d, {1e-4 if within else 1e-3}) as low from nonzero group by all
)"""


def _kernel(within: bool = False, sigmas: str = "0.01, 0.02, 0.05", clip: bool = True) -> str:
    """Everything up to the table k (sigma, slide_id, ct1, ct2, i, j, k), clipped or not."""
    steps = f"""with {CELLS}, {ALL}, {_low(within)}, scaled as (
  select n.slide_id, n.ct1, n.ct2, i, j, greatest(d, low) * (0.01 / (select min(low) from lows)) as d from nonzero n join lows using (slide_id, ct1, ct2)
), unclipped as (
  select sigma::double as sigma, slide_id, ct1, ct2, i, j, exp(-0.5 * (d / sigma::double) * (d / sigma::double)) as k from scaled, (select unnest([{sigmas}]) as sigma) s
  where exp(-0.5 * (d / sigma::double) * (d / sigma::double)) >= 1e-7
)"""
    if clip:
        return steps + """, tops as (
  select sigma, slide_id, ct1, ct2, quantile_cont(k, 0.85) as top from unclipped group by all
), k as (
  select u.sigma, u.slide_id, u.ct1, u.ct2, i, j, least(k, top) as k from unclipped u join tops using (sigma, slide_id, ct1, ct2)
)"""
    return steps + ", k as (select * from unclipped)"


_SUMS = "select sigma, slide_id, ct1, ct2, count(*) as n, round(sum(k), 6) as sum_k from {} group by all"
SIZES = "sizes as (select slide_id, cell_type, count(*)::double as n from cells group by all)"
SCORES = "scores as (select slide_id, cell_type, cell_id, cc, features[cc]::double as score from cells, (select unnest([1, 2])::integer as cc) c)"
NORMS = f"""{SIZES}, rs as (
  select sigma, slide_id, ct1, ct2, i, sum(k) as s from k group by all
), cs as (
  select sigma, slide_id, ct1, ct2, j, sum(k) as s from k group by all
), norms as (
  select t.sigma, t.slide_id, t.ct1, t.ct2, sqrt(greatest(kk - rr / b.n - cc / a.n + g * g / (a.n * b.n), 0)) as norm
  from (select sigma, slide_id, ct1, ct2, sum(k * k) as kk, sum(k) as g from k group by all) t
  join (select sigma, slide_id, ct1, ct2, sum(s * s) as rr from rs group by all) r using (sigma, slide_id, ct1, ct2)
  join (select sigma, slide_id, ct1, ct2, sum(s * s) as cc from cs group by all) c using (sigma, slide_id, ct1, ct2)
  join sizes a on a.slide_id = t.slide_id and a.cell_type = t.ct1
  join sizes b on b.slide_id = t.slide_id and b.cell_type = t.ct2
)"""
PARTS = f"""{NORMS}, {SCORES}, squares as (
  select slide_id, cell_type, cc, sum(score * score) as s from scores group by all
), parts as (
  select n.*, a.s as aa, b.s as bb, norm from (
    select k.sigma, k.slide_id, k.ct1, k.ct2, a.cc, sum(k.k * a.score * b.score) as numerator
    from k join scores a on a.slide_id = k.slide_id and a.cell_id = k.i join scores b on b.slide_id = k.slide_id and b.cell_id = k.j and b.cc = a.cc
    group by all
  ) n
  join squares a on a.slide_id = n.slide_id and a.cell_type = n.ct1 and a.cc = n.cc
  join squares b on b.slide_id = n.slide_id and b.cell_type = n.ct2 and b.cc = n.cc
  join norms x on x.sigma = n.sigma and x.slide_id = n.slide_id and x.ct1 = n.ct1 and x.ct2 = n.ct2
), ncorr as (
  select sigma, slide_id, ct1, ct2, cc, case when abs(sqrt(aa) * sqrt(bb) * norm) < 1e-9 then 0 else numerator / (sqrt(aa) * sqrt(bb) * norm) end as ncorr from parts
)"""


def _normalized(side: str) -> str:
    return _kernel() + f""", sums as (
  select sigma, slide_id, ct1, ct2, {side}, sum(k) as s from k group by all
), nk as (
  select k.sigma, k.slide_id, k.ct1, k.ct2, case when s > 1e-4 then k / s else k end as k from k join sums using (sigma, slide_id, ct1, ct2, {side})
)
{_SUMS.format("(select * from nk where k >= 1e-7)")}"""


def _bidir(normalize: bool, filtered: bool = True, within: bool = False, mean: bool = False, start: str | None = None, cut: float | None = None, no_variation: str = "0") -> str:
    """Both correlations over cells that have neighbours in the filtered kernel, or over all cells. start: another beginning, up to the table scores."""
    cut = cut or (5e-3 if within else 5e-2)
    if filtered and within:
        keep = f"""f as (
  select k.* from k
  where exists (select 1 from ok where ok.sigma = k.sigma and ok.slide_id = k.slide_id and ok.ct1 = k.ct1 and ok.c = k.i)
    and exists (select 1 from ok where ok.sigma = k.sigma and ok.slide_id = k.slide_id and ok.ct1 = k.ct1 and ok.c = k.j)
)"""
        keep = f"""ok as (
  select r.sigma, r.slide_id, r.ct1, r.i as c from (select sigma, slide_id, ct1, i from k group by all having sum(k) > {cut}) r
  join (select sigma, slide_id, ct1, j from k group by all having sum(k) > {cut}) c on r.sigma = c.sigma and r.slide_id = c.slide_id and r.ct1 = c.ct1 and r.i = c.j
), """ + keep
    elif filtered:
        keep = f"""rowed as (
  select k.* from k join (select sigma, slide_id, ct1, ct2, i from k group by all having sum(k) > {cut}) r using (sigma, slide_id, ct1, ct2, i)
), f as (
  select rowed.* from rowed join (select sigma, slide_id, ct1, ct2, j from rowed group by all having sum(k) > {cut}) c using (sigma, slide_id, ct1, ct2, j)
)"""
    else:
        keep = "f as (select * from k)"
    by_row, by_col = ("f.k / r.s", "f.k / c.s") if normalize else ("f.k", "f.k")
    blocks = "blocks as (select distinct sigma, slide_id, ct1, ct2 from k)"
    how = "join" if filtered else "left join"
    rounded = "avg(bidir)" if mean else "bidir"
    return (start or f"{_kernel(within)}, {SCORES}") + f""", {blocks}, {keep}, w as (
  select f.sigma, f.slide_id, f.ct1, f.ct2, f.i, f.j, {by_row} as kr, {by_col} as kc
  from f join (select sigma, slide_id, ct1, ct2, i, sum(k) as s from f group by all) r using (sigma, slide_id, ct1, ct2, i)
  join (select sigma, slide_id, ct1, ct2, j, sum(k) as s from f group by all) c using (sigma, slide_id, ct1, ct2, j)
), ka as (
  select w.sigma, w.slide_id, w.ct1, w.ct2, w.j, a.cc, sum(kr * a.score) as v from w join scores a on a.cell_id = w.i group by all
), kb as (
  select w.sigma, w.slide_id, w.ct1, w.ct2, w.i, b.cc, sum(kc * b.score) as v from w join scores b on b.cell_id = w.j group by all
), one as (
  select b.sigma, b.slide_id, b.ct1, b.ct2, s.cc, case when count(*) < 2 then 1 when stddev_pop(coalesce(ka.v, 0)) * stddev_pop(s.score) < 1e-12 then {no_variation} else corr(coalesce(ka.v, 0), s.score) end as c1 from blocks b join scores s on s.slide_id = b.slide_id and s.cell_type = b.ct2
  {how} ka on ka.sigma = b.sigma and ka.slide_id = b.slide_id and ka.ct1 = b.ct1 and ka.ct2 = b.ct2 and ka.j = s.cell_id and ka.cc = s.cc group by all
), two as (
  select b.sigma, b.slide_id, b.ct1, b.ct2, s.cc, case when count(*) < 2 then 1 when stddev_pop(coalesce(kb.v, 0)) * stddev_pop(s.score) < 1e-12 then {no_variation} else corr(coalesce(kb.v, 0), s.score) end as c2 from blocks b join scores s on s.slide_id = b.slide_id and s.cell_type = b.ct1
  {how} kb on kb.sigma = b.sigma and kb.slide_id = b.slide_id and kb.ct1 = b.ct1 and kb.ct2 = b.ct2 and kb.i = s.cell_id and kb.cc = s.cc group by all
), both_ways as (
  select sigma, slide_id, ct1, ct2, cc, (c1 + c2) / 2 as bidir from one join two using (sigma, slide_id, ct1, ct2, cc)
)
select sigma, {"" if mean else "slide_id, "}ct1, ct2, cc, round({rounded}, 6) + 0 as bidir from both_ways {"group by sigma, ct1, ct2, cc" if mean else ""}"""


WHITENED = _kernel(True, "0.05") + f""", {SIZES}, dense as (
  select a.slide_id, a.cell_type as t, a.cell_id as i, b.cell_id as j, coalesce(k.k, 0) as k
  from cells a join cells b on a.slide_id = b.slide_id and a.cell_type = b.cell_type left join k on k.i = a.cell_id and k.j = b.cell_id
), kc as (
  select *, k - avg(k) over (partition by slide_id, t, i) - avg(k) over (partition by slide_id, t, j) + avg(k) over (partition by slide_id, t) as c from dense
), r as (
  select a.slide_id, a.t, a.i, a.j, (a.k + b.k) / 2 as k from dense a join dense b on a.i = b.j and a.j = b.i
), half as (
  select r.slide_id, r.t, r.i as p, kc.j, sum(r.k * kc.c) as h from r join kc on r.j = kc.i group by all
), m as (
  select half.slide_id, half.t, p, r.j as q, sum(h * r.k) as m from half join r on half.j = r.i group by all
)
select 0.05::double as sigma, m.slide_id, m.t as ct1, m.t as ct2, round(sqrt(greatest(sum(m * c), 0)), 5) + 0 as norm from m join kc on m.p = kc.i and m.q = kc.j group by m.slide_id, m.t"""

LONG = "long as (select slide_id, cell_type, cell_id, (g - 1)::integer as gene, features[g]::double as value from cells, range(1, 65) r(g))"


def _long8(t: str) -> str:
    return f"select cell_id, gene, value from long where cell_type = '{t}' and gene < 8"


QUANTILES = f"""with {CELLS}, {LONG}, ref as ({_long8("T0")}), tar as ({_long8("T1")}), placed as (
  select cell_id, gene, percent_rank() over (partition by gene order by value) * ((select count(*) from ref where ref.gene = tar.gene) - 1) as h from tar
), ordered as (
  select gene, value as v, row_number() over (partition by gene order by value) - 1 as at from ref
), normalized as (
  select cell_id, placed.gene, lo.v + (h - floor(h)) * (coalesce(hi.v, lo.v) - lo.v) as value
  from placed join ordered lo on lo.gene = placed.gene and lo.at = floor(h) left join ordered hi on hi.gene = placed.gene and hi.at = floor(h) + 1
)"""
WEIGHTS8 = "weights as (select g::integer as gene, 1::integer as cc, (g - 3) / 10.0::double as w from range(8) r(g))"
STATS8 = "stats as (select gene, avg(value) as m, case when stddev_samp(value) < 1e-8 then 1 else stddev_samp(value) end as s from ref group by gene)"


#: Scores of all genes, standardised by the first type, for both types.
CARRIED = f"""{LONG}, genes as (
  select gene, avg(value) as m, case when stddev_samp(value) < 1e-8 then 1 else stddev_samp(value) end as s, (gene - 3) / 10.0::double as w from long where cell_type = 'T0' group by gene
), scores as (
  select slide_id, cell_type, cell_id, 1::integer as cc, sum((value - m) / s * w) as score from long join genes using (gene) where abs(w) > 0 group by slide_id, cell_type, cell_id
)"""
MORPHOLOGY = _low(False) + """, scaled as (
  select n.slide_id, n.ct1, n.ct2, i, j, greatest(d, low) * (0.01 / (select min(low) from lows)) as d from nonzero n join lows using (slide_id, ct1, ct2)
), joined as (
  select s.*, hops from scaled s left join {last} using (slide_id, i, j)
), fit as (
  select slide_id, ct1, ct2, count(*) as n, regr_slope(d, hops) as slope, regr_intercept(d, hops) as intercept from joined where hops <= 4 group by all
), most as (
  select slide_id, ct1, ct2, max(d) as m from joined group by all
), moved as (
  select slide_id, ct1, ct2, case when hops is null and n >= 10 and d < intercept + slope * 3 then m else d end as d from joined left join fit using (slide_id, ct1, ct2) join most using (slide_id, ct1, ct2)
)
select slide_id, ct1, ct2, count(*) as n, round(avg(d), 6) + 0 as mean_d, round(max(d), 6) + 0 as most_d from moved group by slide_id, ct1, ct2"""


def _knn(k: int) -> str:
    return f"near as (select slide_id, i, j, d, row_number() over (partition by slide_id, i order by d, j) as rank from everything qualify row_number() over (partition by slide_id, i order by d, j) <= {k})"


def _hops(k: int, most: int, until: str) -> str:
    steps = [f"edges as (select slide_id, i, j from near union select slide_id, j, i from near), h1 as (select slide_id, i, j from edges)"]
    for n in range(2, most + 1):
        steps.append(f"h{n} as (select distinct a.slide_id, a.i, e.j from h{n - 1} a join edges e on a.slide_id = e.slide_id and a.j = e.i where a.i <> e.j and not exists (select 1 from before{n - 1} b where b.i = a.i and b.j = e.j and b.slide_id = a.slide_id))")
        steps.append(f"before{n} as (select * from before{n - 1} union all select slide_id, i, j, {n} as hops from h{n})")
        if n == 2:
            steps.insert(1, "before1 as (select slide_id, i, j, 1 as hops from h1)")
    return f"with {CELLS}, {ALL}, {_knn(k)}, {', '.join(steps)}, {until.format(last=f'before{most}')}"


def _binned(nx: int, ny: int) -> str:
    one = lambda c, n: f"case when max({c}) over w > min({c}) over w then least(greatest(ceil(({c} - min({c}) over w) / (max({c}) over w - min({c}) over w) * {n}), 1), {n}) else 1 end::integer"
    return f'''binned as (select slide_id, {one('x', nx)} as bx, {one('y', ny)} as "by" from cells window w as (partition by slide_id))'''


def _outliers(low: str, high: str, digits: int = 2) -> str:
    return f"""with s as (
  select l_returnflag, avg(l_extendedprice) as m, stddev_samp(l_extendedprice) as sd, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem group by 1
)
select l_returnflag, count(*) as n, count(*) filter (where not (v < {low} or v > {high})) as n_left, round(sum(v) filter (where not (v < {low} or v > {high})), {digits}) as total
from (select l_returnflag, l_extendedprice as v from lineitem) l join s using (l_returnflag) group by 1"""


# least squares on the gene's value v, x and y, by Cramer's rule over covariances
GLM = f"""with {CELLS}, {LONG}, {SCORES}, m as (
  select cell_type, cc, gene, count(*) as n, covar_pop(value, value) as vv, covar_pop(value, x) as vx, covar_pop(value, y) as vy, covar_pop(x, x) as xx, covar_pop(x, y) as xy, covar_pop(y, y) as yy,
    covar_pop(value, score) as vs, covar_pop(x, score) as xs, covar_pop(y, score) as ys
  from long join scores using (slide_id, cell_type, cell_id) join cells using (slide_id, cell_type, cell_id) group by all
)
select 0.05::double as sigma, cell_type, cc, gene, round((vs * (xx * yy - xy * xy) - vx * (xs * yy - xy * ys) + vy * (xs * xy - xx * ys))
  / (vv * (xx * yy - xy * xy) - vx * (vx * yy - xy * vy) + vy * (vx * xy - xx * vy)), 5) + 0 as estimate, n from m"""

# s1'K s2 taken out of the scores of both types, half each, then the rest out of the first
UNCORRELATED = f"""{_kernel(sigmas="0.05")}, {SCORES}, rn as (
  select sigma, slide_id, ct1, ct2, i, j, k / sum(k) over (partition by sigma, slide_id, ct1, ct2, i) as k from k
), blocks as (select distinct sigma, slide_id, ct1, ct2 from rn), one0 as (
  select b.*, s.cell_id as i, s.cc, s.score from blocks b join scores s on s.slide_id = b.slide_id and s.cell_type = b.ct1
), two0 as (
  select b.*, s.cell_id as j, s.cc, s.score from blocks b join scores s on s.slide_id = b.slide_id and s.cell_type = b.ct2
), one1 as (
  select o.*, coalesce(t, 0) as along from one0 o left join (select rn.slide_id, rn.i, two0.cc, sum(k * score) as t from rn join two0 on rn.slide_id = two0.slide_id and rn.j = two0.j group by all) x on x.slide_id = o.slide_id and x.i = o.i and x.cc = o.cc
), two1 as (
  select o.*, coalesce(t, 0) as along from two0 o left join (select rn.slide_id, rn.j, one0.cc, sum(k * score) as t from rn join one0 on rn.slide_id = one0.slide_id and rn.i = one0.i group by all) x on x.slide_id = o.slide_id and x.j = o.j and x.cc = o.cc
), step as (
  select slide_id, cc, c, nn, mm, abs(c) >= 1e-10 and nn >= 1e-10 and mm >= 1e-10 as moves
  from (select slide_id, cc, sum(score * along) as c, sum(along * along) as nn from one1 group by all) join (select slide_id, cc, sum(along * along) as mm from two1 group by all) using (slide_id, cc)
), one2 as (
  select o.sigma, slide_id, ct1, i, cc, moves, case when moves then score - c / 2 / nn * along else score end as score from one1 o join step using (slide_id, cc)
), two2 as (
  select t.sigma, slide_id, ct2, j, cc, case when moves then score - c / 2 / mm * along else score end as score from two1 t join step using (slide_id, cc)
), one3 as (
  select o.*, coalesce(t, 0) as along from one2 o left join (select rn.slide_id, rn.i, two2.cc, sum(k * score) as t from rn join two2 on rn.slide_id = two2.slide_id and rn.j = two2.j group by all) x on x.slide_id = o.slide_id and x.i = o.i and x.cc = o.cc
), residual as (
  select slide_id, cc, sum(score * along) as c, sum(along * along) as nn from one3 group by all
)
select o.sigma, slide_id, ct1 as cell_type, i as cell_id, cc, round(case when moves and abs(c) > 1e-10 and nn > 1e-10 then score - c / nn * along else score end, 5) + 0 as score from one3 o join residual using (slide_id, cc)
union all select sigma, slide_id, ct2, j, cc, round(score, 5) + 0 from two2"""


def oracle_sql() -> dict[str, str]:
    pairs = "select slide_id, ct1, ct2, count(*) as n, round(sum(d), 6) as sum_d from everything where d <= 0.1 group by all"
    lows = "select slide_id, ct1, ct2, round(d_min, 9) as d_min, round(low, 9) as low from lows"
    moved = lambda c, s: f"case when max({c}) over w > min({c}) over w then fmod({c} - min({c}) over w + {s} * (max({c}) over w - min({c}) over w), max({c}) over w - min({c}) over w) else {c} end"
    return {
        "subset_cells": f"with {CELLS} select cell_id, slide_id, cell_type, round(x, 9) as x, round(y, 9) as y from cells where cell_type = 'T0'",
        "cells_per_slide_type": f"with {CUSTOMERS} select slide_id, cell_type, count(*) as n_cells from cells group by all",
        "cells_summary": f"with {CELLS} select count(*) as n_cells, count(distinct cell_type) as n_types, count(distinct slide_id) as n_slides, max(len(features))::integer as n_features, round(min(x), 9) as x_min, round(max(x), 9) as x_max, round(min(y), 9) as y_min, round(max(y), 9) as y_max from cells",
        "range_join_pairs": f"with {CELLS}, {ALL} {pairs}",
        "range_join_customers": f"with {CUSTOMERS}, {ALL} {pairs}",
        "low_percentile": f"with {CELLS}, {ALL}, {_low(False)} {lows}",
        "low_percentile_within": f"with {CELLS}, {ALL}, {_low(True)} {lows}",
        "distance_scale": f"with {CELLS}, {ALL}, {_low(False)} select round(0.01 / min(low), 6) as scale from lows",
        "gaussian_kernel_sigma_sweep": f"{_kernel(clip=False)} {_SUMS.format('k')}",
        "kernel_clipped": f"{_kernel()} {_SUMS.format('k')}",
        "kernel_row_norm": _normalized("i"),
        "kernel_col_norm": _normalized("j"),
        "kernel_global_norm": _kernel() + f""", sums as (
  select sigma, slide_id, ct1, ct2, i, sum(k) as s from k group by all having sum(k) > 1e-5
), middle as (
  select sigma, slide_id, ct1, ct2, median(s) as m from sums group by all
), nk as (
  select k.sigma, k.slide_id, k.ct1, k.ct2, k / m as k from k join middle using (sigma, slide_id, ct1, ct2)
)
{_SUMS.format("(select * from nk where k >= 1e-7)")}""",
        "sigma_guard": f"""{_kernel(sigmas="0.002, 0.005, 0.01, 0.02, 0.05", clip=False)}, {SIZES}, valid as (
  select s.sigma, a.slide_id, (select count(*) from k where k.sigma = s.sigma and k.slide_id = a.slide_id and k.k > 1e-7) / (a.n * b.n) >= 2 * least(a.n, b.n) / (a.n * b.n) as ok
  from (select distinct sigma from k) s, sizes a join sizes b on a.slide_id = b.slide_id and a.cell_type = 'T0' and b.cell_type = 'T1'
)
select sigma from valid group by sigma having bool_or(ok)""",
        "self_kernel_sums": f"{_kernel(True)} {_SUMS.format('k')}",
        "centered_frobenius_norm": f"{_kernel()}, {NORMS} select sigma, slide_id, ct1, ct2, round(norm, 6) as norm from norms",
        "whitened_frobenius_norm": WHITENED,
        "norm_corr_given_scores": f"{_kernel()}, {PARTS} select sigma, slide_id, ct1, ct2, cc, round(ncorr, 6) + 0 as ncorr from ncorr",
        "norm_corr_aggregate": f"{_kernel()}, {PARTS} select sigma, ct1, ct2, cc, round(case when abs(sqrt(sum(aa)) * sqrt(sum(bb)) * avg(norm)) < 1e-9 then 0 else sum(numerator) / (sqrt(sum(aa)) * sqrt(sum(bb)) * avg(norm)) end, 6) + 0 as ncorr from parts group by sigma, ct1, ct2, cc",
        "sigma_choice": f"{_kernel()}, {PARTS} select sigma, round(avg(ncorr), 6) + 0 as mean_ncorr from ncorr where cc = 1 group by sigma order by avg(ncorr) desc, sigma limit 1",
        "bidir_corr_row_or_col": _bidir(True),
        "bidir_corr_none": _bidir(False),
        "bidir_corr_unfiltered": _bidir(True, False),
        "bidir_corr_aggregate": _bidir(True, mean=True),
        "bidir_corr_aggregate_finite": _bidir(True, mean=True, no_variation="null"),
        "self_bidir_corr": _bidir(True, within=True),
        "corr_two_types": f"""{_kernel()}, {SCORES}
select b.sigma, b.slide_id, b.ct1, b.ct2, s.cell_id as j, round(coalesce(v, 0), 6) + 0 as ak, round(s.score, 6) + 0 as b
from (select distinct sigma, slide_id, ct1, ct2 from k) b join scores s on s.slide_id = b.slide_id and s.cell_type = b.ct2 and s.cc = 1
left join (select k.sigma, k.j, sum(k * score) as v from k join scores on cell_id = i and cc = 1 group by all) a on a.sigma = b.sigma and a.j = s.cell_id""",
        "kernel_smoothed_scores": f"""{_kernel()}, {SCORES}, means as (
  select k.sigma, k.slide_id, ct1, ct2, i, cc, sum(k * score) / sum(k) as v from k join scores on cell_id = j group by k.sigma, k.slide_id, ct1, ct2, i, cc
)
select b.sigma, b.slide_id, b.ct1, b.ct2, s.cell_id as i, s.cc, round(coalesce(v, 0), 6) + 0 as smooth
from (select distinct sigma, slide_id, ct1, ct2 from k) b join scores s on s.slide_id = b.slide_id and s.cell_type = b.ct1
left join means m on m.sigma = b.sigma and m.slide_id = b.slide_id and m.ct2 = b.ct2 and m.i = s.cell_id and m.cc = s.cc""",
        "corr_one_type": f"""{_kernel(True)}, {SCORES}
select b.sigma, b.slide_id, b.ct1, b.ct2, s.cell_id as j, round(coalesce(v, 0), 6) + 0 as ak, round(s.score, 6) + 0 as b
from (select distinct sigma, slide_id, ct1, ct2 from k) b join scores s on s.slide_id = b.slide_id and s.cell_type = b.ct2 and s.cc = 1
left join (select k.sigma, k.j, sum(k * score) as v from k join scores on cell_id = i and cc = 1 group by all) a on a.sigma = b.sigma and a.j = s.cell_id""",
        "kernel_operator": f"""{_kernel()}
select k.sigma, k.slide_id, ct1, ct2, r::integer as r, c::integer as c, round(sum(k * a.features[r]::double * b.features[c]::double), 5) + 0 as value
from k join cells a on a.cell_id = i join cells b on b.cell_id = j, range(1, 5) x(r), range(1, 5) y(c) group by k.sigma, k.slide_id, ct1, ct2, r, c""",
        "default_sigma": f"{_kernel(clip=False)} select round(quantile_cont(d, 0.05), 6) + 0 as sigma from scaled where d > 0",
        "gene_glm_estimates": GLM,
        "uncorrelated_scores": UNCORRELATED,
        "kernel_float32": f"{_kernel()} select sigma, slide_id, ct1, ct2, count(*) as n, round(sum(k::float::double), 6) as sum_k from k group by all",
        "morphology_filter": _hops(5, 4, MORPHOLOGY),
        "resample_bins_kept": f"with {CELLS} select perm_id, slide_id, cell_type, count(*) as n, count(*) as n_same from cells, (select unnest(range(1, 6))::integer as perm_id) p group by all",
        "resample_toroidal_kept": f"with {CELLS} select perm_id, slide_id, cell_type, count(*) as n, count(*) as n_same, count(*) as n_sources from cells, (select unnest(range(1, 6))::integer as perm_id) p group by all",
        "transfer_bidir_corr": _bidir(True, start=f"{_kernel(sigmas='0.05')}, {CARRIED}", cut=5e-3, no_variation="null"),
        "transfer_self_bidir_corr": _bidir(True, within=True, start=f"{_kernel(True, '0.05')}, {CARRIED}", no_variation="null"),
        "insitu_median_split": f"""with {CELLS}, s as (select *, case when cell_id % 7 <> 0 then features[1]::double end as score from cells)
select cell_id, cell_type, slide_id, round(score, 6) + 0 as score, case when score is null then 'unknown_' when score > median(score) over (partition by cell_type) then 'high_' else 'low_' end || cell_type as score_label from s""",
        "regression_gene_scores": f"""with {CELLS}, {LONG}, {SCORES}
select 0.05::double as sigma, long.cell_type, gene, cc, round(case when var_pop(score) > 0 then regr_slope(value, score) else 0 end, 6) + 0 as beta from long join scores using (cell_id) group by long.cell_type, gene, cc""",
        "gene_zscore_guarded": f"with {CELLS}, {LONG} select cell_type, gene, count(*) as n, round(avg(value), 6) + 0 as mean, round(case when stddev_samp(value) < 1e-3 or avg((value <> 0)::integer) < 0.01 then 1 else stddev_samp(value) end, 6) + 0 as sd, round(avg((value <> 0)::integer), 6) + 0 as share from long group by cell_type, gene",
        "gene_prevalence_filter": f"with {CELLS}, {LONG} select gene, round(avg((value > 0)::integer), 6) as share, count(*) filter (where value > 0) as n_cells, round(quantile_cont(value, 0.98) filter (where value > 0), 6) as top from long group by gene having avg((value > 0)::integer) >= 0.008 and count(*) filter (where value > 0) >= 20",
        "quantile_clip": f"with {CELLS}, {LONG}, tops as (select gene, quantile_cont(value, 0.98) as top from long where value > 0 group by gene) select gene, round(sum(least(value, top)), 4) + 0 as total, count(*) filter (where value > top) as n_clipped from long join tops using (gene) group by gene",
        "quantile_normalize": f"{QUANTILES} select cell_id, gene, round(value, 6) + 0 as value from normalized",
        "transfer_scores": f"{QUANTILES}, {WEIGHTS8}, {STATS8} select cell_id, cc, round(sum((value - m) / s * w), 6) + 0 as score from normalized join stats using (gene) join weights using (gene) where abs(w) > 0.05 group by cell_id, cc",
        "knn": f"with {CELLS}, {ALL}, {_knn(10)} select slide_id, i, j, round(d, 9) as d, rank::integer as rank from near",
        "knn_graph": f"with {CELLS}, {ALL}, {_knn(10)} select slide_id, i as src, j as dst from near union select slide_id, j, i from near",
        "graph_hops": _hops(4, 4, "final as (select * from {last}) select slide_id, hops, count(*) as n from final group by slide_id, hops"),
        "morphology_regression": _hops(5, 6, "final as (select * from {last}) select e.slide_id, ct1, ct2, count(*) as n, round(regr_slope(d, hops), 6) as slope, round(regr_intercept(d, hops), 6) as intercept, round(regr_r2(d, hops), 6) as r2 from everything e join final using (slide_id, i, j) where ct1 = 'T0' and ct2 = 'T1' group by e.slide_id, ct1, ct2"),
        "nn_cross_fraction": f"""with {CELLS}, {ALL}, each as (
  select slide_id, ct1, i, min(d) filter (where ct1 = ct2) as own, min(d) filter (where ct1 <> ct2) as other from everything group by all
)
select slide_id, round(avg(share), 9) as fraction from (select slide_id, ct1, avg((other < own)::integer) as share from each group by all) group by slide_id""",
        "bin_diagnostics": f"""with {CUSTOMERS}, {_binned(6, 5)}, counts as (select slide_id, bx, "by", count(*) as n from binned group by all)
select slide_id, 30 as n_bins, count(*) as occupied, 30 - count(*) as empty, count(*) filter (where n < 5) as sparse, min(n) as least, max(n) as most, round(avg(n), 6) as mean, round(median(n), 6) as median, round(stddev_samp(n), 6) as sd from counts group by slide_id""",
        "neighbor_bins": f'''with {CELLS}, {_binned(8, 8)} select bx, "by", bx + i as nbx, "by" + j as nby from (select distinct bx, "by" from binned), (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as j) where bx + i between 1 and 8 and "by" + j between 1 and 8''',
        "toroidal_rank_map": f"""with {CELLS}, shifted as (
  select *, {moved("x", 0.3)} as sx, {moved("y", 0.45)} as sy from cells window w as (partition by slide_id, cell_type)
), placed as (
  select slide_id, cell_type, cell_id, row_number() over (partition by slide_id, cell_type order by x, y, cell_id) as p, row_number() over (partition by slide_id, cell_type order by sx, sy, cell_id) as q from shifted
)
select a.slide_id, a.cell_type, a.cell_id, b.cell_id as source_id from placed a join placed b on a.slide_id = b.slide_id and a.cell_type = b.cell_type and a.p = b.q""",
        "pvalues": """with o as (select l_returnflag as cc, max(l_discount) as obs from lineitem where l_quantity = 50 group by 1), c as (
  select cc, count(*) as m, count(*) filter (where l_discount >= obs) as g, count(*) filter (where l_discount <= obs) as l from o join lineitem on l_returnflag = cc where l_quantity < 50 group by cc
)
select cc, round((1 + g) / (1 + m), 9) as p_greater, round((1 + l) / (1 + m), 9) as p_less, round(least(1, 2 * least((1 + g) / (1 + m), (1 + l) / (1 + m))), 9) as p_two_sided from c""",
        "stepdown_pvalues": """with p as (
  select left(o_orderpriority, 1)::integer as cc, avg((o_totalprice > 300000)::integer) as p_raw from orders group by o_orderpriority
), q as (select cc, min(p_raw) as p_raw from p group by cc), s as (select cc, p_raw, max(p_raw) over (order by cc) as t from q)
select cc, round(p_raw, 9) + 0 as p_raw, round(t, 9) + 0 as p_stepdown, t <= 0.4 as significant from s""",
        "sign_flip_exact": """with e as (
  select row_number() over (order by c_nationkey) - 1 as bit, effect from (select c_nationkey, avg(c_acctbal) - 4400 as effect from customer where c_nationkey < 12 group by 1)
), m as (
  select pattern, avg(case when (pattern >> bit) & 1 = 1 then -effect else effect end) as m from range((1 << (select count(*) from e))::bigint) r(pattern), e group by pattern
)
select round(any_value(o.mean_effect), 6) as mean_effect, any_value(o.n) as n, round(avg((m >= o.mean_effect - 1e-12)::integer), 6) as p from m, (select avg(effect) as mean_effect, count(*) as n from e) o""",
        "signed_log_p": "select l_orderkey, l_linenumber, round(case when l_discount - 0.05 >= 0 then -log10(greatest((l_tax + 0.001) / 2, 1e-300)) else log10(greatest((l_tax + 0.001) / 2, 1e-300)) end, 6) + 0 as score from lineitem",
        "zscore_outliers": _outliers("m - 1.5 * sd", "m + 1.5 * sd"),
        "iqr_outliers": _outliers("q1 - 0.2 * (q3 - q1)", "q3 + 0.2 * (q3 - q1)"),
        "transfer_norm_corr": f"""{_kernel(sigmas="0.05")}, {LONG}, ref as ({_long8("T0")}), {WEIGHTS8}, {STATS8}, {NORMS}, scores as (
  select slide_id, cell_type, cell_id, cc, sum((value - m) / s * w) as score from long join stats using (gene) join weights using (gene) where abs(w) > 0 group by all
), squares as (select slide_id, cell_type, cc, sum(score * score) as s from scores group by all), parts as (
  select k.sigma, k.slide_id, k.ct1, k.ct2, a.cc, sum(k.k * a.score * b.score) as numerator from k join scores a on a.cell_id = k.i join scores b on b.cell_id = k.j and b.cc = a.cc group by all
)
select p.sigma, p.slide_id, p.ct1, p.ct2, p.cc, round(numerator / (sqrt(a.s) * sqrt(b.s) * norm), 6) + 0 as ncorr from parts p
join squares a on a.slide_id = p.slide_id and a.cell_type = p.ct1 and a.cc = p.cc join squares b on b.slide_id = p.slide_id and b.cell_type = p.ct2 and b.cc = p.cc join norms n on n.sigma = p.sigma and n.slide_id = p.slide_id and n.ct1 = p.ct1 and n.ct2 = p.ct2""",
    }
