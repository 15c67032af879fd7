"""One regression per group, for any number of groups.

Like ``fe.fit_models(by=...)``, but nothing of a group reaches the driver: the
FEs are interacted with the group, all groups are pruned and absorbed in the
same passes, the cross products of a group are one row, the k x k solves run on
these rows inside the tasks, and estimates, scores, the sandwich and the degrees
of freedom are joined by group.  The result is a DataFrame.

Defined results: a group that is not identified, or has no variance estimate,
has null values; a group without rows after pruning is missing; rows with a null
group take no part.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpanel.functions import dist
from sparkpanel.operators import fe, fe_levels
from sparkpanel.session import ship

_RESULT = ("position int, term string, estimate double, std_error double, t double, ci_lo double, ci_hi double, omitted boolean, n long, n_clusters long, dof_k long")


@lru_cache(10_000)
def quantile(df: int) -> float:
    return dist.t_ppf(0.975, df)


def degrees_of_freedom(cells: DataFrame, fes: list[list[str]], cluster: list[str], by: str) -> DataFrame:
    """(by, taken): what the FEs take in every group; the rule of ``fe_levels.absorbed`` as columns."""
    count = lambda cols: F.count_distinct(*[F.col(c) for c in dict.fromkeys(cols)])
    open_ = [i for i, f in enumerate(fes) if not (cluster and set(cluster) <= set(f))]
    aggs = [count(fes[i]).alias(f"l{i}") for i in open_] + [count([*fes[i], *cluster]).alias(f"c{i}") for i in open_ if cluster]
    pairs = [(i, j) for i in open_ for j in open_ if i < j]
    aggs += [count([*fes[i], *fes[j]]).alias(f"p{i}_{j}") for i, j in pairs]
    out = cells.groupBy(by).agg(*(aggs or [F.count("*").alias("__all")]))
    for i, j in pairs:
        own, other = ([*dict.fromkeys([by, *fes[x]])] for x in (i, j))
        part = fe_levels.components(cells.select(*dict.fromkeys([*own, *other])), own, other)
        out = out.join(part.groupBy(by).agg(F.count_distinct("component").alias(f"m{i}_{j}")), by)
    free = {i: F.col(f"l{i}") != F.col(f"c{i}") if cluster else F.lit(True) for i in open_}
    total = F.lit(0).cast("long")
    for j in open_:
        redundant = [F.when(free[i], F.col(f"m{i}_{j}")).otherwise(0) for i in open_ if i < j]
        less = F.greatest(*redundant, F.lit(0)) if redundant else F.lit(0)
        total = total + F.when(free[j], F.col(f"l{j}") - less).otherwise(0)
    return out.select(by, total.alias("__taken"))


def fit_groups(df: DataFrame, spec: fe.Spec, fes, cluster, by: str, sample: Column | None = None, prune_singletons: bool = True) -> DataFrame:
    """by, position, term, estimate, std_error, t, ci_lo, ci_hi, omitted, n, n_clusters, dof_k: ``spec`` fitted in every group, errors clustered."""
    cols, ccols = spec.cols(), fe._fe_cols(cluster)
    X = [*spec.endog, *spec.exog]
    m, k = len(cols), len(X)
    fes_g = [[*dict.fromkeys([*fe._fe_cols(f), by])] for f in fes]
    d, cells = fe._sample(df, cols, [tuple(f) for f in fes_g], ccols, sample, prune_singletons, extra=[by])
    ship(df.sparkSession)
    # an FE that a finer one explains, by the data, leaves the same residuals (of equal ones the first stays)
    pairs = [(i, j) for i in range(len(fes_g)) for j in range(i + 1, len(fes_g))]
    both = {ij: tuple(dict.fromkeys([*fes_g[ij[0]], *fes_g[ij[1]]])) for ij in pairs}
    levels = fe._count_levels(cells, list(dict.fromkeys([*map(tuple, fes_g), *both.values()])))
    n_levels = lambda f: levels[fe._fe_name(tuple(f))]
    coarse = {j if n_levels(both[i, j]) == n_levels(fes_g[i]) else i for i, j in pairs if n_levels(both[i, j]) in (n_levels(fes_g[i]), n_levels(fes_g[j]))}
    absorbed = [tuple(f) for i, f in enumerate(fes_g) if i not in coarse]
    absorber = fe._Absorber(d, cols, absorbed, levels=levels)
    r = absorber.run()
    upper = [(i, j) for i in range(m) for j in range(i, m)]
    products = r.groupBy(by).agg(F.array(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in upper]).alias("__x"))
    raw = d.groupBy(by).agg(F.count("*").alias("__n"), F.array(*[F.coalesce(F.var_pop(c), F.lit(0.0)) for c in cols]).alias("__v"))
    keyed = d.schema[by]

    def solve(batches):
        for batch in batches:
            out = []
            for x, n, v in zip(*(batch.column(c).to_pylist() for c in ("__x", "__n", "__v"))):
                M = np.zeros((m, m))
                M[tuple(zip(*upper))] = x
                M = M + np.triu(M, 1).T
                try:
                    f = fe._estimate(M, np.array(v) * n, spec, cols)
                except ValueError:                  # not identified
                    out.append(([0.0] * k, [0.0] * (m * k), [0.0] * (k * k), []))
                    continue
                bread = np.zeros((k, k))
                bread[np.ix_(f["place"], f["place"])] = f["bread"]
                out.append((f["beta"].tolist(), f["Pi"].ravel().tolist(), bread.ravel().tolist(), f["place"]))
            kinds = [pa.list_(pa.float64())] * 3 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column("__n"), *[pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]],
                                             names=[by, "__n", "__beta", "__pi", "__bread", "__place"])

    kind = f"`{by}` {keyed.dataType.simpleString()}, __n long"
    fits = fe.cut_lineage(products.join(raw, by).mapInArrow(solve, f"{kind}, __beta array<double>, __pi array<double>, __bread array<double>, __place array<int>"))
    rows = r.join(fits.select(by, "__beta", "__pi"), by)
    u = F.col(spec.y) - sum((F.col("__beta")[a] * F.col(c) for a, c in enumerate(X)), F.lit(0.0))
    hat = [sum((F.col("__pi")[w * k + a] * F.col(c) for w, c in enumerate(cols)), F.lit(0.0)) for a in range(k)]
    scores = rows.groupBy(by, *[c for c in ccols if c != by]).agg(*[F.sum(hat[a] * u).alias(f"__s{a}") for a in range(k)])
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    meat = scores.groupBy(by).agg(F.count("*").alias("__g"), F.array(*[F.sum(F.col(f"__s{a}") * F.col(f"__s{b}")) for a, b in pairs]).alias("__meat"))
    if not set(ccols) <= set(cells.columns):
        cells = d.groupBy(*dict.fromkeys([*[c for f in fes_g for c in f], *ccols])).agg(F.count("*").alias("__n"))
    whole = fits.select(by, "__n", "__beta", "__bread", "__place").join(meat, by).join(degrees_of_freedom(cells, fes_g, ccols, by), by)

    def sandwich(batches):
        for batch in batches:
            out, groups = [], batch.column(by).to_pylist()
            for at, n, beta, bread, place, g, x, taken in zip(groups, *(batch.column(c).to_pylist() for c in ("__n", "__beta", "__bread", "__place", "__g", "__meat", "__taken"))):
                mt = np.zeros((k, k))
                mt[tuple(zip(*pairs))] = x
                mt = mt + np.triu(mt, 1).T
                bread = np.array(bread).reshape(k, k)
                dof = len(place) + taken
                var = None
                if g > 1 and n > dof:
                    var = np.diag(g / (g - 1.0) * (n - 1.0) / (n - dof) * bread @ mt @ bread)
                for a, term in enumerate(X):
                    if a not in place:
                        out.append((at, a + 1, term, *[None] * 5, True, n, g, dof))
                        continue
                    se = None if var is None else float(np.sqrt(max(var[a], 0.0)))
                    if se:
                        half = quantile(g - 1) * se
                        out.append((at, a + 1, term, beta[a], se, beta[a] / se, beta[a] - half, beta[a] + half, False, n, g, dof))
                    else:
                        out.append((at, a + 1, term, beta[a], se, *[None] * 3, False, n, g, dof))
            types = [batch.schema.field(by).type, pa.int32(), pa.string(), *[pa.float64()] * 5, pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            cells_ = list(zip(*out)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells_, types)], names=[by, *[x.split()[0] for x in _RESULT.split(", ")]])

    result = fe.cut_lineage(whole.mapInArrow(sandwich, f"`{by}` {keyed.dataType.simpleString()}, {_RESULT}"))
    absorber.release()
    return result
