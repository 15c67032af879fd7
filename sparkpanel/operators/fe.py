"""Multi-way fixed-effects OLS and 2SLS with cluster-robust errors.

Algorithm (Frisch-Waugh-Lovell, exact):

1. Keep the estimation sample: ``sample`` filter, rows complete in every model,
   FE and cluster column, then drop singleton FE groups until none is left (E2).
2. The FE with the most levels (the unit, usually the cluster) is absorbed by
   group means: one partially aggregated ``groupBy`` and a join back.
3. The remaining ("small") FEs are handled through their normal equations
   ``A alpha = B`` with ``A = D' M_u D`` and ``B = D' M_u V``.  ``A`` is never
   formed.  Conjugate gradient runs on the driver over a levels x columns
   matrix, and every product ``A P`` is one Spark job over the (unit, level)
   cells table.  That table is partitioned by the unit and holds at most one
   row per unit and level combination, so a hot unit stays small there.
   Nothing enumerates pairs of rows or cells.
4. One aggregate gives every cross product of the residualised columns; the
   k x k solve happens on the driver.  A second aggregate sums the scores per
   cluster and their outer products (the sandwich "meat").

OLS is the special case of 2SLS whose instruments are the regressors.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpanel.functions import dist
from sparkpanel.operators import fe_blocks, fe_levels
from sparkpanel.session import Saved, cut_lineage, local_frame

DRIVER_VALUES = 500_000   # CG vectors of up to this many doubles are kept on the driver, larger ones as Spark tables


def _fe_cols(fe) -> list[str]:
    return [fe] if isinstance(fe, str) else list(fe)


def _fe_name(fe) -> str:
    return "#".join(_fe_cols(fe))


def _uniq(xs):
    out = []
    for x in xs:
        if x not in out:
            out.append(x)
    return out


@dataclass
class FEResult:
    """Estimation result (D13): coefficients, VCE and fit statistics."""

    name: str
    kind: str
    depvar: str
    terms: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    nobs: int
    n_clusters: int | None
    dof_k: int
    rss: float
    tss_within: float
    tss_overall: float
    ymean: float
    ysd: float
    ymin: float
    ymax: float
    fes: list[str] = field(default_factory=list)
    extra: dict = field(default_factory=dict)
    extra_name: str = ""
    residual_means: list = field(default_factory=list)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.vcov), 0.0, None))

    @property
    def omitted(self) -> list[str]:
        """Terms left out because the FEs or the terms before them explain them."""
        return [t for t, b in zip(self.terms, self.beta) if np.isnan(b)]

    @property
    def df_t(self) -> int:
        return (self.n_clusters - 1) if self.n_clusters else (self.nobs - self.dof_k)

    @property
    def r2_within(self) -> float:
        return 1.0 - self.rss / self.tss_within if self.tss_within > 0 else float("nan")

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss_overall if self.tss_overall > 0 else float("nan")

    def coef(self, term: str) -> float:
        return float(self.beta[self.terms.index(term)])

    def stderr(self, term: str) -> float:
        return float(self.se[self.terms.index(term)])

    def wald_f(self, terms: list[str]) -> tuple[float, float]:
        """Wald F on ``terms`` = 0 with this model's VCE; returns (F, p).  Omitted terms are not tested."""
        idx = [self.terms.index(t) for t in terms if t not in self.omitted]
        if not idx or np.isnan(self.vcov[np.ix_(idx, idx)]).any():
            return float("nan"), float("nan")
        b = self.beta[idx]
        v = self.vcov[np.ix_(idx, idx)]
        f = float(b @ np.linalg.solve(v, b)) / len(idx)
        return f, dist.f_sf(f, len(idx), self.df_t)

    def table_rows(self, level: float = 0.95) -> list[tuple]:
        crit = dist.t_ppf(0.5 + level / 2.0, self.df_t) if self.df_t > 0 else float("nan")
        rows = []
        for i, t in enumerate(self.terms):
            b, s = float(self.beta[i]), float(self.se[i])
            if np.isnan(b):
                rows.append((self.name, i + 1, t, *[None] * 6, True))
                continue
            tv = b / s if s > 0 else float("nan")
            values = (b, s, tv, dist.t_sf2(tv, self.df_t) if not np.isnan(tv) else float("nan"), b - crit * s, b + crit * s)
            rows.append((self.name, i + 1, t, *[None if np.isnan(v) else v for v in values], False))
        return rows

    def coefficients(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        """(model, position, term, estimate, std_error, t, p, ci_lo, ci_hi, omitted); an omitted term has NULLs."""
        schema = ("model string, position int, term string, estimate double, std_error double, "
                  "t double, p double, ci_lo double, ci_hi double, omitted boolean")
        return local_frame(spark, self.table_rows(level), schema)

    def stat_rows(self) -> list[tuple]:
        vals = [("N", float(self.nobs)), ("G", float(self.n_clusters or 0)), ("K", float(self.dof_k)),
                ("r2_within", self.r2_within), ("ymean", self.ymean), ("ysd", self.ysd),
                ("ymin", self.ymin), ("ymax", self.ymax), ("rss", self.rss)]
        if self.kind == "ols":
            vals.append(("r2", self.r2))
        vals.extend((k, float(v)) for k, v in self.extra.items() if k != "group")
        return [(self.name, k, float(v)) for k, v in vals]

    def stats(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, self.stat_rows(), "model string, stat string, value double")


# ---------------------------------------------------------------------------
# sample preparation


def drop_singletons(df: DataFrame, fes) -> DataFrame:
    """Repeatedly drop rows whose level of any FE occurs once, until none is left."""
    return _prune(df, fes)[0]


def _prune(df: DataFrame, fes) -> tuple[DataFrame, DataFrame | None]:
    """E2 on cells.  Returns (checkpointed rows, surviving cells with their row counts ``n``).

    The rows are reduced once to their distinct FE combinations, which ``_peel`` thins out; the rows are filtered once, by
    a semi join with the surviving cells.
    """
    fes = list(fes)
    if not fes:
        return df, None
    keys = _uniq([c for fe in fes for c in _fe_cols(fe)])
    cells = cut_lineage(df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    left = _peel(cells, fes, keys)
    rows = df.dropna(subset=keys) if left is cells else df.join(left.select(*keys), keys, "left_semi").select(*df.columns)
    return cut_lineage(rows), left


RAKES = 3               # rounds that only take lone levels, before chains are taken whole


def _peel(cells: DataFrame, fes, keys: list[str]) -> DataFrame:
    """The cells that are left when those with a level of one row go, again and again.

    A level of exactly two rows in two cells ties these together: when one goes, the other's level is lone and it goes too.
    So after ``RAKES`` plain rounds the cells tied by such levels are grouped (connected components), and a group with a
    lone level goes as a whole, whatever the length of the chain.  Between two such rounds every branch loses its chains,
    so their number grows with the logarithm of the size.  What is left is the same in any order.  A round is checkpointed
    only if cells go.
    """
    done = 0
    while True:
        counts = [cells.groupBy(*_fe_cols(fe)).agg(F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__c")) for fe in fes]
        lone = [c.filter("__n = 1").select(*_fe_cols(fe)) for c, fe in zip(counts, fes)]
        any_lone = lone[0].select(F.lit(1)).limit(1)
        for x in lone[1:]:
            any_lone = any_lone.unionByName(x.select(F.lit(1)).limit(1))
        if not any_lone.count():
            return cells
        left = cells
        if done >= RAKES:
            left = _without_chains(cells, fes, keys, counts, lone)
        for x, fe in zip(lone, fes):
            left = left.join(x, _fe_cols(fe), "left_anti")
        cells = cut_lineage(left)
        done += 1


def _without_chains(cells: DataFrame, fes, keys: list[str], counts: list[DataFrame], lone: list[DataFrame]) -> DataFrame:
    """``cells`` without the groups that are tied together by levels of two rows and hold a lone level."""
    ties, ends = None, None
    for i, (fe, count, x) in enumerate(zip(fes, counts, lone)):
        cols = _fe_cols(fe)
        two = cells.join(count.filter("__n = 2 and __c = 2").select(*cols), cols, "left_semi")
        tie = two.select(*keys, F.concat(F.lit(f"{i}:"), F.to_json(F.struct(*cols))).alias("__level"))
        end = cells.join(x, cols, "left_semi").select(*keys)
        ties, ends = (tie, end) if ties is None else (ties.unionByName(tie), ends.unionByName(end))
    group = fe_levels.components(ties, keys, ["__level"])
    gone = group.join(ends.distinct(), keys, "left_semi").select("component").distinct()
    return cells.join(group.join(gone, "component", "left_semi").select(*keys), keys, "left_anti")


def estimation_sample(df: DataFrame, cols: list[str], fes, cluster, sample=None,
                      prune_singletons: bool = True, extra=()) -> DataFrame:
    """Rows used by the estimator (e(sample)): qualifier, complete cases, no singletons."""
    return _sample(df, cols, fes, cluster, sample, prune_singletons, extra)[0]


def _sample(df, cols, fes, cluster, sample=None, prune_singletons=True, extra=()):
    """(rows, cells of the FEs with their row counts, or None without FEs)"""
    need = _uniq(list(cols) + [c for fe in fes for c in _fe_cols(fe)] + _fe_cols(cluster or []) + list(extra))
    d = df
    if sample is not None:
        d = d.filter(sample)
    d = d.select(*need).dropna(subset=need)
    if prune_singletons:
        return _prune(d, fes)
    keys = _uniq([c for fe in fes for c in _fe_cols(fe)])
    d = cut_lineage(d)
    return d, d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else None


# ---------------------------------------------------------------------------
# absorption


LITERAL_MAX = 20_000    # levels x columns up to which CG directions travel as a folded literal
DENSE_LEVELS = 512      # up to this many small-FE levels A is formed exactly, in one job
DENSE_VALUES = 1 << 20  # doubles of the units x levels table that a task multiplies at once
MATVEC_BLOCK = 16       # columns per product job (wider rows fall out of whole-stage codegen)
STALL = 30              # CG steps without progress after which the true residual decides
RESIDUAL = 1e-8         # largest true residual (relative) that is accepted


def _count_levels(df: DataFrame, fes) -> dict:
    """Exact number of levels of every FE, in one aggregate."""
    if not fes:
        return {}
    row = df.agg(*[F.count_distinct(*[F.col(c) for c in _fe_cols(f)]).alias(f"l{i}")
                   for i, f in enumerate(fes)]).first()
    return {_fe_name(f): int(row[f"l{i}"]) for i, f in enumerate(fes)}


def _about_levels(df: DataFrame, fes) -> dict:
    """Number of levels of every FE within some percent; no level is sent."""
    def one(cols):
        present = F.lit(True)
        for c in cols:
            present = present & F.col(c).isNotNull()
        return F.approx_count_distinct(F.when(present, F.xxhash64(*cols)))

    row = df.agg(*[one(_fe_cols(f)).alias(f"l{i}") for i, f in enumerate(fes)]).first()
    return {_fe_name(f): int(row[f"l{i}"]) for i, f in enumerate(fes)}


class _Absorber:
    """Residualise model columns on several fixed effects (see module docstring)."""

    def __init__(self, d: DataFrame, cols: list[str], fes, tol: float = 1e-13, levels: dict | None = None, rows: Saved | None = None):
        self.spark = d.sparkSession
        self.cols = cols
        self.fes = list(fes)
        self.levels = levels if levels is not None else _count_levels(d, self.fes)
        self.tol = tol
        self.iterations = 0
        self.d = d
        self.rows = rows        # ``d`` in files of its own, which absorption by blocks uses up
        self._held = []

    def release(self) -> None:
        """Drop the frames persisted during absorption (results no longer need them)."""
        for h in self._held:
            h.unpersist()
        self._held = []

    def run(self) -> DataFrame:
        d, cols = self.d, self.cols
        if not self.fes:
            row = d.agg(*[F.avg(c).alias(c) for c in cols]).first()
            return d.select(*[c for c in d.columns if c not in cols],
                            *[(F.col(c) - F.lit(row[c])).alias(c) for c in cols])
        order = sorted(self.fes, key=lambda f: -self.levels[_fe_name(f)])
        unit, small = order[0], order[1:]
        ucols = _fe_cols(unit)
        if small and sum(self.levels[_fe_name(f)] for f in small) * len(cols) > DRIVER_VALUES:
            out, self.iterations, self._held = fe_blocks.solve(d, cols, ucols, [_fe_cols(f) for f in small], [self.levels[_fe_name(f)] for f in order],
                                                               lambda rz, bnorm: _Steps(rz, bnorm, self.tol), self.rows)
            return out
        # 1) demean by the unit: partial aggregate + join back
        means = d.groupBy(*ucols).agg(*[F.avg(c).alias(f"__m_{i}") for i, c in enumerate(cols)])
        other = [c for c in d.columns if c not in cols]
        d1 = (d.join(means, ucols)
              .select(*other, *[(F.col(c) - F.col(f"__m_{i}")).alias(c) for i, c in enumerate(cols)]))
        if not small:
            return d1
        # 2) global index for the levels of every small FE (DRIVER_VALUES bounds their number)
        offset = 0
        idx_cols = []
        for j, fe in enumerate(small):
            fcols = _fe_cols(fe)
            n_lv = self.levels[_fe_name(fe)]
            lv = (d.select(*fcols).distinct()
                  .withColumn(f"__s{j}", F.row_number().over(_global_order(fcols)) - 1 + offset))
            d1 = d1.join(lv, fcols)
            idx_cols.append(f"__s{j}")
            offset += n_lv
        n_small = offset
        d1 = d1.persist(StorageLevel.MEMORY_AND_DISK)   # short lineage from the checkpointed sample
        self._held.append(d1)
        # 3) cells (unit x small levels) with counts, partitioned by unit
        cells = (d1.groupBy(*ucols, *idx_cols).agg(F.count(F.lit(1)).alias("__c"))
                 .repartition(*ucols))
        cells = cells.withColumn("__nu", F.sum("__c").over(_unit_window(ucols)))
        cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
        self._held.append(cells)
        # 4) right-hand sides B = D' M_u V (and, for CG, the Jacobi preconditioner diag(A))
        rhs = self._per_level_agg(d1, idx_cols, [F.col(c) for c in cols], None)
        alpha = None
        if n_small <= DENSE_LEVELS:
            b = self._to_matrix(rhs.collect(), n_small, len(cols))
            a = self._gram(cells, ucols, idx_cols, n_small)
            alpha, _, _, spread = np.linalg.lstsq(a, b, rcond=1e-12)
            self.iterations = 1
            # where levels hang together so loosely that a cut of A's small values would be a guess, CG decides
            if n_small > 16 and ((spread > 1e-12 * spread[0]) & (spread < 1e-10 * spread[0])).any():
                alpha = None
        if alpha is None:
            # B and diag(A) in one job: a tagged union of the two small aggregates
            parts = [rhs.withColumn("__kind", F.lit(0))]
            parts += [dd.withColumn("__kind", F.lit(1)) for dd in self._diag_dfs(cells, ucols, idx_cols)]
            both = parts[0]
            for part in parts[1:]:
                both = both.unionByName(part, allowMissingColumns=True)
            rows = both.collect()
            b = self._to_matrix([r for r in rows if r["__kind"] == 0], n_small, len(cols))
            diag = np.zeros(n_small)
            for r in rows:
                if r["__kind"] == 1:
                    diag[int(r["__idx"])] += float(r["d"])
            alpha = self._cg(cells, ucols, idx_cols, b, diag)
        # 5) apply alpha: v - alpha_row + mean_u(alpha_row)
        m = len(cols)
        a_vals = self._lookup(alpha, idx_cols)
        if a_vals is None:
            adf = self._vec_df(alpha, "__a")
            cells_a = self._attach(cells, adf, idx_cols, "__a", m)
            d2 = self._attach(d1, adf, idx_cols, "__a", m)
        else:
            cells_a = cells.withColumns({f"__a{i}": e for i, e in enumerate(a_vals)})
            d2 = d1.withColumns({f"__a{i}": e for i, e in enumerate(a_vals)})
        ua = (cells_a.groupBy(*ucols)
              .agg(*[(F.sum(F.col("__c") * F.col(f"__a{i}")) / F.sum("__c")).alias(f"__ua{i}")
                     for i in range(m)]))
        d2 = d2.join(ua, ucols)
        keep = [c for c in d1.columns if c not in cols and c not in idx_cols]
        return d2.select(*keep, *[(F.col(c) - F.col(f"__a{i}") + F.col(f"__ua{i}")).alias(c)
                                  for i, c in enumerate(cols)])

    # -- helpers ------------------------------------------------------------

    @staticmethod
    def _lookup(mat: np.ndarray, idx_cols: list[str]):
        """Per column i: sum over small FEs of mat[level, i], read from one folded
        JSON literal (no table, no join).  None when the matrix is too large."""
        if mat.size > LITERAL_MAX:
            return None
        lit = F.from_json(F.lit(json.dumps(mat.tolist())), "array<array<double>>")
        rows = [F.element_at(lit, F.col(ic).cast("int") + 1) for ic in idx_cols]
        return [sum((F.element_at(r, i + 1) for r in rows), F.lit(0.0)) for i in range(mat.shape[1])]

    def _vec_df(self, mat: np.ndarray, prefix: str) -> DataFrame:
        m = mat.shape[1]
        schema = T.StructType([T.StructField("__idx", T.LongType(), False)] +
                              [T.StructField(f"{prefix}{i}", T.DoubleType(), False) for i in range(m)])
        import pandas as pd
        pdf = pd.DataFrame(mat, columns=[f"{prefix}{i}" for i in range(m)])
        pdf.insert(0, "__idx", np.arange(mat.shape[0], dtype="int64"))
        return self.spark.createDataFrame(pdf, schema)   # Arrow: decoded in the JVM

    @staticmethod
    def _attach(df: DataFrame, vec: DataFrame, idx_cols: list[str], prefix: str, m: int) -> DataFrame:
        """Add ``prefix{i}`` = sum over small FEs of vec[level]."""
        out = df
        for j, ic in enumerate(idx_cols):
            renamed = vec.select(F.col("__idx").alias(ic), *[F.col(f"{prefix}{i}").alias(f"{prefix}{i}_{j}")
                                                            for i in range(m)])
            out = out.join(renamed, ic, "left")
        return out.select(*df.columns, *[
            sum((F.coalesce(F.col(f"{prefix}{i}_{j}"), F.lit(0.0)) for j in range(len(idx_cols))),
                F.lit(0.0)).alias(f"{prefix}{i}") for i in range(m)])

    @staticmethod
    def _per_level_agg(df: DataFrame, idx_cols: list[str], exprs, weight) -> DataFrame:
        """(__idx, v0..): sum_{rows at level s} expr, for every level of every small FE."""
        m = len(exprs)
        vals = F.array(*[e for e in exprs]) if weight is None else F.array(*[weight * e for e in exprs])
        # evaluate the values (they may hold window expressions) before exploding,
        # otherwise the window would run over the exploded rows
        staged = df.select(*[F.col(c) for c in idx_cols], vals.alias("__v"))
        exploded = staged.select(F.explode(F.array(*[F.col(c) for c in idx_cols])).alias("__idx"), "__v")
        return exploded.groupBy("__idx").agg(*[F.sum(F.col("__v")[i]).alias(f"v{i}") for i in range(m)])

    @staticmethod
    def _to_matrix(rows, n_small: int, m: int) -> np.ndarray:
        out = np.zeros((n_small, m))
        for r in rows:
            out[int(r["__idx"])] = [r[f"v{i}"] for i in range(m)]
        return out

    @classmethod
    def _per_level_sums(cls, df: DataFrame, idx_cols: list[str], exprs, weight, n_small: int) -> np.ndarray:
        """sum_{rows at level s} expr, for every level of every small FE -> (S x m)."""
        return cls._to_matrix(cls._per_level_agg(df, idx_cols, exprs, weight).collect(), n_small, len(exprs))

    @staticmethod
    def _gram(cells: DataFrame, ucols, idx_cols: list[str], n_small: int) -> np.ndarray:
        """A = D'D - C' N_u^-1 C, from one pass over the cells: a task lays out some units x levels at a time (no pairs of cells)."""
        def run(batches):
            a, limit = np.zeros((n_small, n_small)), max(1, DENSE_VALUES // n_small)
            open_, open_n = np.zeros(n_small), 1.0      # the unit at the end of what was read, it may go on
            for batch in batches:
                first, c, nu = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("__first", "__c", "__nu"))
                ids = [batch.column(k).to_numpy() for k in idx_cols]
                if not len(c):
                    continue
                for x in ids:
                    for y in ids:
                        np.add.at(a, (x, y), c)
                at = np.cumsum(first)
                lo = 0
                while lo < len(c):
                    hi = int(np.searchsorted(at, at[lo] + limit))
                    unit = at[lo:hi] - at[lo] + int(first[lo])
                    w, n = np.zeros((int(unit[-1]) + 1, n_small)), np.ones(int(unit[-1]) + 1)
                    w[0], n[0] = open_, open_n
                    for x in ids:
                        np.add.at(w, (unit, x[lo:hi]), c[lo:hi])
                    n[unit] = nu[lo:hi]
                    open_, open_n = w[-1], n[-1]
                    a -= (w[:-1] / n[:-1, None]).T @ w[:-1]
                    lo = hi
            a -= np.outer(open_, open_) / open_n
            i, j = np.nonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(a[i, j])], names=["i", "j", "v"])

        first = (F.row_number().over(Window.partitionBy(*ucols).orderBy(*idx_cols)) == 1).cast("int").alias("__first")
        rows = cells.select(first, F.col("__c").cast("double").alias("__c"), F.col("__nu").cast("double").alias("__nu"), *idx_cols)
        out = np.zeros((n_small, n_small))
        for r in rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            out[r["i"], r["j"]] = r["v"]
        return (out + out.T) / 2.0

    @staticmethod
    def _diag_dfs(cells: DataFrame, ucols, idx_cols) -> list[DataFrame]:
        """diag(A)[s] = n_s - sum_u n_us^2 / n_u per small FE, as (__idx, d) frames (no pairs)."""
        return [(cells.groupBy(*ucols, ic).agg(F.sum("__c").alias("__nus"), F.first("__nu").alias("__nu"))
                 .groupBy(F.col(ic).alias("__idx"))
                 .agg(F.sum(F.col("__nus") - F.col("__nus") * F.col("__nus") / F.col("__nu")).alias("d")))
                for ic in idx_cols]

    def _matvec(self, cells: DataFrame, ucols, idx_cols, p: np.ndarray) -> np.ndarray:
        if p.shape[1] > MATVEC_BLOCK:
            # keep each job narrow enough for whole-stage codegen
            return np.hstack([self._matvec(cells, ucols, idx_cols, p[:, k:k + MATVEC_BLOCK])
                              for k in range(0, p.shape[1], MATVEC_BLOCK)])
        m = p.shape[1]
        vals = self._lookup(p, idx_cols)
        if vals is None:
            pc = self._attach(cells, self._vec_df(p, "__p"), idx_cols, "__p", m)
        else:
            pc = cells.withColumns({f"__p{i}": e for i, e in enumerate(vals)})
        w = _unit_window(ucols)
        centred = [F.col(f"__p{i}") - F.sum(F.col("__c") * F.col(f"__p{i}")).over(w) / F.col("__nu")
                   for i in range(m)]
        return self._per_level_sums(pc, idx_cols, centred, F.col("__c"), p.shape[0])

    def _cg(self, cells, ucols, idx_cols, b: np.ndarray, diag: np.ndarray) -> np.ndarray:
        """Jacobi-preconditioned CG on A x = b for all columns at once (one job per step)."""
        minv = np.where(diag > 1e-12 * max(diag.max(), 1.0), 1.0 / np.where(diag == 0, 1.0, diag), 0.0)[:, None]
        x, r = np.zeros_like(b), b.copy()
        z = minv * r
        p = z.copy()
        state = _Steps((r * z).sum(axis=0), np.sqrt((b * b).sum(axis=0)), self.tol)
        while state.going():
            ap = self._matvec(cells, ucols, idx_cols, p)
            step = state.step((p * ap).sum(axis=0))
            x += step * p
            r -= step * ap
            z = minv * r
            p = np.where(state.done, 0.0, z + state.beta((r * z).sum(axis=0), np.sqrt((r * r).sum(axis=0))) * p)
        self.iterations = state.n
        true = b - self._matvec(cells, ucols, idx_cols, x)
        state.verify(np.sqrt((true * true).sum(axis=0)))
        return x


class _Steps:
    """Step lengths of CG, one per column, and when to end.

    A column is done when its residual is below ``tol``, when its direction leaves
    the range of A (rounding), or after STALL steps without progress.  What counts
    is the true residual of the solution: ``verify`` raises when it is too large.
    """

    def __init__(self, rz, bnorm, tol):
        self.rz, self.bnorm, self.tol, self.n = rz, bnorm, tol, 0
        self.done = bnorm == 0
        self.best, self.since = np.full(len(bnorm), np.inf), np.zeros(len(bnorm), int)

    def going(self) -> bool:
        return not self.done.all()

    def step(self, pap):
        self.n += 1
        stop = self.done | (pap <= 0)
        self.done = stop
        return np.where(stop, 0.0, self.rz / np.where(pap == 0, 1.0, pap))

    def beta(self, rz, rnorm):
        better = rnorm < self.best
        self.since = np.where(better, 0, self.since + 1)
        self.best = np.minimum(self.best, rnorm)
        self.done = self.done | (rnorm <= self.tol * np.where(self.bnorm == 0, 1.0, self.bnorm)) | (self.since >= STALL)
        out = np.where(self.done, 0.0, rz / np.where(self.rz == 0, 1.0, self.rz))
        self.rz = rz
        return out

    def verify(self, rnorm) -> None:
        worst = float(np.max(rnorm / np.where(self.bnorm == 0, 1.0, self.bnorm), initial=0.0))
        if worst > RESIDUAL:
            raise ArithmeticError(f"fixed effects not solved: relative residual {worst:.2e} after {self.n} steps")


def _global_order(cols):
    return Window.orderBy(*cols)


def _unit_window(ucols):
    return Window.partitionBy(*ucols)


def absorb(df: DataFrame, cols: list[str], fes, tol: float = 1e-13) -> DataFrame:
    """Residualise ``cols`` on the fixed effects ``fes`` (exact, no pruning)."""
    cols, fes, levels, rows = list(cols), list(fes), None, None
    if len(fes) > 1:
        rows = Saved(df)        # several passes read it
        df = rows.frame
        about = _about_levels(df, fes)
        if (sum(about.values()) - max(about.values())) * len(cols) > 1.5 * DRIVER_VALUES:
            levels = about      # blocks, which need no exact numbers
    return _Absorber(df, cols, fes, tol=tol, levels=levels, rows=rows).run()


# ---------------------------------------------------------------------------
# estimation


def _solve_sym(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a symmetric system after scaling rows/columns to unit diagonal."""
    dg = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    s = a / np.outer(dg, dg)
    x = np.linalg.solve(s, (b.T / dg).T if b.ndim > 1 else b / dg)
    return (x.T / dg).T if x.ndim > 1 else x / dg


def _inv_sym(a: np.ndarray) -> np.ndarray:
    return _solve_sym(a, np.eye(a.shape[0]))


@dataclass
class Spec:
    """One model: dependent variable, exogenous regressors, endogenous ones and
    their excluded instruments (OLS when ``endog`` is empty)."""

    y: str
    exog: list = field(default_factory=list)
    endog: list = field(default_factory=list)
    instruments: list = field(default_factory=list)
    name: str = "model"

    def cols(self) -> list[str]:
        return _uniq([self.y] + list(self.exog) + list(self.endog) + list(self.instruments))


#: A regressor is omitted when less than this share of its variation is left by the FEs, or by the regressors before it.
COLLINEAR = 1e-9


def _independent(M: np.ndarray, raw: np.ndarray, order: list[int]) -> list[int]:
    """The columns of ``order`` that are neither absorbed (against their raw sum of squares)
    nor a combination of the ones kept before them; by elimination in that order."""
    kept: list[int] = []
    for i in order:
        if M[i, i] <= COLLINEAR * raw[i] or M[i, i] <= 0 or raw[i] <= 0:     # of a constant column the FEs may leave rounding
            continue
        rest = M[i, i]
        if kept:
            rest -= M[i, kept] @ _solve_sym(M[np.ix_(kept, kept)], M[kept, i])
        if rest > COLLINEAR * M[i, i]:
            kept.append(i)
    return kept


def _first_stage_parts(fit: dict) -> dict:
    """Of the first stages of a fit, as weights over all columns: instruments ``z`` without the exogenous terms, residuals ``e``; their moments."""
    M, endog, exog, excluded = (fit[k] for k in ("M", "endog", "exog", "excluded"))
    eye = np.eye(len(M))
    out = lambda i: eye[i] - (eye[exog].T @ _solve_sym(M[np.ix_(exog, exog)], M[exog, i]) if exog else 0)
    z, y = (np.array([out(i) for i in which]).reshape(len(which), len(M)) for which in (excluded, endog))
    zz, zy, yy = z @ M @ z.T, z @ M @ y.T, y @ M @ y.T
    pi = _solve_sym(zz, zy) if endog else np.zeros((0, 0))
    return dict(z=z, e=y - pi.T @ z if endog else y, zz=zz, yy=yy, pi=pi)


def _weak_identification(M: np.ndarray, endog: list[int], exog: list[int], excluded: list[int], dof: float) -> float:
    """Cragg-Donald F: smallest eigenvalue of the first stages' explained against unexplained variation, per instrument."""
    def without(a, b):
        if not exog:
            return M[np.ix_(a, b)]
        return M[np.ix_(a, b)] - M[np.ix_(a, exog)] @ _solve_sym(M[np.ix_(exog, exog)], M[np.ix_(exog, b)])

    zz, zx, xx = without(excluded, excluded), without(excluded, endog), without(endog, endog)
    fitted = zx.T @ _solve_sym(zz, zx)
    if dof <= 0:
        return float("nan")
    noise = (xx - fitted) / dof
    half = np.linalg.cholesky((noise + noise.T) / 2)
    inner = np.linalg.solve(half, np.linalg.solve(half, fitted).T)
    return float(np.linalg.eigvalsh((inner + inner.T) / 2).min() / len(excluded))


def _estimate(M: np.ndarray, raw: np.ndarray, s: Spec, cols: list[str]) -> dict:
    """Two-stage least squares from the cross products ``M`` of the residualised ``cols``; ``raw``: their variation before the FEs."""
    m, pos = len(cols), {c: k for k, c in enumerate(cols)}
    X = list(s.endog) + list(s.exog)
    at = lambda names: [pos[c] for c in names]
    kept = _independent(M, raw, at(list(s.exog) + list(s.endog)))
    ix = [pos[c] for c in X if pos[c] in kept]
    exog = [i for i in at(s.exog) if i in kept]
    endog = [i for i in at(s.endog) if i in kept]
    excluded = [i for i in _independent(M, raw, exog + at(s.instruments)) if i not in exog] if endog else []
    if len(excluded) < len(endog):
        raise ValueError(f"{s.name}: not identified, fewer independent instruments than endogenous regressors")
    iw, iy = exog + excluded, pos[s.y]
    XW, WW = M[np.ix_(ix, iw)], M[np.ix_(iw, iw)]
    k = len(ix)
    if k:
        Pi = _solve_sym(WW, XW.T)
        XhXh = XW @ Pi
        beta, bread = _solve_sym(XhXh, Pi.T @ M[iw, iy]), _inv_sym(XhXh)
    else:
        Pi, beta, bread = np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0))
    rss = float(M[iy, iy] - 2 * beta @ M[ix, iy] + beta @ M[np.ix_(ix, ix)] @ beta)
    # over all terms: an omitted one has coefficient 0 in fitted values and scores
    full, place = np.zeros(len(X)), [X.index(cols[i]) for i in ix]
    full[place] = beta
    Pi_all = np.zeros((m, len(X)))
    if k:
        Pi_all[np.ix_(iw, place)] = Pi
    return dict(X=X, place=place, Pi=Pi_all, beta=full, bread=bread, rss=rss, tss=float(M[iy, iy]), M=M, endog=endog, exog=exog, excluded=excluded)


def rank_statistic(zz: np.ndarray, yy: np.ndarray, pi: np.ndarray, meat: np.ndarray) -> float:
    """Robust statistic of the hypothesis that the first stages ``pi`` (instruments x endogenous) have not full rank.

    ``zz``, ``yy``: cross products of the instruments and of the endogenous terms, the exogenous ones partialled out;
    ``meat``: of the stacked scores z_l * e_j, endogenous terms outermost.  The coefficients are scaled to unit variation,
    cut by a singular value decomposition, and the part beyond rank m - 1 is weighed by its variance.
    """
    a, b = np.linalg.cholesky(zz), np.linalg.cholesky(yy)
    m = pi.shape[1]
    theta = a.T @ np.linalg.solve(b, pi.T).T
    left, _, right = np.linalg.svd(theta)
    # var vec(pi) = (I x zz^-1) meat (I x zz^-1); theta = a' pi b'^-1, hence vec(theta) = (b^-1 x a') vec(pi)
    to = np.kron(np.linalg.inv(b), np.linalg.inv(a))
    var = to @ meat @ to.T
    u, v = left[:, m - 1:], right[m - 1, :]
    u22, v22 = u[m - 1:, :], v[m - 1]
    half = lambda x: (lambda w, q: (q * np.sqrt(np.clip(w, 0, None))) @ q.T)(*np.linalg.eigh(x @ x.T))
    side = u @ np.linalg.solve(u22, half(u22))
    other = v * (abs(v22) / v22)
    take = np.kron(other[None, :], side.T)
    rest = take @ theta.T.reshape(-1)
    return float(rest @ np.linalg.solve(take @ var @ take.T, rest))


def fit_models(df: DataFrame, specs: list[Spec], fes=(), cluster=None, sample=None, by: str | None = None,
               prune_singletons: bool = True, dof: str = "pairwise", tol: float = 1e-13,
               residual_means_by: list[str] | None = None, weak_id: bool = False) -> list[FEResult]:
    """Estimate several models that share FEs, cluster and sample in one set of passes.

    Models whose complete-case sample equals the union sample share one
    absorption and one cross-product aggregate; any other model is fitted on
    its own.  ``by`` runs a separate regression per level of a (small) group
    column in the same passes: every FE is interacted with the group, so
    singleton pruning and absorption happen within groups.

    ``residual_means_by``: also return the mean residual per level of these
    columns (``result.residual_means``: list of (levels..., mean, n) rows); used
    for fitted trend series.  The columns ride along through the sample.
    """
    for s in specs:
        if len(s.instruments) < len(s.endog):
            raise ValueError(f"{s.name}: fewer instruments than endogenous regressors")
    fes = list(fes)
    ccols = _fe_cols(cluster) if cluster else []
    base = df.filter(sample) if sample is not None else df
    keys = _uniq([c for fe in fes for c in _fe_cols(fe)] + ccols + ([by] if by else [])
                 + list(residual_means_by or []))
    union = _uniq([c for s in specs for c in s.cols()])
    # project once and keep the input: the completeness check and the singleton
    # rounds then read it instead of recomputing the upstream plan
    base = base.select(*_uniq(union + keys)).persist(StorageLevel.MEMORY_AND_DISK)

    def complete(cols):
        cond = F.lit(True)
        for c in cols:
            cond = cond & F.col(c).isNotNull()
        return F.count_if(cond)

    row = base.agg(complete(union + keys).alias("u"),
                   *[complete(s.cols() + keys).alias(f"s{i}") for i, s in enumerate(specs)]).first()
    shared = [s for i, s in enumerate(specs) if row[f"s{i}"] == row["u"]]
    alone = [s for i, s in enumerate(specs) if row[f"s{i}"] != row["u"]]
    out = []
    if shared:
        out += _fit_shared(base, shared, fes, ccols, by, prune_singletons, dof, tol,
                           resid_by=residual_means_by, weak_id=weak_id)
    for i, s in enumerate(specs):
        if s in alone:
            out += _fit_shared(base, [s], fes, ccols, by, prune_singletons, dof, tol,
                               resid_by=residual_means_by, weak_id=weak_id)
    base.unpersist()
    order = {s.name: i for i, s in enumerate(specs)}
    return sorted(out, key=lambda r: (order[r.extra_name], r.extra.get("group", 0)))


def _fit_shared(df, specs, fes, ccols, by, prune_singletons, dof, tol, resid_by=None, weak_id=False) -> list[FEResult]:
    cols = _uniq([c for s in specs for c in s.cols()])
    # FEs interacted with the group when estimating by group
    fes_g = [tuple(_fe_cols(fe) + ([by] if by and by not in _fe_cols(fe) else [])) for fe in fes]
    fes_g = [fe[0] if len(fe) == 1 else fe for fe in fes_g]
    gcol = by or "__grp"
    d = df if by else df.withColumn("__grp", F.lit(0))
    ys = _uniq([s.y for s in specs])
    d, cells = _sample(d, cols, fes_g, ccols, None, prune_singletons, extra=[gcol] + list(resid_by or []))
    # per group: N, y moments and the raw variation of every column; FE levels come from the cells
    aggs = [F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(f"v{j}") for j, c in enumerate(cols)]]
    for j, y in enumerate(ys):
        aggs += [F.avg(y).alias(f"mean{j}"), F.stddev_samp(y).alias(f"sd{j}"), F.min(y).alias(f"min{j}"),
                 F.max(y).alias(f"max{j}"), F.var_pop(y).alias(f"vp{j}")]
    grows = [r.asDict() for r in d.groupBy(gcol).agg(*aggs).collect()]
    if not grows:
        raise ValueError("empty estimation sample")
    fe_lists, counts = [_fe_cols(f) for f in fes_g], {r[gcol]: {} for r in grows}
    if cells is not None:
        if not set(ccols) <= set(cells.columns):
            cells = d.groupBy(*_uniq([c for f in fe_lists for c in f] + ccols + [gcol])).agg(F.count(F.lit(1)).alias("n"))
        elif not by:
            cells = cells.withColumn(gcol, F.lit(0))
        counts = fe_levels.level_counts(cells, fe_lists, ccols, gcol)
        for r in grows:
            r.update({k: v for k, v in counts[r[gcol]].items() if k != gcol})
    groups = sorted(r[gcol] for r in grows)
    gstat = {r[gcol]: r for r in grows}
    gidx = {g: i for i, g in enumerate(groups)}
    levels = {_fe_name(f): sum(int(r[f"l{i}"]) for r in grows) for i, f in enumerate(fes_g)}
    if len(groups) > 1:
        gmap = F.create_map(*[x for g in groups for x in (F.lit(g), F.lit(gidx[g]))])
        d = d.withColumn("__gi", gmap[F.col(gcol)])
    else:
        d = d.withColumn("__gi", F.lit(0))
    # an FE that a finer one explains leaves the same residuals
    sets = [set(f) for f in fe_lists]
    coarse = fe_levels.spanned(counts, len(fes_g)) | {i for i, fs in enumerate(sets) if any(fs < o for o in sets)}
    fes_abs = [f for i, f in enumerate(fes_g) if i not in coarse]
    absorber = _Absorber(d, cols, fes_abs, tol=tol, levels=levels)
    r = absorber.run()
    # one aggregate per group: every cross product of the residualised columns
    m = len(cols)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    xrows = r.groupBy("__gi").agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"x{i}_{j}")
                                    for i, j in pairs]).collect()
    Ms = {}
    for xr in xrows:
        M = np.zeros((m, m))
        for i, j in pairs:
            M[i, j] = M[j, i] = float(xr[f"x{i}_{j}"] or 0.0)
        Ms[int(xr["__gi"])] = M
    fits = {}
    for si, s in enumerate(specs):
        for g in groups:
            raw = np.array([float(gstat[g][f"v{j}"] or 0.0) * int(gstat[g]["n"]) for j in range(m)])
            fits[(si, g)] = _estimate(Ms[gidx[g]], raw, s, cols)
    # scores: xhat_i * u_i summed per (group, cluster), then outer products per group
    def per_group(values):
        if len(groups) == 1:
            return F.lit(float(values[0]))
        return F.element_at(F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>"),
                            F.col("__gi") + 1)

    score_cols, meat_aggs, resid_aggs = [], [], []
    for si, s in enumerate(specs):
        f0 = fits[(si, groups[0])]
        X = f0["X"]
        k = len(X)
        uhat = F.col(s.y) - sum((per_group([fits[(si, g)]["beta"][a] for g in groups]) * F.col(c)
                                 for a, c in enumerate(X)), F.lit(0.0))
        for a in range(k):
            used = [w for w in range(m) if any(fits[(si, g)]["Pi"][w, a] for g in groups)]
            xhat = sum((per_group([fits[(si, g)]["Pi"][w, a] for g in groups]) * F.col(cols[w])
                        for w in used), F.lit(0.0))
            score_cols.append(F.sum(xhat * uhat).alias(f"s{si}_{a}"))
        meat_aggs += [F.sum(F.col(f"s{si}_{a}") * F.col(f"s{si}_{b2}")).alias(f"m{si}_{a}_{b2}")
                      for a in range(k) for b2 in range(a, k)]
        resid_aggs.append(F.avg(uhat).alias(f"r{si}"))
        # scores of the first stages: instrument (exogenous terms partialled out) times first-stage residual
        for g in groups if weak_id and ccols else []:
            fits[(si, g)]["first"] = _first_stage_parts(fits[(si, g)])
        if weak_id and ccols and f0["endog"] and len({(tuple(fits[(si, g)]["endog"]), tuple(fits[(si, g)]["excluded"])) for g in groups}) > 1:
            raise ValueError(f"{s.name}: groups differ in their usable instruments; fit them one by one for the weak-identification statistic")
        if weak_id and ccols and f0["endog"]:
            mix = lambda part, row: sum((per_group([fits[(si, g)]["first"][part][row][w] for g in groups]) * F.col(cols[w]) for w in range(m)
                                         if any(fits[(si, g)]["first"][part][row][w] for g in groups)), F.lit(0.0))
            pairs_ = [(e, z) for e in range(len(f0["endog"])) for z in range(len(f0["excluded"]))]
            score_cols += [F.sum(mix("z", z) * mix("e", e)).alias(f"w{si}_{n}") for n, (e, z) in enumerate(pairs_)]
            meat_aggs += [F.sum(F.col(f"w{si}_{a}") * F.col(f"w{si}_{b2}")).alias(f"wm{si}_{a}_{b2}") for a in range(len(pairs_)) for b2 in range(a, len(pairs_))]
    resid_rows = []
    if resid_by:
        resid_rows = r.groupBy("__gi", *resid_by).agg(F.count(F.lit(1)).alias("n"), *resid_aggs).collect()
    meat = {}
    if ccols:
        sc = r.groupBy("__gi", *ccols).agg(*score_cols)
        for mr in sc.groupBy("__gi").agg(F.count(F.lit(1)).alias("g"), *meat_aggs).collect():
            meat[int(mr["__gi"])] = mr
    # K: regressors + levels of FEs not nested in the cluster, less the redundant ones
    if dof == "pairwise":
        taken = fe_levels.absorbed(cells, fe_lists, counts, gcol) if cells is not None else dict.fromkeys(groups, 0)
    else:
        taken = {g: sum(r[f"l{i}"] - (dof == "levels_minus_one") for i in range(len(fes_g)) if not fe_levels.nested(r, i)) for g, r in counts.items()}
    absorber.release()
    results = []
    for si, s in enumerate(specs):
        yj = ys.index(s.y)
        for g in groups:
            f = fits[(si, g)]
            st = gstat[g]
            nobs = int(st["n"])
            place, terms = f["place"], len(f["X"])
            k = len(place)
            dof_k = k + taken[g]
            vcov = np.full((terms, terms), np.nan)
            if ccols:
                mr = meat[gidx[g]]
                G = int(mr["g"])
                mt = np.zeros((terms, terms))
                for a in range(terms):
                    for b2 in range(a, terms):
                        mt[a, b2] = mt[b2, a] = float(mr[f"m{si}_{a}_{b2}"])
                # with one cluster, or no degree of freedom left, there is no variance estimate
                if G > 1 and nobs > dof_k:
                    q = (G / (G - 1.0)) * ((nobs - 1.0) / (nobs - dof_k))
                    vcov[np.ix_(place, place)] = q * f["bread"] @ mt[np.ix_(place, place)] @ f["bread"]
            else:
                G = None
                if nobs > dof_k:
                    vcov[np.ix_(place, place)] = f["bread"] * f["rss"] / (nobs - dof_k)
            beta = np.full(terms, np.nan)
            beta[place] = f["beta"][place]
            extra = {"cg_iterations": absorber.iterations}
            name = s.name if len(groups) == 1 else f"{s.name}[{gcol}={g}]"
            if by:
                extra["group"] = g
            if f["endog"]:
                # every absorbed level counts here, nested in the cluster or not
                free = nobs - k - sum(int(st[f"l{i}"]) for i in range(len(fes_g)) if i not in coarse)
                extra["cragg_donald_F"] = _weak_identification(f["M"], f["endog"], f["exog"], f["excluded"], free)
                if weak_id and ccols:
                    first = f["first"]
                    n_w = len(f["endog"]) * len(f["excluded"])
                    wm = np.zeros((n_w, n_w))
                    for a in range(n_w):
                        for b2 in range(a, n_w):
                            wm[a, b2] = wm[b2, a] = float(meat[gidx[g]][f"wm{si}_{a}_{b2}"])
                    free = nobs - len(f["exog"]) - len(f["excluded"]) - taken[g]
                    if G > 1 and free > 0:
                        q = (G / (G - 1.0)) * ((nobs - 1.0) / free)
                        extra["robust_weak_F"] = rank_statistic(first["zz"], first["yy"], first["pi"], q * wm) / len(f["excluded"])
            res = FEResult(name=name, kind="iv" if s.endog else "ols", depvar=s.y, terms=f["X"], beta=beta,
                           vcov=vcov, nobs=nobs, n_clusters=G, dof_k=dof_k, rss=f["rss"], tss_within=f["tss"],
                           tss_overall=float(st[f"vp{yj}"]) * nobs, ymean=float(st[f"mean{yj}"]),
                           ysd=float(st[f"sd{yj}"] or 0.0), ymin=float(st[f"min{yj}"]),
                           ymax=float(st[f"max{yj}"]), fes=[_fe_name(x) for x in fes], extra=extra)
            res.extra_name = s.name
            res.residual_means = [tuple(rr[c] for c in resid_by) + (float(rr[f"r{si}"]), int(rr["n"]))
                                  for rr in resid_rows if int(rr["__gi"]) == gidx[g]] if resid_by else []
            results.append(res)
    return results


def fe_regress(df: DataFrame, y: str, exog=(), endog=(), instruments=(), fes=(), cluster=None,
               sample=None, prune_singletons: bool = True, dof: str = "pairwise", name: str = "model",
               tol: float = 1e-13) -> FEResult:
    """FE OLS (no ``endog``) or FE 2SLS (E3-E5, E7, E14) with cluster-robust VCE.

    ``dof``: "pairwise" counts the levels of FEs not nested in the cluster less the redundant ones (``fe_levels``);
    "levels" counts every such level; "levels_minus_one" subtracts one per such FE.
    """
    spec = Spec(y, list(exog), list(endog), list(instruments), name)
    return fit_models(df, [spec], fes, cluster, sample, None, prune_singletons, dof, tol)[0]


def fe_ols(df: DataFrame, y: str, x, fes=(), cluster=None, **kw) -> FEResult:
    """E3."""
    return fe_regress(df, y, exog=list(x), fes=fes, cluster=cluster, **kw)


def fe_iv(df: DataFrame, y: str, exog, endog, instruments, fes=(), cluster=None, **kw) -> FEResult:
    """Exactly or over-identified FE 2SLS."""
    return fe_regress(df, y, exog=list(exog), endog=list(endog), instruments=list(instruments),
                      fes=fes, cluster=cluster, **kw)


def first_stages(df: DataFrame, endog, exog, instruments, fes=(), cluster=None, **kw) -> list[FEResult]:
    """The first stage of every endogenous regressor, in shared passes, with the
    cluster-robust F on the excluded instruments."""
    out = fit_models(df, [Spec(e, list(instruments) + list(exog), name=f"first_{e}") for e in endog], fes, cluster, **kw)
    for res in out:
        res.extra["first_stage_F"], res.extra["first_stage_p"] = res.wald_f(list(instruments))
    return out


def first_stage(df: DataFrame, endog: str, exog, instruments, fes=(), cluster=None, name: str | None = None, **kw) -> FEResult:
    """E6 for one endogenous regressor."""
    (res,) = first_stages(df, [endog], exog, instruments, fes, cluster, **kw)
    res.name = name or res.name
    return res


def y_summary(res: FEResult) -> dict:
    """Dependent-variable summary on e(sample)."""
    return {"N": res.nobs, "mean": res.ymean, "sd": res.ysd, "min": res.ymin, "max": res.ymax}
