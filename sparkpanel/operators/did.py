"""Difference-in-differences, parallel trends, trend table, event study.

All are two-way fixed-effects regressions through ``fe.fe_regress``; the
regressors are column expressions built on the panel (no data leaves Spark).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpanel.functions import missing as M
from sparkpanel.operators import fe
from sparkpanel.operators.panel import period_means
from sparkpanel.operators.ranks import summarize_detail
from sparkpanel.session import cut_lineage


def surge_treatment(panel: DataFrame, unit: str, time: str, x: str, period1: tuple[int, int],
                    period2: tuple[int, int], after: int, rule: str = "median",
                    missing: str = "stata") -> DataFrame:
    """P7-P10 + A2 + A3 + P9: surge = mean over period2 - mean over period1 per unit;
    treated = surge above a threshold computed over rows (county-years), with a
    missing surge counted as large; after = time > cutoff; treatment = after*treated.

    ``rule``: "median" (active), "mean", "mean_sd" (mean + sd), "mean_half_sd".
    """
    d = period_means(panel, unit, time, x, {"mean_spend1": period1, "mean_spend2": period2})
    d = d.withColumn("surge", F.col("mean_spend2") - F.col("mean_spend1"))
    d = cut_lineage(d)   # read by the threshold and by every later estimation
    s = summarize_detail(d, "surge", percentiles=(50,)).first()
    thr = {"median": s["p50"], "mean": s["mean"], "mean_sd": s["mean"] + s["sd"],
           "mean_half_sd": s["mean"] + s["sd"] / 2.0}[rule]
    flag = M.gt(F.col("surge"), F.lit(thr), missing)
    d = d.withColumn("treated", M.flag(flag) if missing == "stata" else flag.cast("int"))
    d = d.withColumn("after", M.flag(M.gt(F.col(time), F.lit(after))))
    return d.withColumn("treatment", F.col("after") * F.col("treated"))


def did(df: DataFrame, y: str, treatment: str, unit: str, time: str, cluster: str | None = None,
        name: str = "did", prune_singletons: bool = False, **kw) -> fe.FEResult:
    """Y on treatment with unit and time FE, SE clustered by unit.  Singletons stay in the sample."""
    return fe.fe_ols(df, y, [treatment], fes=[unit, time], cluster=cluster or unit, name=name, prune_singletons=prune_singletons, **kw)


def did_ptrends(df: DataFrame, y: str, treatment: str, treated: str, after: str, unit: str, time: str,
                t0: int, name: str = "ptrends", prune_singletons: bool = False, **kw) -> tuple[fe.FEResult, float, float]:
    """Adds treated*pre*(t - t0) and treated*post*(t - t0); H0: pre slope = 0.

    Returns the model and the F (1, G-1) test with its p-value.
    """
    trend = F.col(time) - F.lit(t0)
    d = df.withColumns({
        "pre_trend": F.col(treated) * (1 - F.col(after)) * trend,
        "post_trend": F.col(treated) * F.col(after) * trend,
    })
    res = fe.fit_models(d, [fe.Spec(y, [treatment, "pre_trend", "post_trend"], name=name)], fes=[unit, time],
                        cluster=unit, residual_means_by=[treated, time], prune_singletons=prune_singletons, **kw)[0]
    f, p = res.wald_f(["pre_trend"])
    return res, f, p


def did_trends(df: DataFrame, y: str, treated: str, time: str, ptrends: fe.FEResult | None = None) -> DataFrame:
    """Observed mean outcome by treatment group and period and, given the
    parallel-trends model of ``did_ptrends``, its fitted series: the observed
    cell mean minus the model's mean residual in that cell."""
    obs = df.groupBy(treated, time).agg(F.avg(y).alias("mean_y"), F.count(F.lit(1)).alias("n"))
    if ptrends is None:
        return obs
    from sparkpanel.session import local_frame
    res = local_frame(df.sparkSession, [(int(a), int(b), m) for a, b, m, _ in ptrends.residual_means],
                      f"{treated} int, {time} int, mean_resid double")
    return (obs.join(res, [treated, time], "left")
            .withColumn("fitted_y", F.col("mean_y") - F.coalesce(F.col("mean_resid"), F.lit(0.0)))
            .drop("mean_resid"))


def event_study(df: DataFrame, y: str, treated: str, unit: str, time: str, base: int, periods,
                name: str = "event_study", prune_singletons: bool = False, **kw) -> fe.FEResult:
    """Treated x period dummies for every period except ``base``, two-way FE.

    ``periods`` are the panel's periods (a short, known list such as the years).
    """
    terms = {f"lead_lag_{t}": (F.col(treated) * (F.col(time) == F.lit(t)).cast("int")).cast("double")
             for t in periods if t != base}
    d = df.withColumns(terms)
    return fe.fe_ols(d, y, list(terms), fes=[unit, time], cluster=unit, name=name, prune_singletons=prune_singletons, **kw)
