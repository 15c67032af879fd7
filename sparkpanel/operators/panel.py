"""Panel construction and derived variables.

All builders are group-bys and joins over the event-level tables; skeletons
are generated per unit with ``sequence`` + ``explode`` (never a cross join),
and a data-derived scalar threshold is one aggregate row turned into a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpanel.functions import missing as M
from sparkpanel.operators.merge import with_group_stats


def build_panel(events: DataFrame, unit: str, time: str, measures: dict[str, Column],
                units: DataFrame | None = None, time_range: tuple[int, int] | None = None,
                fill: dict | None = None) -> DataFrame:
    """Unit x time aggregates; with ``units`` + ``time_range`` a balanced
    skeleton (every unit in every period), absent cells filled from ``fill``."""
    agg = events.groupBy(unit, time).agg(*[e.alias(n) for n, e in measures.items()])
    if units is None:
        return agg
    lo, hi = time_range
    skel = units.select(unit).distinct().select(unit, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias(time))
    out = skel.join(agg, [unit, time], "left")
    fill = fill if fill is not None else {n: 0 for n in measures}
    return out.select(unit, time, *[F.coalesce(F.col(n), F.lit(fill[n])).alias(n) if n in fill else F.col(n)
                                    for n in measures])


def keep_years(df: DataFrame, time: str, lo: int, hi: int, missing: str = "stata") -> DataFrame:
    """P5: ``drop if time < lo | time > hi``; a missing year counts as large (dropped)."""
    return df.filter(~(M.lt(F.col(time), F.lit(lo), missing) | M.gt(F.col(time), F.lit(hi), missing)))


def keep_equal(df: DataFrame, col: str, value) -> DataFrame:
    """P5: ``keep if col == value`` (false for missing)."""
    return df.filter(F.coalesce(F.col(col) == F.lit(value), F.lit(False)))


def group_max(df: DataFrame, unit: str, col: str, name: str | None = None) -> DataFrame:
    """A1: ``bysort unit: egen name = max(col)``."""
    return with_group_stats(df, [unit], **{name or f"{col}_max": F.max(col)})


def period_mean(df: DataFrame, unit: str, time: str, x: str, lo: int, hi: int, name: str) -> DataFrame:
    """A2: unit mean of ``x`` over ``lo <= time <= hi`` (inclusive), on every row."""
    return period_means(df, unit, time, x, {name: (lo, hi)})


def period_means(df: DataFrame, unit: str, time: str, x: str, periods: dict) -> DataFrame:
    """A2 for several periods at once: one aggregate and one join back.

    ``periods`` maps output name -> (lo, hi); periods may overlap (1981 can be
    in both, as in the reference).
    """
    return with_group_stats(df, [unit], **period_mean_columns(time, x, periods))


def period_mean_columns(time: str, x: str, periods: dict) -> dict[str, Column]:
    """The aggregates of ``period_means``, to be attached together with other group statistics."""
    return {name: F.avg(M.cond(M.inrange(F.col(time), lo, hi), F.col(x))) for name, (lo, hi) in periods.items()}


def scalar(df: DataFrame, expr: Column):
    """One data-derived scalar (one aggregate row) for use as a literal."""
    return df.agg(expr.alias("v")).first()["v"]


def flag_gt(df: DataFrame, col: str, threshold, name: str, missing: str = "stata") -> DataFrame:
    """0/1 flag ``col > threshold``; a missing value counts as large (Stata)."""
    thr = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    cond = M.gt(F.col(col), thr, missing)
    return df.withColumn(name, cond.cast("int") if missing == "null" else M.flag(cond))


def period_flag(df: DataFrame, time: str, after: int, name: str = "after") -> DataFrame:
    """P10: ``after = time > cutoff`` (missing year counts as after)."""
    return df.withColumn(name, M.flag(M.gt(F.col(time), F.lit(after))))


def one_hot(df: DataFrame, col: str, levels, prefix: str) -> DataFrame:
    """One 0/1 column per level (``tabulate, generate``): prefix1..prefixK.

    ``levels`` None: the distinct non-missing values in rising order (as many columns as values).
    """
    if levels is None:
        levels = sorted(r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().collect())
    return df.withColumns({f"{prefix}{i}": (F.col(col) == F.lit(v)).cast("int")
                           for i, v in enumerate(levels, start=1)})


def interact(df: DataFrame, xs: dict[str, str], dummies: list[str]) -> DataFrame:
    """Product of every x with every dummy; ``xs`` maps x column -> output prefix."""
    new = {}
    for x, prefix in xs.items():
        for i, dmy in enumerate(dummies, start=1):
            new[f"{prefix}{i}"] = F.col(x) * F.col(dmy)
    return df.withColumns(new)


def intensive_margin(df: DataFrame, unit: str, time: str, count: str, before: int,
                     name: str = "intensive") -> DataFrame:
    """Unit has at least one year with ``count > 0`` before ``before``."""
    cond = (F.col(count) > 0) & M.lt(F.col(time), F.lit(before))
    out = with_group_stats(df, [unit], __years=F.sum(M.flag(cond)))
    return out.withColumn(name, (F.col("__years") >= 1).cast("int")).drop("__years")


def shift_share(shares: DataFrame, shocks: DataFrame, unit: str, cat: str, time: str,
                share: str = "share", shock: str = "shock", name: str = "z", log: bool = True) -> DataFrame:
    """Sum over categories of share(unit, cat) * shock(cat, time).

    The shock table has (categories x periods) rows; AQE broadcasts it when it is
    small, otherwise the join shuffles on the category.
    """
    j = shares.join(shocks, cat)
    z = j.groupBy(unit, time).agg(F.sum(F.col(share) * F.col(shock)).alias(name))
    return z.withColumn(name, F.ln(name)) if log else z


def shares_of(df: DataFrame, unit: str, cat: str, value: str, name: str = "share") -> DataFrame:
    """Share of each category in a unit's total value (two-level group-by); NULL where the total is 0."""
    per = df.groupBy(unit, cat).agg(F.sum(value).alias("__v"))
    tot = per.groupBy(unit).agg(F.sum("__v").alias("__t"))
    return per.join(tot, unit).select(unit, cat, F.try_divide("__v", "__t").alias(name))


def hhi(df: DataFrame, market: str, firm: str, value: str) -> DataFrame:
    """I4: Herfindahl index per market = sum of squared firm shares, and 1 - HHI."""
    s = shares_of(df, market, firm, value)
    return (s.groupBy(market).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"),
                                  F.count(F.lit(1)).alias("n_firms"))
            .withColumn("competition", 1.0 - F.col("hhi")))


def competition_weighted(df: DataFrame, unit: str, cat: str, firm: str, value: str,
                         name: str = "comp_wtd") -> DataFrame:
    """I4 (unit level): weighted mean over categories of 1 - HHI(category), with
    weights = the unit's share of its own value in each category.

    Two group-bys build the category HHI (categories x firms -> categories); the
    unit weights are another two-level group-by; the HHI table has one row per
    category and is joined to the (unit, category) weights.
    """
    conc = hhi(df, cat, firm, value).select(cat, "competition")
    w = shares_of(df, unit, cat, value, "weight")
    return (w.join(conc, cat)
            .groupBy(unit).agg(F.sum(F.col("weight") * F.col("competition")).alias(name)))
