"""Panel-side queries on ``orders``, ``lineitem``, ``customer`` and ``part``.

Stand-ins (FIXTURES §2): county -> customer, state -> nation, year -> order
year, spending -> order value, patents -> order count.  Doubles are rounded to
6 places in both the Spark result and its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.operators import did as D
from sparkpanel.operators import fe, fe_groups
from sparkpanel.operators import merge as J
from sparkpanel.operators import panel as P
from sparkpanel.operators import ranks as R
from sparkpanel.plans import fe_sql as S
from sparkpanel.plans.panel_data import balanced_panel, orders_year, regression_panel
from sparkpanel.session import cut_lineage, local_frame
from sparkpanel.sources import load_table

QUERIES: dict = {}
ORACLES: dict = {}

# Fixed design of the stand-in difference-in-differences (FIXTURES §3.3).
PERIOD1 = (1995, 1997)
PERIOD2 = (1997, 2001)
AFTER = 1997
BASE = 1997


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- shared SQL pieces -------------------------------------------------------

PANEL_CTE = """
o AS (
  SELECT o_orderkey, o_custkey AS cust, o_totalprice, o_orderpriority,
         CAST(year(o_orderdate) AS INTEGER) AS yr
  FROM orders
), oagg AS (
  SELECT cust, yr, ln(sum(o_totalprice)) AS x, CAST(count(*) AS DOUBLE) AS no,
         CAST(count_if(o_orderpriority = '1-URGENT') AS DOUBLE) AS urg
  FROM o GROUP BY cust, yr
), li AS (
  SELECT l_orderkey, sum(l_quantity) AS q, sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc_cents,
         count(*) AS n_lines
  FROM lineitem GROUP BY l_orderkey
), lagg AS (
  SELECT o.cust, o.yr, sum(q) AS q, sum(disc_cents) / (sum(n_lines) * 100) AS avg_disc
  FROM li JOIN o ON li.l_orderkey = o.o_orderkey GROUP BY o.cust, o.yr
), panel AS (
  SELECT oagg.cust, oagg.yr, c.c_nationkey AS state, c.c_acctbal AS acctbal, x, no, urg,
         ln(1 + coalesce(lagg.q, 0)) AS y, coalesce(lagg.avg_disc, 0) AS disc
  FROM oagg LEFT JOIN lagg ON oagg.cust = lagg.cust AND oagg.yr = lagg.yr
  LEFT JOIN customer c ON c.c_custkey = oagg.cust
)"""

BALANCED_CTE = """
yrs AS (
  SELECT min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders
), skel AS (
  SELECT c_custkey AS cust, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS yr FROM customer, yrs
), oa AS (
  SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS no,
         sum(o_totalprice) AS dollars
  FROM orders GROUP BY 1, 2
), bal AS (
  SELECT skel.cust, skel.yr, coalesce(oa.no, 0) AS no, coalesce(oa.dollars, 0.0) AS dollars
  FROM skel LEFT JOIN oa ON skel.cust = oa.cust AND skel.yr = oa.yr
)"""

FLAGS_CTE = BALANCED_CTE + f""", pm AS (
  SELECT cust,
         avg(CASE WHEN yr BETWEEN {PERIOD1[0]} AND {PERIOD1[1]} THEN dollars END) AS mean_spend1,
         avg(CASE WHEN yr BETWEEN {PERIOD2[0]} AND {PERIOD2[1]} THEN dollars END) AS mean_spend2
  FROM bal GROUP BY cust
), sg AS (
  SELECT bal.*, mean_spend1, mean_spend2, mean_spend2 - mean_spend1 AS surge
  FROM bal JOIN pm ON bal.cust = pm.cust
), med AS (SELECT median(surge) AS med FROM sg
), flags AS (
  SELECT sg.*, CASE WHEN surge IS NULL OR surge > med THEN 1 ELSE 0 END AS treated,
         CASE WHEN yr IS NULL OR yr > {AFTER} THEN 1 ELSE 0 END AS after
  FROM sg, med
)"""


# --- I2 / P8 / P10 / F15 / S2: panel construction --------------------------------

@register("build_panel", f"""
WITH {PANEL_CTE}
SELECT cust, yr, state, acctbal, round(x, 6) AS x, no, urg, round(y, 6) AS y, disc,
       CASE WHEN yr > {AFTER} THEN 1 ELSE 0 END AS after
FROM panel""")
def q_build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.period_flag(regression_panel(spark, sf_dir), "yr", AFTER)
    return p.select("cust", "yr", "state", "acctbal", r6("x").alias("x"), "no", "urg",
                    r6("y").alias("y"), "disc", "after")


# --- J1-J3: merges ------------------------------------------------------------------

@register("merge_full", """
WITH l AS (
  SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n,
         sum(o_totalprice) AS dollars, true AS lf
  FROM orders GROUP BY 1, 2
), r AS (
  SELECT o_custkey AS cust, CAST(year(l_shipdate) AS INTEGER) AS yr, count(*) AS n,
         sum(l_quantity) AS q, true AS rf
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
)
SELECT CASE WHEN lf THEN l.cust ELSE r.cust END AS cust, CASE WHEN lf THEN l.yr ELSE r.yr END AS yr,
       CASE WHEN lf THEN l.n ELSE r.n END AS n, round(l.dollars, 6) AS dollars, round(r.q, 6) AS q,
       CAST(CASE WHEN lf AND rf THEN 3 WHEN lf THEN 1 ELSE 2 END AS INTEGER) AS _merge
FROM l FULL OUTER JOIN r ON l.cust IS NOT DISTINCT FROM r.cust AND l.yr IS NOT DISTINCT FROM r.yr""")
def q_merge_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders_year(spark, sf_dir)
    left = o.groupBy("cust", "yr").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("dollars"))
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")
    right = (li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "cust"), "l_orderkey")
             .groupBy("cust", F.year("l_shipdate").alias("yr"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")))
    m = J.merge(left, right, ["cust", "yr"], "1:1", check="join")
    return m.select("cust", "yr", "n", r6("dollars").alias("dollars"), r6("q").alias("q"), "_merge")


@register("merge_m1", f"""
WITH {PANEL_CTE}
SELECT p.cust, p.yr, p.no, c.c_nationkey, c.c_acctbal, c.c_mktsegment
FROM (SELECT cust, yr, no FROM panel) p JOIN customer c ON p.cust = c.c_custkey""")
def q_merge_m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir).select("cust", "yr", "no")
    cust = load_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), "c_nationkey",
                                                         "c_acctbal", "c_mktsegment")
    return J.merge(p, cust, ["cust"], "m:1", keep="match", check="join")


# --- P18 / W4 / W1 / A7 / P11 / P12: ids, ranks, buckets ----------------------------

@register("group_ids", f"""
WITH {PANEL_CTE}
SELECT cust, yr, state,
       dense_rank() OVER (ORDER BY state, yr) AS state_yr,
       dense_rank() OVER (ORDER BY cust) AS county_id
FROM panel""")
def q_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir).select("cust", "yr", "state")
    p = R.group_id(p, ["state", "yr"], "state_yr")
    return R.group_id(p, ["cust"], "county_id")


@register("global_rank", f"""
WITH {PANEL_CTE}
SELECT cust, yr, row_number() OVER (ORDER BY acctbal, cust, yr) AS _n, count(*) OVER () AS n_total
FROM panel""")
def q_global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir).select("cust", "yr", "acctbal")
    return R.global_rank(p, ["acctbal", "cust", "yr"]).select("cust", "yr", "_n", "n_total")


_BUCKET_SQL = f"""
WITH {PANEL_CTE}, b AS (
  SELECT cust, yr, x, no,
         CAST(ceil(4.0 * row_number() OVER (ORDER BY acctbal, cust, yr) / count(*) OVER ()) AS INTEGER) AS "group"
  FROM panel
)"""


@register("quantile_bucket", _BUCKET_SQL + """
SELECT cust, yr, "group",
       CAST("group" = 1 AS INTEGER) AS g1, CAST("group" = 2 AS INTEGER) AS g2,
       CAST("group" = 3 AS INTEGER) AS g3, CAST("group" = 4 AS INTEGER) AS g4,
       round(x * ("group" = 1)::INTEGER, 6) AS xg1, round(x * ("group" = 2)::INTEGER, 6) AS xg2,
       round(x * ("group" = 3)::INTEGER, 6) AS xg3, round(x * ("group" = 4)::INTEGER, 6) AS xg4,
       no * ("group" = 1)::INTEGER AS zg1, no * ("group" = 2)::INTEGER AS zg2,
       no * ("group" = 3)::INTEGER AS zg3, no * ("group" = 4)::INTEGER AS zg4
FROM b""")
def q_quantile_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir).select("cust", "yr", "acctbal", "x", "no")
    b = R.quantile_bucket(p, ["acctbal", "cust", "yr"], 4, "group")
    b = P.one_hot(b, "group", None, "g")        # levels found from the data
    b = P.interact(b, {"x": "xg", "no": "zg"}, ["g1", "g2", "g3", "g4"])
    return b.select("cust", "yr", "group", "g1", "g2", "g3", "g4", *[r6(f"xg{i}").alias(f"xg{i}") for i in range(1, 5)],
                    *[f"zg{i}" for i in range(1, 5)])


@register("tabulate", _BUCKET_SQL + """
, t AS (SELECT "group", count(*) AS freq FROM b GROUP BY "group")
SELECT "group", freq, round(CAST(100 AS DOUBLE) * freq / sum(freq) OVER (), 6) AS percent,
       round(CAST(100 AS DOUBLE) * sum(freq) OVER (ORDER BY "group" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / sum(freq) OVER (), 6) AS cum
FROM t""")
def q_tabulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir).select("cust", "yr", "acctbal")
    b = R.quantile_bucket(p, ["acctbal", "cust", "yr"], 4, "group")
    t = R.tabulate(b, "group")
    return t.select("group", "freq", r6("percent").alias("percent"), r6("cum").alias("cum"))


# --- A1 / A2 / J4 / A3 / P5 / P7 / P9: group statistics, summary, DiD flags ----------

@register("group_stats", f"""
WITH {BALANCED_CTE}, s AS (
  SELECT cust, yr, max(CAST(no > 0 AS INTEGER)) OVER (PARTITION BY cust) AS active_max,
         round(avg(CASE WHEN yr BETWEEN {PERIOD1[0]} AND {PERIOD1[1]} THEN dollars END) OVER (PARTITION BY cust), 6)
           AS mean_spend1,
         round(avg(CASE WHEN yr BETWEEN {PERIOD2[0]} AND {PERIOD2[1]} THEN dollars END) OVER (PARTITION BY cust), 6)
           AS mean_spend2
  FROM bal
)
SELECT * FROM s WHERE active_max = 1 AND yr BETWEEN {PERIOD1[0]} AND {PERIOD2[1]}""")
def q_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balanced_panel(spark, sf_dir).withColumn("active", (F.col("no") > 0).cast("int"))
    b = J.with_group_stats(b, ["cust"], active_max=F.max("active"),
                           **P.period_mean_columns("yr", "dollars", {"mean_spend1": PERIOD1, "mean_spend2": PERIOD2}))
    b = P.keep_years(P.keep_equal(b, "active_max", 1), "yr", PERIOD1[0], PERIOD2[1])
    return b.select("cust", "yr", "active_max", r6("mean_spend1").alias("mean_spend1"),
                    r6("mean_spend2").alias("mean_spend2"))


_PCTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def _pct_sql(p: int) -> str:
    return (f"(coalesce(sum(CASE WHEN (N * {p}) % 100 = 0 AND _n IN (N * {p} // 100, N * {p} // 100 + 1)"
            f" THEN v END) / 2, 0)"
            f" + coalesce(sum(CASE WHEN (N * {p}) % 100 <> 0 AND _n = N * {p} // 100 + 1 THEN v END), 0))")


# variance (~1e10) and sum (~1e8) carry float noise near 1e-5: rounded to what their size supports
@register("summarize_detail", f"""
WITH {FLAGS_CTE}, v AS (SELECT surge AS v FROM flags WHERE surge IS NOT NULL
), r AS (SELECT v, row_number() OVER (ORDER BY v) AS _n, count(*) OVER () AS N FROM v
), mom AS (
  SELECT count(*) AS N, avg(v) AS mean, stddev_samp(v) AS sd, var_samp(v) AS variance,
         min(v) AS min, max(v) AS max, sum(v) AS sum FROM v
), cm AS (
  SELECT avg(power(v.v - mom.mean, 2)) AS m2, avg(power(v.v - mom.mean, 3)) AS m3,
         avg(power(v.v - mom.mean, 4)) AS m4 FROM v, mom
), pc AS (
  SELECT {", ".join(f"{_pct_sql(p)} AS p{p}" for p in _PCTS)} FROM r
)
SELECT mom.N, round(mean, 6) AS mean, round(sd, 6) AS sd, round(variance, 0) AS variance,
       round(m3 / power(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2), 6) AS kurtosis,
       round(min, 6) AS min, round(max, 6) AS max, round(sum, 2) AS sum,
       {", ".join(f"round(p{p}, 6) AS p{p}" for p in _PCTS)}
FROM mom, cm, pc""")
def q_summarize_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balanced_panel(spark, sf_dir)
    b = P.period_means(b, "cust", "yr", "dollars", {"mean_spend1": PERIOD1, "mean_spend2": PERIOD2})
    b = b.withColumn("surge", F.col("mean_spend2") - F.col("mean_spend1"))
    s = R.summarize_detail(b, "surge", _PCTS)
    return s.select("N", r6("mean").alias("mean"), r6("sd").alias("sd"),
                    F.round("variance", 0).alias("variance"), r6("skewness").alias("skewness"),
                    r6("kurtosis").alias("kurtosis"), r6("min").alias("min"), r6("max").alias("max"),
                    F.round("sum", 2).alias("sum"), *[r6(f"p{p}").alias(f"p{p}") for p in _PCTS])


def did_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.surge_treatment(balanced_panel(spark, sf_dir), "cust", "yr", "dollars", PERIOD1, PERIOD2, AFTER)


@register("did_flags", f"""
WITH {FLAGS_CTE}
SELECT cust, yr, no, round(mean_spend1, 6) AS mean_spend1, round(mean_spend2, 6) AS mean_spend2,
       round(surge, 6) AS surge, treated, after, treated * after AS treatment
FROM flags""")
def q_did_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = did_frame(spark, sf_dir)
    return d.select("cust", "yr", "no", r6("mean_spend1").alias("mean_spend1"),
                    r6("mean_spend2").alias("mean_spend2"), r6("surge").alias("surge"),
                    "treated", "after", "treatment")


# --- I1 / I3 / I4: described constructions ------------------------------------------

@register("intensive_margin", f"""
WITH {PANEL_CTE}
SELECT cust, yr, urg,
       CAST(sum(CASE WHEN urg > 0 AND yr < {AFTER} THEN 1 ELSE 0 END) OVER (PARTITION BY cust) >= 1 AS INTEGER)
         AS intensive
FROM panel""")
def q_intensive_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir).select("cust", "yr", "urg")
    return P.intensive_margin(p, "cust", "yr", "urg", AFTER)


def _shift_share_sql(price: str) -> str:
    return f"""
WITH lx AS (
  SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS yr, p_type, {price} AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), pre AS (
  SELECT cust, p_type, sum(v) AS v FROM lx WHERE yr <= {AFTER} GROUP BY 1, 2
), sh AS (
  SELECT cust, p_type, v / nullif(sum(v) OVER (PARTITION BY cust), 0) AS share FROM pre
), shock AS (
  SELECT p_type, yr, sum(v) AS shock FROM lx GROUP BY 1, 2
)
SELECT cust, yr, round(ln(sum(share * shock)), 6) AS z
FROM sh JOIN shock ON sh.p_type = shock.p_type GROUP BY cust, yr"""


def _shift_share(spark: SparkSession, sf_dir: str, price) -> DataFrame:
    # each aggregate reduces the lines in its own tasks (categories x years, and customers x categories of the first
    # period, whose filter reaches the scan); writing the customer-category-year cells for both costs more than reading twice
    lines = _line_cust_type(spark, sf_dir).withColumn("v", price)
    shares = P.shares_of(lines.filter(F.col("yr") <= AFTER), "cust", "p_type", "v")
    shocks = lines.groupBy("p_type", "yr").agg(F.sum("v").alias("shock"))
    z = P.shift_share(shares, shocks, "cust", "p_type", "yr")
    return z.select("cust", "yr", r6("z").alias("z"))


@register("shift_share", _shift_share_sql("l_extendedprice"))
def q_shift_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shift_share(spark, sf_dir, F.col("l_extendedprice"))


@register("shift_share_zero", _shift_share_sql(f"CASE WHEN o_custkey % 50 = 0 AND year(o_orderdate) <= {AFTER} THEN 0 ELSE l_extendedprice END"))
def q_shift_share_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3 where every 50th customer has no spending before the cutoff: their shares and instruments are NULL."""
    return _shift_share(spark, sf_dir, F.when((F.col("cust") % 50 == 0) & (F.col("yr") <= AFTER), 0.0).otherwise(F.col("l_extendedprice")))


def _line_cust_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    o = orders_year(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), "cust", "yr")
    part = load_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return li.join(o, "l_orderkey").join(part, "l_partkey")


def _hhi_sql(price: str) -> str:
    return f"""
WITH v AS (
  SELECT c_nationkey AS nation, l_suppkey, sum({price}) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2
), s AS (SELECT nation, v / nullif(sum(v) OVER (PARTITION BY nation), 0) AS share FROM v)
SELECT nation, round(sum(share * share), 6) AS hhi, count(*) AS n_firms,
       round(1 - sum(share * share), 6) AS competition
FROM s GROUP BY nation"""


def _hhi(spark: SparkSession, sf_dir: str, price) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    o = load_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                                    F.col("o_custkey").alias("c_custkey"))
    c = load_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    lx = li.join(o, "l_orderkey").join(c, "c_custkey").withColumn("v", price)
    h = P.hhi(lx, "nation", "l_suppkey", "v")
    return h.select("nation", r6("hhi").alias("hhi"), "n_firms", r6("competition").alias("competition"))


@register("hhi", _hhi_sql("l_extendedprice"))
def q_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hhi(spark, sf_dir, F.col("l_extendedprice"))


@register("hhi_zero", _hhi_sql("CASE WHEN c_nationkey = 3 THEN 0 ELSE l_extendedprice END"))
def q_hhi_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 with a market whose total is 0: its index is NULL."""
    return _hhi(spark, sf_dir, F.when(F.col("nation") == 3, 0.0).otherwise(F.col("l_extendedprice")))


@register("competition_weighted", """
WITH lx AS (
  SELECT o_custkey AS cust, p_type, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), fv AS (SELECT p_type, l_suppkey, sum(l_extendedprice) AS v FROM lx GROUP BY 1, 2
), h AS (
  SELECT p_type, 1 - sum(power(v / t, 2)) AS competition
  FROM (SELECT *, sum(v) OVER (PARTITION BY p_type) AS t FROM fv) GROUP BY p_type
), cv AS (SELECT cust, p_type, sum(l_extendedprice) AS v FROM lx GROUP BY 1, 2
), w AS (SELECT cust, p_type, v / sum(v) OVER (PARTITION BY cust) AS weight FROM cv)
SELECT cust, round(sum(weight * competition), 6) AS comp_wtd FROM w JOIN h ON w.p_type = h.p_type GROUP BY cust""")
def q_competition_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice")
    o = load_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                                    F.col("o_custkey").alias("cust"))
    part = load_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lx = li.join(o, "l_orderkey").join(part, "l_partkey")
    c = P.competition_weighted(lx, "cust", "p_type", "l_suppkey", "l_extendedprice")
    return c.select("cust", r6("comp_wtd").alias("comp_wtd"))


# --- E1 / E2 / A17 / P6: estimation-sample building blocks ----------------------------

_SINGLETON_SQL = f"""
WITH {PANEL_CTE}, r0 AS (SELECT cust, yr, y FROM panel),
r1 AS (SELECT * FROM r0 WHERE cust IN (SELECT cust FROM r0 GROUP BY cust HAVING count(*) > 1)
                          AND yr IN (SELECT yr FROM r0 GROUP BY yr HAVING count(*) > 1)),
r2 AS (SELECT * FROM r1 WHERE cust IN (SELECT cust FROM r1 GROUP BY cust HAVING count(*) > 1)
                          AND yr IN (SELECT yr FROM r1 GROUP BY yr HAVING count(*) > 1)),
r3 AS (SELECT * FROM r2 WHERE cust IN (SELECT cust FROM r2 GROUP BY cust HAVING count(*) > 1)
                          AND yr IN (SELECT yr FROM r2 GROUP BY yr HAVING count(*) > 1))"""


@register("singletons", _SINGLETON_SQL + "\nSELECT cust, yr FROM r3")
def q_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir).select("cust", "yr", "y")
    return fe.drop_singletons(p, ["cust", "yr"]).select("cust", "yr")


@register("y_summary", _SINGLETON_SQL + """
SELECT count(*) AS N, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd,
       round(min(y), 6) AS min, round(max(y), 6) AS max
FROM r3""")
def q_y_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    (res,) = fe.fit_models(regression_panel(spark, sf_dir), [fe.Spec("y", ["x"])], fes=["cust", "yr"], cluster="cust")
    v = fe.y_summary(res)
    return local_frame(spark, [(int(v["N"]), *[round(v[k], 6) for k in ("mean", "sd", "min", "max")])],
                       "N long, mean double, sd double, min double, max double")


CHAIN = 12      # customers of a block; pruning a chain takes as many rounds


@register("singleton_chains", f"""
WITH c AS (SELECT c_custkey // {CHAIN} AS block, c_custkey % {CHAIN} AS i,
                  count(*) OVER (PARTITION BY c_custkey // {CHAIN}) AS size FROM customer)
SELECT block * 100 + i AS u, block * 100 + i AS t FROM c WHERE block % 2 = 0
UNION ALL SELECT block * 100 + i, block * 100 + (i + 1) % size FROM c WHERE block % 2 = 0""")
def q_singleton_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 over blocks of customers: in even blocks the units and periods form a cycle,
    which survives; in odd blocks a chain, which is peeled from both ends until nothing is left."""
    c = load_table(spark, sf_dir, "customer").select(F.expr(f"c_custkey DIV {CHAIN}").alias("block"), (F.col("c_custkey") % CHAIN).alias("i"))
    c = J.with_group_stats(c, ["block"], size=F.count(F.lit(1)))
    after = F.when(F.col("block") % 2 == 0, (F.col("i") + 1) % F.col("size")).otherwise(F.col("i") + 1)
    rows = c.select((F.col("block") * 100 + F.col("i")).alias("u"), F.explode(F.array(F.col("block") * 100 + F.col("i"), F.col("block") * 100 + after)).alias("t"))
    return fe.drop_singletons(rows, ["u", "t"]).select("u", "t")


@register("demean_balanced", f"""
WITH {BALANCED_CTE}
SELECT cust, yr,
       round(no - avg(no) OVER (PARTITION BY cust) - avg(no) OVER (PARTITION BY yr) + avg(no) OVER (), 6) AS no_dm,
       round(dollars - avg(dollars) OVER (PARTITION BY cust) - avg(dollars) OVER (PARTITION BY yr)
             + avg(dollars) OVER (), 4) AS dollars_dm
FROM bal""")
def q_demean_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balanced_panel(spark, sf_dir).withColumn("no", F.col("no").cast("double"))
    d = fe.absorb(b, ["no", "dollars"], ["cust", "yr"])
    return d.select("cust", "yr", r6("no").alias("no_dm"), F.round("dollars", 4).alias("dollars_dm"))


# --- E1 / E3-E7 / E14 / I5: regressions ----------------------------------------------

FULL = ["x", "disc", "urg"]
CY, CSY = ["cust", "yr"], ["cust", ("state", "yr")]


def _li(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    o = load_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"))
    return li.join(o, "l_orderkey")


@register("demean_two_way", S.query(
    ["li AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS cust, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p "
     "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"] + S.demeaned("dm", "li", ["q", "p"], ["l_partkey", "cust"]),
    "SELECT l_orderkey, l_linenumber, round(q, 5) AS q_dm, round(p, 2) AS p_dm FROM dm"))
def q_demean_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 on an unbalanced table whose second FE has thousands of levels: lines by part and customer."""
    li = _li(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "cust", F.col("l_quantity").cast("double").alias("q"),
                                   F.col("l_extendedprice").cast("double").alias("p"))
    d = fe.absorb(li, ["q", "p"], ["l_partkey", "cust"])
    return d.select("l_orderkey", "l_linenumber", F.round("q", 5).alias("q_dm"), F.round("p", 2).alias("p_dm"))


def coef_frame(spark, res: fe.FEResult, **more) -> DataFrame:
    """Coefficients rounded as in the SQL twins (p is in the tests: it has no SQL form)."""
    c = res.coefficients(spark)
    return c.select("model", "position", "term", r6("estimate").alias("estimate"), r6("std_error").alias("std_error"), F.round("t", 4).alias("t"),
                    r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"), "omitted", *[(F.lit(v).cast("long") if isinstance(v, int) else F.lit(v)).alias(k) for k, v in more.items()])


def _panel_sql(*regressions: list[str], extra: tuple = ()) -> list[str]:
    return [PANEL_CTE.strip(), *extra] + [c for r in regressions for c in r]


@register("fe_ols", S.query(_panel_sql(S.regression("ols_simple", "panel", "y", ["x"], fes=CY), S.regression("ols_full", "panel", "y", FULL, fes=CY)),
                            S.coef_select(["ols_simple", "ols_full"])))
def q_fe_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir)
    res = fe.fit_models(p, [fe.Spec("y", ["x"], name="ols_simple"), fe.Spec("y", FULL, name="ols_full")],
                        fes=CY, cluster="cust")
    return _union([coef_frame(spark, r) for r in res])


@register("fe_ols_stateyr", S.query(_panel_sql(S.regression("ols_full_stateyr", "panel", "y", FULL, fes=CSY)), S.coef_select(["ols_full_stateyr"])))
def q_fe_ols_stateyr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir)
    return coef_frame(spark, fe.fe_ols(p, "y", FULL, fes=CSY, cluster="cust", name="ols_full_stateyr"))


_ID_CTE = "pid AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY state, yr) AS state_yr FROM panel)"


@register("fe_three_way_id", S.query(
    _panel_sql(S.regression("three_way", "pid", "y", FULL, fes=["yr", "cust", "state_yr"], redundant="count(DISTINCT yr)"), extra=(_ID_CTE,)),
    S.coef_select(["three_way"], ", n, (SELECT k FROM three_way_n) AS k")))
def q_fe_three_way_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 with the state-year FE as a ready id column beside the year FE: the years count once."""
    p = R.group_id(regression_panel(spark, sf_dir), ["state", "yr"], "state_yr")
    r = fe.fe_ols(p, "y", FULL, fes=["yr", "cust", "state_yr"], cluster="cust", name="three_way")
    return coef_frame(spark, r, n=r.nobs, k=int(r.dof_k))


_GRAPH, _PARTS = S.level_graph("graph", "unconnected_k", "state_yr", "tier")
_TIER = "floor(acctbal / 1000)::INTEGER"
_TIER_CTE = f"pt AS MATERIALIZED (SELECT *, state * 100 + yr - 1990 AS state_yr, state * 100 + {_TIER} AS tier FROM panel)"


@register("fe_unconnected", S.query(
    _panel_sql(S.regression("unconnected", "pt", "y", FULL, fes=["state_yr", "tier"], redundant=_PARTS, graph=_GRAPH, carry=["state"]), extra=(_TIER_CTE,)),
    S.coef_select(["unconnected"], ", n, (SELECT k FROM unconnected_n) AS k")))
def q_fe_unconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 / E14 with two FEs outside the cluster whose levels fall into unconnected parts (one a state at least)."""
    p = regression_panel(spark, sf_dir)
    p = p.withColumn("state_yr", F.expr("state * 100 + yr - 1990")).withColumn("tier", F.expr("state * 100 + cast(floor(acctbal / 1000) as int)"))
    r = fe.fe_ols(p, "y", FULL, fes=["state_yr", "tier"], cluster="cust", name="unconnected")
    return coef_frame(spark, r, n=r.nobs, k=int(r.dof_k))


@register("fe_omitted", S.query(_panel_sql(S.regression("omitted", "panel", "y", ["x", "disc"], fes=CY, omitted=["acctbal", "x2"])),
                                S.coef_select(["omitted"], ", n, g")))
def q_fe_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 with a column that the unit absorbs and one that is twice another: both are omitted."""
    p = regression_panel(spark, sf_dir).withColumn("x2", 2 * F.col("x"))
    r = fe.fe_ols(p, "y", ["x", "disc", "acctbal", "x2"], fes=CY, cluster="cust", name="omitted")
    return coef_frame(spark, r, n=r.nobs, g=r.n_clusters)


@register("fe_iv", S.query(_panel_sql(S.regression("iv_simple", "panel", "y", [], ["x"], ["no"], fes=CY),
                                      S.regression("iv_full", "panel", "y", ["disc", "urg"], ["x"], ["no"], fes=CY)), S.coef_select(["iv_simple", "iv_full"])))
def q_fe_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir)
    res = fe.fit_models(p, [fe.Spec("y", [], ["x"], ["no"], name="iv_simple"),
                            fe.Spec("y", ["disc", "urg"], ["x"], ["no"], name="iv_full")],
                        fes=CY, cluster="cust")
    return _union([coef_frame(spark, r) for r in res])


@register("fe_iv_stateyr", S.query(_panel_sql(S.regression("iv_full_stateyr", "panel", "y", ["disc", "urg"], ["x"], ["no"], fes=CSY)), S.coef_select(["iv_full_stateyr"])))
def q_fe_iv_stateyr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir)
    return coef_frame(spark, fe.fe_iv(p, "y", ["disc", "urg"], ["x"], ["no"], fes=CSY, cluster="cust", name="iv_full_stateyr"))


@register("first_stage", S.query(_panel_sql(S.regression("first_stage", "panel", "x", ["no", "disc", "urg"], fes=CY), S.wald("first_stage", [0])),
                                 S.coef_select(["first_stage"], ", round(f, 3) AS first_stage_F").replace("FROM first_stage", "FROM first_stage, first_stage_f")))
def q_first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regression_panel(spark, sf_dir)
    r = fe.first_stage(p, "x", ["disc", "urg"], ["no"], fes=CY, cluster="cust", name="first_stage")
    return coef_frame(spark, r, first_stage_F=round(r.extra["first_stage_F"], 3))


def quartile_frame(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    """Quartiles of acctbal over all rows (before pruning), dummies and interactions."""
    p = regression_panel(spark, sf_dir) if panel is None else panel
    b = R.quantile_bucket(p, ["acctbal", "cust", "yr"], 4, "group")
    b = P.one_hot(b, "group", [1, 2, 3, 4], "g")
    return P.interact(b, {"x": "xg", "no": "zg"}, ["g1", "g2", "g3", "g4"])


QUARTILE_CTE = """qp AS MATERIALIZED (
  SELECT *, {} FROM (SELECT *, CAST(ceil(4.0 * row_number() OVER (ORDER BY acctbal, cust, yr) / count(*) OVER ()) AS INTEGER) AS grp FROM panel)
)""".format(", ".join(f"x * (grp = {i})::INTEGER AS xg{i}, no * (grp = {i})::INTEGER AS zg{i}" for i in range(1, 5)))
XG, ZG = [f"xg{i}" for i in range(1, 5)], [f"zg{i}" for i in range(1, 5)]


@register("fe_iv_groups", S.query(_panel_sql(S.regression("iv_groups", "qp", "y", ["disc", "urg"], XG, ZG, fes=CSY), extra=(QUARTILE_CTE,)), S.coef_select(["iv_groups"])))
def q_fe_iv_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = quartile_frame(spark, sf_dir)
    return coef_frame(spark, fe.fe_iv(b, "y", ["disc", "urg"], XG, ZG, fes=CSY, cluster="cust", name="iv_groups"))


_FIRST_FOUR = [S.regression(f"first_{e}", "qp", e, [*ZG, "disc", "urg"], fes=CSY) + S.wald(f"first_{e}", [0, 1, 2, 3]) for e in XG]


@register("first_stages_groups", S.query(
    _panel_sql(*_FIRST_FOUR, extra=(QUARTILE_CTE,)),
    " UNION ALL ".join(S.coef_select([f"first_{e}"], ", round(f, 2) AS first_stage_F").replace(f"FROM first_{e}", f"FROM first_{e}, first_{e}_f") for e in XG)))
def q_first_stages_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 for E7: the four first stages with the F on the four excluded instruments."""
    res = fe.first_stages(quartile_frame(spark, sf_dir), XG, ["disc", "urg"], ZG, fes=CSY, cluster="cust")
    return _union([coef_frame(spark, r, first_stage_F=round(r.extra["first_stage_F"], 2)) for r in res])


#: (name, source, exogenous, endogenous, instruments, FEs)
WEAK_MODELS = [("weak_simple", "panel", [], ["x"], ["no"], CY), ("weak_full", "panel", ["disc", "urg"], ["x"], ["no"], CSY), ("weak_groups", "qp", ["disc", "urg"], XG, ZG, CSY)]


@register("weak_identification", S.query(
    _panel_sql(*[S.weak_identification(*m) for m in WEAK_MODELS], extra=(QUARTILE_CTE,)),
    " UNION ALL ".join(f"SELECT '{m[0]}' AS model, {len(m[3])}::INTEGER AS endogenous, round(robust_F, 2) AS robust_F, round(cragg_donald_F, 2) AS cragg_donald_F FROM {m[0]}_w" for m in WEAK_MODELS)))
def q_weak_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster-robust and homoskedastic weak-identification statistics with one and four endogenous regressors."""
    panel = cut_lineage(regression_panel(spark, sf_dir))        # built once for all models
    frames = {"panel": panel, "qp": quartile_frame(spark, sf_dir, panel)}
    rows = []
    for name, source, exog, endog, inst, fes in WEAK_MODELS:
        (r,) = fe.fit_models(frames[source], [fe.Spec("y", exog, endog, inst, name)], fes=fes, cluster="cust", weak_id=True)
        rows.append((name, len(endog), round(r.extra["robust_weak_F"], 2), round(r.extra["cragg_donald_F"], 2)))
    return local_frame(spark, rows, "model string, endogenous int, robust_F double, cragg_donald_F double")


_QUARTILES = [[f"qp{g} AS MATERIALIZED (SELECT * FROM qp WHERE grp = {g})"]
              + S.regression(f"q{g}", f"qp{g}", "y", ["disc", "urg"], ["x"], ["no"], fes=CSY, model=f"q[group={g}]") for g in range(1, 5)]


@register("iv_by_quartile", S.query(_panel_sql(*_QUARTILES, extra=(QUARTILE_CTE,)), S.coef_select([f"q{g}" for g in range(1, 5)], ", n, g")))
def q_iv_by_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One IV per quartile, each pruned within its own sub-sample, all in the same passes (FEs interacted with the
    quartile); the solves run per group inside the tasks."""
    b = quartile_frame(spark, sf_dir)
    r = fe_groups.fit_groups(b, fe.Spec("y", ["disc", "urg"], ["x"], ["no"], name="q"), CSY, "cust", "group")
    return r.select(F.format_string("q[group=%d]", "group").alias("model"), "position", "term", r6("estimate").alias("estimate"), r6("std_error").alias("std_error"),
                    F.round("t", 4).alias("t"), r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"),
                    "omitted", "n", F.col("n_clusters").alias("g"))


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- E8-E11: difference-in-differences ---------------------------------------------------

@register("did", f"""
WITH {FLAGS_CTE}, d AS (
  SELECT cust, yr, CAST(no AS DOUBLE) AS y, CAST(treated * after AS DOUBLE) AS t FROM flags
), dm AS (
  SELECT cust, y - avg(y) OVER (PARTITION BY cust) - avg(y) OVER (PARTITION BY yr) + avg(y) OVER () AS yd,
         t - avg(t) OVER (PARTITION BY cust) - avg(t) OVER (PARTITION BY yr) + avg(t) OVER () AS td
  FROM d
), b AS (
  SELECT sum(td * yd) / sum(td * td) AS beta, sum(td * td) AS sxx, count(*) AS n, count(DISTINCT cust) AS g,
         sum(yd * yd) AS tss
  FROM dm
), sc AS (SELECT cust, sum(td * (yd - beta * td)) AS s FROM dm, b GROUP BY cust
), v AS (SELECT sum(s * s) AS meat FROM sc)
SELECT 'treatment' AS term, round(beta, 6) AS estimate,
       round(sqrt((CAST(g AS DOUBLE) / (g - 1)) * (CAST(n - 1 AS DOUBLE) / (n - 8)) * meat) / sxx, 6) AS std_error,
       n AS nobs, g AS n_clusters, round(1 - (tss - beta * beta * sxx) / tss, 6) AS r2_within
FROM b, v""")
def q_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = did_frame(spark, sf_dir).withColumn("no", F.col("no").cast("double"))
    r = D.did(d, "no", "treatment", "cust", "yr")
    row = [(r.terms[0], round(float(r.beta[0]), 6), round(float(r.se[0]), 6), int(r.nobs),
            int(r.n_clusters), round(r.r2_within, 6))]
    return local_frame(spark, row, "term string, estimate double, std_error double, nobs long, "
                                   "n_clusters long, r2_within double")


@register("did_trends", f"""
WITH {FLAGS_CTE}
SELECT treated, yr, round(avg(no), 6) AS mean_y, count(*) AS n FROM flags GROUP BY treated, yr""")
def q_did_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.did_trends(did_frame(spark, sf_dir), "no", "treated", "yr")
    return t.select("treated", "yr", r6("mean_y").alias("mean_y"), "n")


DID_CTE = FLAGS_CTE.strip() + """, dd AS MATERIALIZED (
  SELECT cust, yr, CAST(no AS DOUBLE) AS no, treated, after, treated * after AS treatment,
         treated * (1 - after) * (yr - lo) AS pre_trend, treated * after * (yr - lo) AS post_trend, {}
  FROM flags, yrs
)""".format(", ".join(f"CAST(treated * (yr = {t})::INTEGER AS DOUBLE) AS lead_lag_{t}" for t in range(1990, 2010)))
#: Order years of the driver's tables.
YEARS = range(1995, 2002)


@register("event_study", S.query([DID_CTE] + S.regression("event_study", "dd", "no", [f"lead_lag_{t}" for t in YEARS if t != BASE], fes=CY, prune=False, sweeps=2),
                                 S.coef_select(["event_study"])))
def q_event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.plans.panel_data import year_range
    lo, hi = year_range(spark, sf_dir)
    d = did_frame(spark, sf_dir).withColumn("no", F.col("no").cast("double"))
    return coef_frame(spark, D.event_study(d, "no", "treated", "cust", "yr", BASE, range(lo, hi + 1)))


@register("event_study_effects", f"""
WITH {FLAGS_CTE}, m AS (
  SELECT yr, avg(CASE WHEN treated = 1 THEN CAST(no AS DOUBLE) END) AS mt,
         avg(CASE WHEN treated = 0 THEN CAST(no AS DOUBLE) END) AS mc
  FROM flags GROUP BY yr
), b AS (SELECT mt - mc AS d0 FROM m WHERE yr = {BASE})
SELECT 'lead_lag_' || CAST(yr AS VARCHAR) AS term, round((mt - mc) - d0, 6) AS estimate
FROM m, b WHERE yr <> {BASE}""")
def q_event_study_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11 estimates from the FE engine; on the balanced panel they must equal the
    difference-in-differences of cell means relative to the base year."""
    from sparkpanel.plans.panel_data import year_range
    lo, hi = year_range(spark, sf_dir)
    d = did_frame(spark, sf_dir).withColumn("no", F.col("no").cast("double"))
    r = D.event_study(d, "no", "treated", "cust", "yr", BASE, range(lo, hi + 1))
    return r.coefficients(spark).select("term", r6("estimate").alias("estimate"))


_PTRENDS = S.regression("ptrends", "dd", "no", ["treatment", "pre_trend", "post_trend"], fes=CY, prune=False, carry=["treated"], sweeps=2)


@register("did_ptrends", S.query([DID_CTE] + _PTRENDS + S.wald("ptrends", [1]),
                                 S.coef_select(["ptrends"], ", round(f, 4) AS pre_trend_F").replace("FROM ptrends", "FROM ptrends, ptrends_f")))
def q_did_ptrends(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.plans.panel_data import year_range
    lo, _ = year_range(spark, sf_dir)
    d = did_frame(spark, sf_dir).withColumn("no", F.col("no").cast("double"))
    r, f, _ = D.did_ptrends(d, "no", "treatment", "treated", "after", "cust", "yr", lo)
    return coef_frame(spark, r, pre_trend_F=round(f, 4))


@register("did_trend_lines", S.query([DID_CTE] + _PTRENDS, """
SELECT treated, yr, round(mean_y, 6) AS mean_y, round(mean_y - mean_resid, 6) AS fitted_y, n
FROM (SELECT treated, yr, avg(no) AS mean_y, count(*) AS n FROM dd GROUP BY ALL) JOIN (SELECT treated, yr, avg(resid) AS mean_resid FROM ptrends_u GROUP BY ALL) USING (treated, yr)"""))
def q_did_trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 plot table: observed and linear-trends fitted means by group and year."""
    from sparkpanel.plans.panel_data import year_range
    lo, _ = year_range(spark, sf_dir)
    d = did_frame(spark, sf_dir).withColumn("no", F.col("no").cast("double"))
    r, _, _ = D.did_ptrends(d, "no", "treatment", "treated", "after", "cust", "yr", lo)
    t = D.did_trends(d, "no", "treated", "yr", r)
    return t.select("treated", "yr", r6("mean_y").alias("mean_y"), r6("fitted_y").alias("fitted_y"), "n")


# --- S5 / S6 / E12 / E13: reports ----------------------------------------------------

#: The six columns of the results table: (name, exogenous, endogenous, instruments, FEs).
TABLE_MODELS = [("(1)", ["x"], [], [], CY), ("(2)", [], ["x"], ["no"], CY), ("(3)", FULL, [], [], CY), ("(4)", ["disc", "urg"], ["x"], ["no"], CY),
                ("(5)", FULL, [], [], CSY), ("(6)", ["disc", "urg"], ["x"], ["no"], CSY)]
TABLE_LABELS = {"x": "Log spending", "disc": "Discount", "urg": "Urgent orders"}
MODEL_NAMES = [m[0] for m in TABLE_MODELS]


def table_fits(spark: SparkSession, panel: DataFrame, sample=None):
    """All six models, stored by name; those with the same FEs are fitted together."""
    from sparkpanel.operators import report
    store, by_fes = report.Estimates(), {}
    for name, exog, endog, inst, fes in TABLE_MODELS:
        by_fes.setdefault(str(fes), (fes, []))[1].append(fe.Spec("y", exog, endog, inst, name))
    for fes, specs in by_fes.values():
        for res in fe.fit_models(panel, specs, fes=fes, cluster="cust", sample=sample):
            store.store(res.name, res)
    return store


def results_table(spark: SparkSession, panel: DataFrame, sample=None) -> DataFrame:
    from sparkpanel.operators import report
    store = table_fits(spark, panel, sample)
    coefs = _union([store[n].coefficients(spark) for n in MODEL_NAMES])
    stats = _union([store[n].stats(spark) for n in MODEL_NAMES])
    return report.regression_table(coefs, stats, MODEL_NAMES, dec=5, keep=list(TABLE_LABELS), labels=TABLE_LABELS)


def _table_sql(source: str, tag: str) -> list[str]:
    """CTEs that end in table_{tag}: the formatted table of the six models over ``source``."""
    out, cells = [], []
    for k, (name, exog, endog, inst, fes) in enumerate(TABLE_MODELS):
        here = f"{tag}{k}"
        out += S.regression(here, source, "y", exog, endog, inst, fes=fes)
        star = " ".join(f"WHEN abs(t) > {S.t_quantile('g - 1', z)} THEN '{x}'" for z, x in ((2.5758293035489004, "***"), (1.959963984540054, "**"), (1.6448536269514722, "*")))
        term = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TABLE_LABELS, start=1))
        label = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in TABLE_LABELS.items())
        cells += [f"SELECT CASE term {term} END AS ord, CASE term {label} END AS row, 'b' AS stat, '{name}' AS model, format('{{:.5f}}', estimate) || CASE {star} ELSE '' END AS cell FROM {here}",
                  f"SELECT CASE term {term} END, CASE term {label} END, 'se', '{name}', '(' || format('{{:.5f}}', std_error) || ')' FROM {here}",
                  f"SELECT 1000, 'Observations', 'value', '{name}', format('{{:,}}', n) FROM {here}_fit",
                  f"SELECT 1001, 'R-squared', 'value', '{name}', format('{{:.5f}}', {'r2_within' if endog else 'r2'}) FROM {here}_fit"]
    out.append(f"table_{tag} AS (SELECT ord::INTEGER AS ord, row, stat, " + ", ".join(f"max(cell) FILTER (model = '{n}') AS \"{n}\"" for n in MODEL_NAMES)
               + f" FROM ({' UNION ALL '.join(cells)}) GROUP BY ord, row, stat)")
    return out


@register("regression_table", S.query(_panel_sql(_table_sql("panel", "ta")), "SELECT * FROM table_ta"))
def q_regression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark import StorageLevel
    p = regression_panel(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)   # two FE sets read it
    out = results_table(spark, p)
    p.unpersist()
    return out


INTENSIVE_CTE = f"""ip AS MATERIALIZED (
  SELECT *, CAST(sum(CASE WHEN urg > 0 AND yr < {AFTER} THEN 1 ELSE 0 END) OVER (PARTITION BY cust) >= 1 AS INTEGER) AS intensive FROM panel
), ip1 AS MATERIALIZED (SELECT * FROM ip WHERE intensive = 1)"""


@register("regression_table_sample", S.query(_panel_sql(_table_sql("ip1", "tb"), extra=(INTENSIVE_CTE,)), "SELECT * FROM table_tb"))
def q_regression_table_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 with the sample qualifier (P6): the same six models over the units of the intensive margin."""
    from pyspark import StorageLevel
    p = P.intensive_margin(regression_panel(spark, sf_dir), "cust", "yr", "urg", AFTER).persist(StorageLevel.MEMORY_AND_DISK)
    out = results_table(spark, p, sample=F.col("intensive") == 1)
    p.unpersist()
    return out


_COEF_LABELS = {"xg1": "q1", "xg2": "q2", "xg3": "q3", "xg4": "q4", "xg5": "Baseline"}


@register("coef_table", S.query(
    _panel_sql(S.regression("iv1", "qp", "y", ["disc", "urg"], XG, ZG, fes=CSY), S.regression("baseline", "qp", "y", ["disc", "urg"], ["x"], ["no"], fes=CSY), extra=(QUARTILE_CTE,)),
    "SELECT model, term, 'q' || right(term, 1) AS label, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi "
    "FROM iv1 WHERE term LIKE 'xg%' UNION ALL SELECT 'Baseline', 'xg5', 'Baseline', round(estimate, 6), round(std_error, 6), "
    f"round(estimate - {S._Z!r} * std_error, 6), round(estimate + {S._Z!r} * std_error, 6) FROM baseline WHERE term = 'x'"))
def q_coef_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import report
    b = quartile_frame(spark, sf_dir)
    r, base = fe.fit_models(b, [
        fe.Spec("y", ["disc", "urg"], XG, ZG, name="iv1"),
        fe.Spec("y", ["disc", "urg"], ["x"], ["no"], name="baseline")], fes=CSY, cluster="cust")
    baseline = report.estimates_frame(spark, [("xg5", base.coef("x"), base.stderr("x"))], model="Baseline")
    t = report.coef_table([r.coefficients(spark), baseline], list(_COEF_LABELS), _COEF_LABELS)
    return t.select("model", "term", "label", *[r6(c).alias(c) for c in ("estimate", "std_error", "ci_lo", "ci_hi")])
