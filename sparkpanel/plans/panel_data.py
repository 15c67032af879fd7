"""Stand-in panels built from the driver's TPC-H-like tables (FIXTURES §2).

county -> customer, state -> nation, year -> year(o_orderdate),
spending -> order value, patents -> order count.  Everything is derived by
Spark from the given tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.functions import numeric as N
from sparkpanel.sources import load_table


def orders_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (load_table(spark, sf_dir, "orders")
            .select("o_orderkey", F.col("o_custkey").alias("cust"), "o_totalprice", "o_orderpriority",
                    F.year("o_orderdate").alias("yr")))


def line_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem pre-aggregated per order before meeting orders."""
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    # discounts are whole percentages: summing cents keeps the average exact
    return li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc_cents"),
        F.count(F.lit(1)).alias("n_lines"))


def regression_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cust, yr) panel with x, no, urg, y, disc and state (FIXTURES §3.2)."""
    o = orders_year(spark, sf_dir)
    oagg = o.groupBy("cust", "yr").agg(
        N.log_level(F.sum("o_totalprice")).alias("x"),
        F.count(F.lit(1)).alias("no"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urg"))
    lo = line_by_order(spark, sf_dir)
    lagg = (lo.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "cust", "yr"), "l_orderkey")
            .groupBy("cust", "yr")
            .agg(F.sum("q").alias("q"), (F.sum("disc_cents") / (F.sum("n_lines") * 100)).alias("avg_disc")))
    cust = load_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"),
                                                         F.col("c_nationkey").alias("state"),
                                                         F.col("c_acctbal").alias("acctbal"))
    return (oagg.join(lagg, ["cust", "yr"], "left").join(cust, "cust", "left")
            .select("cust", "yr", "state", "acctbal", "x", F.col("no").cast("double").alias("no"),
                    F.col("urg").cast("double").alias("urg"),
                    N.log_level(F.coalesce(F.col("q"), F.lit(0.0)), plus=1).alias("y"),
                    F.coalesce(F.col("avg_disc"), F.lit(0.0)).alias("disc")))


def year_range(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last order year: one aggregate row, used as literals."""
    r = (load_table(spark, sf_dir, "orders")
         .agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi")).first())
    return int(r["lo"]), int(r["hi"])


def balanced_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer in every order year, order count and dollars (0 where absent)."""
    from sparkpanel.operators.panel import build_panel
    o = orders_year(spark, sf_dir)
    units = load_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"))
    return build_panel(o, "cust", "yr",
                       {"no": F.count(F.lit(1)), "dollars": F.sum("o_totalprice")},
                       units=units, time_range=year_range(spark, sf_dir),
                       fill={"no": 0, "dollars": 0.0})
