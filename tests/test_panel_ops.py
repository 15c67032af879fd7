"""Missing-value rules, merges, ranks, buckets and summaries (FIXTURES §5)."""

import pytest
from pyspark.sql import functions as F

from sparkpanel.functions import dist
from sparkpanel.functions import missing as M
from sparkpanel.operators import merge as J
from sparkpanel.operators import panel as P
from sparkpanel.operators import ranks as R


def test_missing_is_large(spark):
    df = spark.createDataFrame([(None,), (3.0,), (7.0,)], "x double")
    stata = [r[0] for r in df.select(M.flag(M.gt(F.col("x"), F.lit(5.0)))).collect()]
    null = [r[0] for r in df.select(M.gt(F.col("x"), F.lit(5.0), "null")).collect()]
    assert stata == [1, 0, 1] and null == [None, False, True]
    flagged = P.flag_gt(df, "x", 5.0, "f").collect()
    assert [r.f for r in flagged] == [1, 0, 1]


def test_equality_and_year_filters(spark):
    df = spark.createDataFrame([(None, None), (1, 1980), (0, 2005)], "semi int, fyear int")
    assert df.filter(F.col("semi") == 1).count() == 1
    keep = df.filter(~(M.lt(F.col("fyear"), F.lit(1965)) | M.gt(F.col("fyear"), F.lit(2003))))
    assert keep.count() == 1
    assert df.filter(M.gt(F.col("fyear"), F.lit(1975))).count() == 3


def test_merge_full_provenance(spark):
    left = spark.createDataFrame([(None, 1.0), (1, 2.0), (2, None)], "k int, v double")
    right = spark.createDataFrame([(None, 10.0, "a"), (2, 20.0, "b"), (3, 30.0, "c")], "k int, v double, w string")
    m = {r.k: r for r in J.merge(left, right, ["k"], "1:1").collect()}
    assert m[None]._merge == 3 and m[None].v == 1.0 and m[None].w == "a"
    assert m[1]._merge == 1 and m[3]._merge == 2 and m[3].v == 30.0
    assert m[2]._merge == 3 and m[2].v is None          # left wins even when missing


def test_merge_duplicate_keys_raise(spark):
    left = spark.createDataFrame([(1, 1.0)], "k int, v double")
    right = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, w double")
    with pytest.raises(J.DuplicateKeyError, match=r"\(1,\)"):
        J.merge(left, right, ["k"], "m:1")


def test_buckets_ceil_not_ntile(spark):
    for n in (5, 6, 7, 7895):
        df = spark.range(n).withColumn("v", F.col("id") % 3)
        b = R.quantile_bucket(df, ["v", "id"], 4, "g")
        got = sorted(r.g for r in b.collect())
        ranks = sorted(range(1, n + 1))
        expect = sorted(-(-4 * r // n) for r in ranks)
        assert got == expect
    sizes = {r.g: r["count"] for r in R.quantile_bucket(spark.range(7895), ["id"], 4, "g")
             .groupBy("g").count().collect()}
    assert [sizes[i] for i in (1, 2, 3, 4)] == [1973, 1974, 1974, 1974]


def test_nulls_sort_last(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,)], "v double")
    r = {x.v: x._n for x in R.global_rank(df, ["v"]).collect()}
    assert r[None] == 3 and r[1.0] == 1


def test_global_rank_partition_invariant(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1000)
    a = {r.id: r._n for r in R.global_rank(df, ["v", "id"], num_partitions=1).collect()}
    b = {r.id: r._n for r in R.global_rank(df, ["v", "id"], num_partitions=32).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 1001))


def test_group_id_missing(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (0, 5), (1, 2)], "a int, b int")
    got = [(r.a, r.b, r.gid) for r in R.group_id(df, ["a", "b"], "gid").collect()]
    assert (1, None, None) in got and (0, 5, 1) in got and got.count((1, 2, 2)) == 2


def test_summarize_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8]], "x double")
    s = R.summarize_detail(df, "x").first()
    # N*p/100 whole -> mean of neighbours; otherwise the next value
    assert s.p50 == 4.5 and s.p25 == 2.5 and s.p10 == 1.0 and s.p90 == 8.0 and s.p5 == 1.0
    assert s.kurtosis == pytest.approx(1.7619047619, rel=1e-9) and s.skewness == pytest.approx(0.0, abs=1e-12)


def test_tabulate(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "g int")
    t = {r.g: (r.freq, r.percent, r.cum) for r in R.tabulate(df, "g").collect()}
    assert t[1] == (2, 50.0, 50.0) and t[3] == (1, 25.0, 100.0)


def test_t_distribution_table_values():
    assert dist.t_sf2(2.228138851986, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert dist.t_ppf(0.975, 1496) == pytest.approx(1.961551, abs=1e-5)
    assert dist.f_sf(4.964602743, 1, 10) == pytest.approx(0.05, abs=1e-8)


def test_global_rank_hot_value_spreads(spark):
    # a third of the rows share one value: ranks stay a permutation and the
    # range partitions stay balanced
    df = spark.range(3000).withColumn("v", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")))
    r = R.global_rank(df, ["v"], num_partitions=6)
    assert sorted(x._n for x in r.collect()) == list(range(1, 3001))
    sizes = [c for c in r.groupBy(F.spark_partition_id()).count().toPandas()["count"]]
    assert max(sizes) < 1500


def test_merge_check_within_the_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "c"), (1, "d")], "k int, y string")
    with pytest.raises(Exception, match="not unique in right"):
        J.merge(left, right, ["k"], "m:1", check="join").collect()
    assert J.merge(left, right.limit(1), ["k"], "1:1", check="join").count() == 2


def test_zero_totals_give_null_shares(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (2, "a", 3.0)], "u int, c string, v double")
    got = {(r.u, r.c): r.share for r in P.shares_of(df, "u", "c", "v").collect()}
    assert got == {(1, "a"): None, (1, "b"): None, (2, "a"): 1.0}


def test_t_quantiles_far_out():
    from sparkpanel.functions import dist
    assert dist.t_ppf(0.9999, 1) == pytest.approx(3183.0988, rel=1e-5)
    assert dist.t_ppf(0.025, 30) == pytest.approx(-2.042272, abs=1e-5)


def test_results_table_and_its_text(spark):
    from sparkpanel.operators import report
    coefs = spark.createDataFrame([("(1)", 1, "x", 0.5, 0.1, 0.001), ("(2)", 1, "x", 0.25, 0.2, 0.2), ("(2)", 2, "z", None, None, None)],
                                  "model string, position int, term string, estimate double, std_error double, p double")
    stats = spark.createDataFrame([("(1)", "N", 1234.0), ("(1)", "r2", 0.9), ("(1)", "r2_within", 0.1), ("(2)", "N", 10.0), ("(2)", "r2_within", -0.3)],
                                  "model string, stat string, value double")
    t = report.regression_table(coefs, stats, ["(1)", "(2)"], dec=3, keep=["x", "z"], labels={"x": "Spending", "z": "Zero"})
    rows = {(r.row, r.stat): (r["(1)"], r["(2)"]) for r in t.collect()}
    assert rows["Spending", "b"] == ("0.500***", "0.250") and rows["Spending", "se"] == ("(0.100)", "(0.200)")
    assert rows["Zero", "b"] == (None, None) and rows["Observations", "value"] == ("1,234", "10") and rows["R-squared", "value"] == ("0.900", "-0.300")
    text = report.render_table(t, ["(1)", "(2)"], "Table 1", ["OLS", "IV"], ["SE in brackets"]).split("\n")
    assert text[0] == "Table 1" and text[3].split() == ["OLS", "IV"] and text[5].split() == ["Spending", "0.500***", "0.250"] and text[-1] == "SE in brackets"


def test_order_statistics_by_radix(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), np.full(400, 2.5), [0.0, -0.0, -1e-320, 1e-320, np.inf, -np.inf, np.nan, np.nan]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    want = np.sort(x)                                       # NaN last
    ranks = [1, 2, 3, 200, 451, 452, 700, 880, len(x) - 2, len(x) - 1, len(x)]
    for few in (R.FEW, 50, 0):
        monkeypatch.setattr(R, "FEW", few)
        got = R.order_statistics(df, "x", ranks)
        np.testing.assert_array_equal([got[r] for r in ranks], want[np.array(ranks) - 1])
    plan = R.summarize_detail(df, "x")._jdf.queryExecution().toString()
    assert "RangePartitioning" not in plan and "rangepartitioning" not in plan
    empty = R.summarize_detail(df.filter("x is null"), "x").first()
    assert empty.N == 0 and empty.p50 is None


def test_sample_cut_is_refined(spark, monkeypatch):
    from sparkpanel.operators import sampling
    df = spark.range(5000).withColumnRenamed("id", "k")
    order = [r.k for r in df.orderBy(sampling.hash_key("k", 42), "k").collect()]
    for edge, digits in ((sampling.EDGE, 3), (5, 1), (1, 2)):
        monkeypatch.setattr(sampling, "EDGE", edge)
        monkeypatch.setattr(sampling, "DIGITS", digits)
        for n in (0, 1, 7, 1234, 4999, 5000):
            assert sorted(r.k for r in sampling.sample_n(df, n, 42, "k").collect()) == sorted(order[:n])
    test = sampling.split(df, 0.1, 42, "k").filter("split = 'test'")
    assert sorted(r.k for r in test.collect()) == sorted(order[:500])
