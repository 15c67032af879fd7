"""Fixed-effects OLS / IV, DiD and construction goldens at sf0.01 (FIXTURES §3.2-§3.4).

Goldens were computed independently with dense dummy-variable regressions
(numpy + DuckDB, no Spark).  Tolerance: the goldens' 6th decimal.
"""

import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import did as D
from sparkpanel.operators import fe
from sparkpanel.plans import panel_queries as PQ
from sparkpanel.plans.panel_data import regression_panel
from tests.conftest import SF01

FULL = ["x", "disc", "urg"]
SY = ("state", "yr")


def close(a, b, tol=1.5e-6):
    return abs(a - b) <= tol * max(1.0, abs(b))


@pytest.fixture(scope="module")
def panel(spark):
    p = regression_panel(spark, SF01).cache()
    assert p.count() == 7895
    yield p
    p.unpersist()


@pytest.fixture(scope="module")
def models(panel):
    ols = fe.fit_models(panel, [fe.Spec("y", ["x"], name="ols_simple"), fe.Spec("y", FULL, name="ols_full"),
                                fe.Spec("y", [], ["x"], ["no"], name="iv_simple"),
                                fe.Spec("y", ["disc", "urg"], ["x"], ["no"], name="iv_full")],
                        fes=["cust", "yr"], cluster="cust")
    sy = fe.fit_models(panel, [fe.Spec("y", FULL, name="ols_sy"), fe.Spec("y", ["disc", "urg"], ["x"], ["no"], name="iv_sy")],
                       fes=["cust", SY], cluster="cust")
    return {r.name: r for r in ols + sy}


def check(res, coefs, ses):
    assert all(close(a, b) for a, b in zip(res.beta, coefs)), (res.beta, coefs)
    assert all(close(a, b) for a, b in zip(res.se, ses)), (res.se, ses)


def test_sample_and_y_summary(models):
    r = models["ols_simple"]
    assert (r.nobs, r.n_clusters) == (7892, 1497)
    assert close(r.ymean, 4.980029) and close(r.ysd, 0.903761)


def test_ols(models):
    check(models["ols_simple"], [0.379958], [0.012647])
    assert close(models["ols_simple"].r2_within, 0.162425) and close(models["ols_simple"].r2, 0.335287)
    check(models["ols_full"], [0.350436, 9.549329, 0.195860], [0.012454, 1.340114, 0.015273])
    assert close(models["ols_full"].r2, 0.365143) and close(models["ols_full"].r2_within, 0.200045)
    check(models["ols_sy"], [0.351228, 9.540474, 0.193926], [0.012376, 1.347890, 0.015579])
    assert close(models["ols_sy"].r2, 0.377439) and close(models["ols_sy"].r2_within, 0.199406)


def test_iv(models):
    check(models["iv_simple"], [0.963536], [0.019708])
    assert close(models["iv_simple"].r2_within, -0.220735)
    check(models["iv_full"], [0.967249, 8.763581, -0.027785], [0.020771, 1.399544, 0.019759])
    assert close(models["iv_full"].r2_within, -0.206298)
    check(models["iv_sy"], [0.968908, 8.821476, -0.028716], [0.021115, 1.409487, 0.020348])
    assert close(models["iv_sy"].r2_within, -0.207074)


def test_first_stage(panel):
    r = fe.first_stage(panel, "x", ["disc", "urg"], ["no"], fes=["cust", "yr"], cluster="cust")
    check(r, [0.563911, -0.145184, 0.008400], [0.010057, 0.757040, 0.015721])
    assert close(r.r2, 0.490052) and close(r.r2_within, 0.371291)
    assert r.extra["first_stage_F"] == pytest.approx(3143.8229, abs=2e-3)


def test_quartile_iv_and_per_quartile(spark):
    b = PQ.quartile_frame(spark, SF01).cache()
    sizes = {r.group: r["count"] for r in b.groupBy("group").count().collect()}
    assert [sizes[i] for i in (1, 2, 3, 4)] == [1973, 1974, 1974, 1974]
    r = fe.fe_iv(b, "y", ["disc", "urg"], ["xg1", "xg2", "xg3", "xg4"], ["zg1", "zg2", "zg3", "zg4"],
                 fes=["cust", SY], cluster="cust")
    check(r, [0.970037, 0.996800, 0.894497, 1.014402, 8.841150, -0.026932],
          [0.036374, 0.041256, 0.034608, 0.039558, 1.407559, 0.020218])
    assert close(r.r2_within, -0.205512)
    per = fe.fit_models(b, [fe.Spec("y", ["disc", "urg"], ["x"], ["no"], name="q")], fes=["cust", SY],
                        cluster="cust", by="group")
    gold = {1: ([0.986712, 8.233229, -0.043826], [0.041805, 2.664959, 0.038820], 1971, 369),
            2: ([0.988348, 9.192635, -0.066378], [0.048923, 2.972846, 0.045250], 1972, 375),
            3: ([0.891191, 6.796931, -0.023777], [0.040525, 2.823535, 0.043717], 1972, 375),
            4: ([1.002397, 9.595788, 0.010752], [0.046302, 2.819756, 0.044999], 1974, 379)}
    for res in per:
        g = res.extra["group"]
        check(res, gold[g][0], gold[g][1])
        assert (res.nobs, res.n_clusters) == gold[g][2:]
    # the grouped fit equals a separate filtered run
    one = fe.fe_iv(b, "y", ["disc", "urg"], ["x"], ["no"], fes=["cust", SY], cluster="cust",
                   sample=F.col("group") == 2)
    check(one, gold[2][0], gold[2][1])
    b.unpersist()


def test_redundant_fe_and_partitions(panel):
    base = fe.fe_ols(panel, "y", FULL, fes=["cust", SY], cluster="cust")
    more = fe.fe_ols(panel, "y", FULL, fes=["cust", "yr", SY], cluster="cust")
    assert max(abs(a - b) for a, b in zip(base.beta, more.beta)) < 1e-8
    assert max(abs(a - b) for a, b in zip(base.se, more.se)) < 1e-8
    shuffled = fe.fe_ols(panel.repartition(3), "y", FULL, fes=["cust", SY], cluster="cust")
    assert max(abs(a - b) for a, b in zip(base.beta, shuffled.beta)) < 1e-8


def test_singleton_chain(spark):
    # unit 3 becomes a singleton only after year 2002 (a singleton year) is dropped
    rows = [(1, 2000, 1.0), (1, 2001, 2.0), (2, 2000, 1.5), (2, 2001, 0.5), (3, 2001, 3.0), (3, 2002, 1.0)]
    df = spark.createDataFrame(rows, "u int, t int, v double")
    kept = fe.drop_singletons(df, ["u", "t"]).select("u").distinct().collect()
    assert sorted(r.u for r in kept) == [1, 2]


@pytest.fixture(scope="module")
def did_frame(spark):
    d = PQ.did_frame(spark, SF01).withColumn("no", F.col("no").cast("double")).cache()
    yield d
    d.unpersist()


def test_did_construction(did_frame):
    assert did_frame.count() == 10500
    treated = did_frame.filter("treated = 1").select("cust").distinct().count()
    assert treated == 750
    s = did_frame.agg(F.median("surge"), F.avg("surge"), F.stddev_samp("surge")).first()
    assert close(s[0], -20995.279, 1e-9) and close(s[1], -24098.758482, 1e-9) and close(s[2], 217863.249792, 1e-9)


def test_did_event_study_ptrends(did_frame):
    r = D.did(did_frame, "no", "treatment", "cust", "yr")
    check(r, [1.226222], [0.034717])
    assert (r.nobs, r.n_clusters) == (10500, 1500) and close(r.r2_within, 0.075622)
    es = D.event_study(did_frame, "no", "treated", "cust", "yr", 1997, range(1995, 2002))
    check(es, [-0.606667, -0.560000, 0.873333, 0.881333, 0.916000, 0.678667],
          [0.087765, 0.088152, 0.086330, 0.085964, 0.088557, 0.078994])
    pt, f, _ = D.did_ptrends(did_frame, "no", "treatment", "treated", "after", "cust", "yr", 1995)
    check(pt, [1.776756, 0.303333, -0.054933], [0.126384, 0.043876, 0.025145])
    assert f == pytest.approx(47.79468, abs=1e-4)


def test_did_trends(did_frame):
    t = {(r.treated, r.yr): r.mean_y for r in D.did_trends(did_frame, "no", "treated", "yr").collect()}
    control = [1.970667, 1.913333, 1.662667, 1.186667, 1.240000, 1.262667, 0.676000]
    treated = [1.077333, 1.066667, 1.376000, 1.773333, 1.834667, 1.892000, 1.068000]
    for i, yr in enumerate(range(1995, 2002)):
        assert close(t[(0, yr)], control[i]) and close(t[(1, yr)], treated[i])


def test_construction_goldens(spark):
    h = PQ.q_hhi(spark, SF01).agg(F.count("*"), F.avg("hhi"), F.min("hhi"), F.max("hhi")).first()
    assert h[0] == 25 and close(h[1], 0.010556) and close(h[2], 0.010369) and close(h[3], 0.010729)
    z = PQ.q_shift_share(spark, SF01).agg(F.count("*"), F.avg("z"), F.min("z"), F.max("z")).first()
    assert z[0] == 10360 and close(z[1], 18.126209) and close(z[2], 17.512282) and close(z[3], 18.315299)


def test_fitted_trends(did_frame):
    pt, _, _ = D.did_ptrends(did_frame, "no", "treatment", "treated", "after", "cust", "yr", 1995)
    t = D.did_trends(did_frame, "no", "treated", "yr", pt).collect()
    assert len(t) == 14
    # control cells: the model has no control-specific terms beyond FE, residuals average out per year
    ctrl = [r for r in t if r.treated == 0]
    assert all(abs(r.fitted_y - r.mean_y) < 0.5 for r in ctrl)
    # treated fitted series is linear in the year within pre and within post periods
    tr = {r.yr: r.fitted_y for r in t if r.treated == 1}
    pre = [tr[1996] - tr[1995], tr[1997] - tr[1996]]
    post = [tr[1999] - tr[1998], tr[2000] - tr[1999], tr[2001] - tr[2000]]
    ctl = {r.yr: r.fitted_y for r in ctrl}
    dpre = [pre[0] - (ctl[1996] - ctl[1995]), pre[1] - (ctl[1997] - ctl[1996])]
    dpost = [post[i] - (ctl[1999 + i] - ctl[1998 + i]) for i in range(3)]
    assert abs(dpre[0] - dpre[1]) < 1e-6 and max(dpost) - min(dpost) < 1e-6
