"""Many regressions by group against fits of each group alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import fe, fe_groups


def test_equals_fits_of_each_group(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(5):
        for u in range(25):
            for t in range(5):
                if rng.random() < 0.1:
                    continue
                z, x, k = rng.normal(size=3)
                x += 0.7 * z
                rows.append((f"g{g}", u, t, (u % 3) * 10 + t, float(z), float(x), float(k) if g != 2 else 1.0, float((g + 1) * x + k + u + t + rng.normal())))
    rows += [("one", 0, t, t, 1.0, float(t), 2.0, 1.0) for t in range(3)]                 # not identified
    rows += [(None, 1, 1, 1, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, u int, t int, st int, z double, x double, k double, y double").cache()
    spec = fe.Spec("y", ["k"], ["x"], ["z"], "m")
    for fes, cluster in ((["u", "t"], "u"), (["u", "t", "st"], "u"), (["t", "st"], "u")):
        got = {(r.g, r.term): r for r in fe_groups.fit_groups(df, spec, fes, cluster, "g").collect()}
        for g in range(5):
            one = fe.fit_models(df.filter(F.col("g") == f"g{g}"), [spec], fes, cluster)[0]
            for i, term in enumerate(["x", "k"]):
                r = got[f"g{g}", term]
                assert r.omitted == (term in one.omitted) and (r.n, r.n_clusters, r.dof_k) == (one.nobs, one.n_clusters, one.dof_k), (fes, g, term)
                if not r.omitted:
                    assert r.estimate == pytest.approx(one.beta[i], rel=1e-8) and r.std_error == pytest.approx(one.se[i], rel=1e-7)
                    row = one.table_rows()[i]
                    assert (r.t, r.ci_lo, r.ci_hi) == pytest.approx((row[5], row[7], row[8]), rel=1e-7)
        assert all(g is not None for g, _ in got)
        assert all(r.estimate is None or r.std_error is None for (g, _), r in got.items() if g == "one")


def test_many_groups(spark):
    """5,000 groups of 8 rows; the slope of each is known, and no group comes to the driver on the way."""
    n = 5000
    df = spark.range(n * 8).select((F.col("id") / 8).cast("int").alias("g"), (F.col("id") % 8 / 2).cast("int").alias("u"), (F.col("id") % 2).cast("int").alias("t"),
                                   ((F.col("id") * 7919) % 101).cast("double").alias("x"))
    df = df.withColumn("y", F.col("x") * (F.col("g") % 10) + F.col("u") * 3.0)
    out = fe_groups.fit_groups(df, fe.Spec("y", ["x"], name="m"), ["u"], "u", "g")
    wrong = out.filter(F.abs(F.col("estimate") - F.col("g") % 10) > 1e-6).count()
    assert out.count() == n and wrong == 0
