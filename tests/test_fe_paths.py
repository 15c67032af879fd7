"""FE engine paths against brute force on a small fixture.

The same two-way (unit + state-year) regression is solved by the dense path,
by CG with folded literals and by CG with joined level tables; all must equal
a dense dummy-variable least-squares fit computed with numpy.
"""

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparkpanel.operators import fe


def _fixture(seed=7, units=120, years=6, states=5):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        st = u % states
        a_u = rng.normal()
        for t in range(years):
            if rng.random() < 0.15:
                continue                      # unbalanced
            x = rng.normal() + 0.3 * a_u
            y = 1.5 * x + a_u + 0.2 * t + 0.1 * st * t + rng.normal(scale=0.5)
            rows.append((u, t, st, float(x), float(y)))
    return rows


def _brute(rows):
    """Dummy-variable OLS with singleton pruning; returns (beta, N)."""
    import collections
    keep = list(rows)
    while True:
        cu = collections.Counter(r[0] for r in keep)
        cs = collections.Counter((r[2], r[1]) for r in keep)
        nxt = [r for r in keep if cu[r[0]] > 1 and cs[(r[2], r[1])] > 1]
        if len(nxt) == len(keep):
            break
        keep = nxt
    units = sorted({r[0] for r in keep})
    cells = sorted({(r[2], r[1]) for r in keep})
    ui = {u: i for i, u in enumerate(units)}
    ci = {c: i for i, c in enumerate(cells)}
    X = np.zeros((len(keep), 1 + len(units) + len(cells)))
    y = np.zeros(len(keep))
    for n, r in enumerate(keep):
        X[n, 0] = r[3]
        X[n, 1 + ui[r[0]]] = 1.0
        X[n, 1 + len(units) + ci[(r[2], r[1])]] = 1.0
        y[n] = r[4]
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    return beta[0], len(keep)


@pytest.fixture(scope="module")
def panel(spark):
    rows = _fixture()
    df = spark.createDataFrame(rows, "u int, t int, st int, x double, y double").cache()
    return rows, df


@pytest.mark.parametrize("dense,literal", [(10_000, 10_000_000), (0, 10_000_000), (0, 0)])
def test_paths_equal_brute_force(panel, monkeypatch, dense, literal):
    rows, df = panel
    monkeypatch.setattr(fe, "DENSE_LEVELS", dense)
    monkeypatch.setattr(fe, "LITERAL_MAX", literal)
    r = fe.fe_ols(df, "y", ["x"], fes=["u", ("st", "t")], cluster="u")
    b, n = _brute(rows)
    assert r.nobs == n
    assert r.coef("x") == pytest.approx(b, abs=1e-9)


def test_level_tables_equal_brute_force(panel, monkeypatch):
    """CG whose vectors are Spark tables (what runs above DRIVER_VALUES)."""
    rows, df = panel
    monkeypatch.setattr(fe, "DRIVER_VALUES", 0)
    r = fe.fe_ols(df, "y", ["x"], fes=["u", ("st", "t")], cluster="u")
    b, n = _brute(rows)
    assert r.nobs == n and r.coef("x") == pytest.approx(b, abs=1e-9)


def test_unsolved_system_is_an_error():
    steps = fe._Steps(np.ones(2), np.ones(2), 1e-13)
    steps.verify(np.array([1e-9, 0.0]))
    with pytest.raises(ArithmeticError):
        steps.verify(np.array([1e-3, 0.0]))


def test_long_chain_is_pruned_to_nothing(spark):
    """A chain of units and periods loses one row at each end per round; a plan that grew with the rounds would not end."""
    rows = [(u, t) for u in range(30) for t in (u, u + 1)]
    assert fe.drop_singletons(spark.createDataFrame(rows, "u int, t int"), ["u", "t"]).count() == 0
    ring = [(u, t) for u in range(6) for t in (u, (u + 1) % 6)]
    assert fe.drop_singletons(spark.createDataFrame(ring, "u int, t int"), ["u", "t"]).count() == 12


def test_chains_go_in_few_rounds(spark, monkeypatch):
    """10,000 units in a chain, a tree of chains, and random graphs against plain peeling."""
    import collections
    cuts = []
    cut = fe.cut_lineage
    monkeypatch.setattr(fe, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    chain = [(u, t) for u in range(10_000) for t in (u, u + 1)]
    ring = [(20_000 + u, 20_000 + t) for u in range(6) for t in (u, (u + 1) % 6)]
    left = fe.drop_singletons(spark.createDataFrame(chain + ring + [(20_000, 30_000)], "u int, t int"), ["u", "t"])
    assert left.count() == 12 and len(cuts) < 20
    rng = np.random.default_rng(6)
    for n in (60, 90, 130):
        rows = [(int(a), int(b), int(c)) for a, b, c in rng.integers(0, 60, (n, 3))]
        keep = list(rows)
        while True:
            counts = [collections.Counter(r[i] for r in keep) for i in range(3)]
            after = [r for r in keep if all(counts[i][r[i]] > 1 for i in range(3))]
            if len(after) == len(keep):
                break
            keep = after
        monkeypatch.setattr(fe, "RAKES", 0 if n != 90 else 1)
        got = fe.drop_singletons(spark.createDataFrame(rows, "u int, t int, s int"), ["u", "t", "s"]).collect()
        assert sorted(tuple(r) for r in got) == sorted(keep), n


def test_omitted_terms(panel):
    rows, df = panel
    d = df.withColumns({"own": df["u"] * 1.5, "x2": 2 * df["x"], "z": df["x"] + df["y"] * 0})
    base = fe.fe_ols(df, "y", ["x"], fes=["u", "t"], cluster="u")
    r = fe.fe_ols(d, "y", ["own", "x", "x2", "z"], fes=["u", "t"], cluster="u")
    assert r.omitted == ["own", "x2", "z"] and r.dof_k == base.dof_k
    assert r.coef("x") == pytest.approx(base.coef("x"), abs=1e-10) and r.stderr("x") == pytest.approx(base.stderr("x"), abs=1e-10)
    assert r.wald_f(["x", "x2"])[0] == pytest.approx(base.wald_f(["x"])[0])
    table = {c.term: c for c in r.coefficients(df.sparkSession).collect()}
    assert table["own"].omitted and table["own"].estimate is None and not table["x"].omitted


def test_no_variance_without_degrees_of_freedom(spark):
    one = spark.createDataFrame([(1, i, float(i * i % 7), float(i)) for i in range(6)], "u int, t int, y double, x double")
    r = fe.fe_ols(one, "y", ["x"], fes=["u"], cluster="u")
    assert np.isnan(r.stderr("x")) and np.isfinite(r.coef("x"))


def test_weak_identification_equals_first_stage_f(panel):
    """With one endogenous regressor Cragg-Donald is the homoskedastic first-stage F."""
    rows, df = panel
    d = df.withColumn("z", df["x"] + 0.5 * df["y"])
    iv = fe.fe_iv(d, "y", [], ["x"], ["z"], fes=["u", "t"], cluster="u")
    first = fe.fe_ols(d, "x", ["z"], fes=["u", "t"], dof="levels")
    assert iv.extra["cragg_donald_F"] == pytest.approx((first.coef("z") / first.stderr("z")) ** 2, rel=0.02)


def test_components_of_long_chains_and_forests(spark, monkeypatch):
    from sparkpanel.operators import fe_levels
    n, rounds = 3000, []
    cut = fe_levels.cut_lineage
    monkeypatch.setattr(fe_levels, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    order = np.random.default_rng(1).permutation(n + 1)     # a chain whose numbers are in no order
    rows = [(int(order[i]), i) for i in range(n)] + [(int(order[i + 1]), i) for i in range(n)]
    rows += [(10_000 + i, 10_000 + i // 3) for i in range(30)]
    got = fe_levels.components(spark.createDataFrame(rows, "a int, b int"), ["a"], ["b"]).collect()
    parts = {r.component.a for r in got}
    assert len(got) == n + 31 and parts == {0} | {10_000 + 3 * i for i in range(10)}
    assert len(rounds) <= 2 + 2 * 20                        # two tables a round


def test_degrees_of_freedom_equal_the_rank(spark):
    """Two FEs outside the cluster on an unconnected panel; a third one written as a tuple and as an id."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(30)), int(a), int(a // 4 * 4 + rng.integers(4)), float(rng.normal()), float(rng.normal())) for a in rng.integers(0, 20, 400)]
    df = spark.createDataFrame(rows, "c int, a int, b int, x double, y double")
    dummies = np.array([[r[1] == i for i in range(20)] + [r[2] == i for i in range(20)] for r in rows], float)
    r = fe.fe_ols(df, "y", ["x"], fes=["a", "b"], cluster="c")
    assert r.dof_k == 1 + np.linalg.matrix_rank(dummies) == 1 + 20 + 20 - 5
    assert fe.fe_ols(df, "y", ["x"], fes=["a", "b"], cluster="c", dof="levels").dof_k == 41
    both = df.withColumn("id", df["a"] * 100 + df["b"])
    as_tuple, as_id, reverse = (fe.fe_ols(both, "y", ["x"], fes=f, cluster="c") for f in (["a", ("a", "b")], ["a", "id"], ["id", "a"]))
    assert as_tuple.dof_k == as_id.dof_k == reverse.dof_k
    np.testing.assert_allclose(as_tuple.se, as_id.se, rtol=1e-9)
    # an FE that lies within the clusters by its data, not by its name, does not count
    inner = df.withColumn("part", df["c"] * 2 + (df["x"] > 0).cast("int"))
    assert fe.fe_ols(inner, "y", ["x"], fes=["part", "a"], cluster="c").dof_k == 1 + 20


def test_groups_have_their_own_components(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(rng.integers(30)), a, a // (2 if g else 20) * 20 + int(rng.integers(4)), float(rng.normal()), float(rng.normal())) for g in (0, 1) for a in range(20) for _ in range(30)]
    df = spark.createDataFrame(rows, "g int, c int, a int, b int, x double, y double")
    by = fe.fit_models(df, [fe.Spec("y", ["x"], name="m")], fes=["a", "b"], cluster="c", by="g")
    alone = [fe.fe_ols(df.filter(df["g"] == g), "y", ["x"], fes=["a", "b"], cluster="c") for g in (0, 1)]
    assert [r.dof_k for r in by] == [r.dof_k for r in alone]
    assert alone[0].dof_k == 1 + 20 + 4 - 1 and alone[1].dof_k == 1 + 20 + 40 - 10


def test_robust_weak_identification(spark):
    rng = np.random.default_rng(8)
    rows = []
    for u in range(80):
        for t in range(6):
            z, w = rng.normal(size=2)
            e = rng.normal() * (1 + abs(z))
            rows.append((u, t, float(z), float(w), float(2.0 * z + 0.8 * w + e), float(0.4 * z + 2.4 * w + rng.normal()), float(rng.normal()), float(e + rng.normal())))
    df = spark.createDataFrame(rows, "u int, t int, z double, w double, x1 double, x2 double, k double, y double")
    one = fe.fit_models(df, [fe.Spec("y", ["k"], ["x1"], ["z", "w"], "one"), fe.Spec("y", ["k"], ["x1"], ["z"], "exact")], fes=["u", "t"], cluster="u", weak_id=True)
    for r, inst in zip(one, (["z", "w"], ["z"])):
        first = fe.first_stage(df, "x1", ["k"], inst, fes=["u", "t"], cluster="u")
        assert r.extra["robust_weak_F"] == pytest.approx(first.extra["first_stage_F"], rel=1e-9)
    # a second regressor that the instruments explain the same way: not identified, the statistic is small
    spec = lambda x: [fe.Spec("y", ["k"], ["x1", x], ["z", "w"], "two")]
    good = fe.fit_models(df, spec("x2"), fes=["u", "t"], cluster="u", weak_id=True)[0].extra["robust_weak_F"]
    copy = df.withColumn("x3", 2 * df["x1"] + df["y"] * 0.001 + df["k"] + df["t"])
    bad = fe.fit_models(copy, spec("x3"), fes=["u", "t"], cluster="u", weak_id=True)[0].extra["robust_weak_F"]
    assert good > 10 > bad
    # the rank statistic does not depend on the scale or the mix of the instruments
    mixed = df.withColumn("z", df["z"] * 5 + df["w"]).withColumn("x2", df["x2"] * 0.01)
    again = fe.fit_models(mixed, spec("x2"), fes=["u", "t"], cluster="u", weak_id=True)[0].extra["robust_weak_F"]
    assert again == pytest.approx(good, rel=1e-6)


def test_gram_over_open_units(spark, monkeypatch):
    """A = D'D - C'N^-1C where units go on over batches and over the pieces that a task lays out."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 9)), int(rng.integers(0, 20)), int(rng.integers(20, 26))) for _ in range(400)]
    u, s, t = (np.eye(n)[[r[k] for r in rows]] for k, n in ((0, 9), (1, 26), (2, 26)))
    d = s + t
    want = d.T @ d - (u.T @ d).T @ np.diag(1 / u.sum(0)) @ (u.T @ d)
    df = spark.createDataFrame(rows, "u int, s long, t long").groupBy("u", "s", "t").agg(F.count("*").alias("__c"))
    cells = df.withColumn("__nu", F.sum("__c").over(fe._unit_window(["u"])))
    monkeypatch.setattr(fe, "DENSE_VALUES", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = fe._Absorber._gram(cells, ["u"], ["s", "t"], 26)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.abs(got - want).max() < 1e-9
