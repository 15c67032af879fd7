"""Joint multi-label training, epochs and the model store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import joint_model as JM
from sparkpanel.operators import model
from sparkpanel.sources import store

TOPICS = ["a", "b", "c"]


def _texts(spark, n=400, seed=1):
    """Topic a: the word 'alpha'; b: 'beta' or 'gamma', with noise; c: never."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{int(k)}" for k in rng.integers(0, 60, rng.integers(3, 25))]
        a, b = rng.random() < 0.3, rng.random() < 0.4
        words += ["alpha"] * int(a) + [str(rng.choice(["beta", "Gamma"]))] * int(b)
        if rng.random() < 0.1:
            b = not b
        rows.append((i, " ".join(rng.permutation(words)), int(a), int(b), 0))
    return spark.createDataFrame(rows + [(n, None, 0, 0, 0), (n + 1, "", 0, 0, 0), (n + 2, "alpha", None, 0, 0)], "id long, text string, a int, b int, c int").cache()


def _loss(scored, t, i):
    p = F.least(F.greatest(F.col("probabilities")[i], F.lit(1e-7)), F.lit(1 - 1e-7))
    y = F.col(t).cast("double")
    return scored.agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))).first()[0]


def test_no_worse_than_separate_fits_in_one_job_an_epoch(spark, monkeypatch):
    df = _texts(spark)
    tr, va = df.filter("id % 5 <> 0 and a is not null"), df.filter("id % 5 = 0 and a is not null")
    passes = []
    run = JM.run_pass
    monkeypatch.setattr(JM, "run_pass", lambda *x: passes.append(1) or run(*x))
    joint = JM.fit_joint(tr, "text", TOPICS, valid=va, num_features=1 << 14)       # 1 << 12 has a collision of two of the words
    assert len(passes) == joint.epochs <= 25            # whatever the number of topics
    tr, va = tr.filter("text is not null"), va.filter("text is not null")
    alone = model.fit_topics(tr, "text", TOPICS, valid=va, num_features=1 << 12, max_iter=20, reg_grid=(0.1, 0.01, 0.001))
    js, ss = joint.score(va), alone.score(va)
    assert js.count() == va.count()
    for i, t in enumerate(TOPICS):
        assert _loss(js, t, i) <= _loss(ss, t, i) + 0.02, t
    right = js.select(F.avg((F.col("predicted_label")[0] == F.col("a")).cast("double"))).first()[0]
    assert right > 0.95


def test_gradient_and_loss_equal_the_formula(spark):
    df = _texts(spark, 30).filter("a is not null")
    rows = df.select(JM.features(F.col("text"), 64).alias("words"), F.array(*[F.col(t).cast("double") for t in TOPICS]).alias("y"), (F.col("id") % 3 == 0).cast("int").alias("held")).repartition(3)
    rng = np.random.default_rng(0)
    w, idf = rng.normal(size=(65, 3)), rng.random(64)
    loss, held, grad, counts = JM.run_pass(rows, w, idf)
    x, y, h = [], [], []
    for r in rows.collect():
        v = np.zeros(65)
        v[64] = 1
        for f in r.words or []:
            v[f] += idf[f] / np.sqrt(len(r.words))
        x.append(v), y.append(r.y), h.append(r.held)
    x, y, h = np.array(x), np.array(y), np.array(h)
    z = x @ w
    bce = np.logaddexp(0, z) - y * z
    np.testing.assert_allclose(loss, bce[h == 0].mean(0)), np.testing.assert_allclose(held, bce[h == 1].mean(0))
    np.testing.assert_allclose(grad, x[h == 0].T @ (1 / (1 + np.exp(-z)) - y)[h == 0] / (h == 0).sum(), atol=1e-12)
    twice = JM.run_pass(rows, np.repeat(w, 2, axis=1), idf)       # two heads a topic
    np.testing.assert_allclose(twice[2], np.repeat(grad, 2, axis=1)), np.testing.assert_allclose(twice[0], np.repeat(loss, 2))
    one = JM.run_pass(rows.withColumn("y", F.slice("y", 1, 1)), w[:, :1], idf)
    np.testing.assert_allclose(one[1], held[:1]), np.testing.assert_allclose(one[2], grad[:, :1])
    assert counts == one[3] == ((h == 0).sum(), (h == 1).sum())


def _bowl(held_by_epoch, seen):
    """A pass over a convex bowl whose hold-out losses are given."""
    def run(rows, w, idf):
        seen.append(w.copy())
        target = np.arange(1, w.size + 1).reshape(w.shape)
        held = held_by_epoch[min(len(seen), len(held_by_epoch)) - 1]
        return ((w - target) ** 2).sum(0) * 0.5, np.full(w.shape[1], held), w - target, (1, 1)
    return run


def test_the_best_epoch_comes_back():
    seen = []
    held = [9, 8, 7, 1, 2, 3, 4, 5, 6, 0]               # epoch 4 is best; the tenth is never reached
    end = JM.train(None, np.zeros(4), 2, 0.0, 25, 5, run=_bowl(held, seen))
    assert end.epoch == len(seen) == 9 and end.best_epoch.tolist() == [4, 4]
    np.testing.assert_array_equal(end.best, seen[3])
    assert JM.train(None, np.zeros(4), 2, 0.0, 6, 5, run=_bowl(list(range(30, 0, -1)), [])).epoch == 6


def test_a_lost_driver_goes_on(spark, tmp_path, monkeypatch):
    df = _texts(spark, 150).filter("a is not null")
    tr, va = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    fit = lambda **more: JM.fit_joint(tr, "text", TOPICS, valid=va, num_features=256, max_epochs=6, **more)
    whole = fit()
    run, calls = JM.run_pass, []

    def dies(*x):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("driver lost")
        return run(*x)

    monkeypatch.setattr(JM, "run_pass", dies)
    with pytest.raises(RuntimeError):
        fit(state_dir=str(tmp_path / "s"))
    again = fit(state_dir=str(tmp_path / "s"))
    assert len(calls) == 4 + (whole.epochs - 3) and again.epochs == whole.epochs     # three epochs were not run again
    np.testing.assert_allclose(again.weights, whole.weights, atol=1e-9)


def test_store_keeps_the_former_version_until_the_new_one_is_whole(spark, tmp_path):
    root = str(tmp_path / "m")
    m = JM.JointTopicModel(np.ones((9, 2)), np.ones(8), ["a", "b"], "text", 3, [1, 2], [0.5, 0.4], [0.1, 0.1])
    with pytest.raises(FileNotFoundError):
        JM.JointTopicModel.load(spark, root)
    m.save(spark, root)

    def killed(folder):
        spark.range(3).write.parquet(f"{folder}/weights")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.publish(spark, root, killed)
    assert JM.JointTopicModel.load(spark, root).topics == ["a", "b"]
    JM.JointTopicModel(m.weights * 2, m.idf, ["a", "c"], "text", 4, [1, 1], [], []).save(spark, root)
    back = JM.JointTopicModel.load(spark, root)
    assert back.topics == ["a", "c"] and back.weights.max() == 2 and back.epochs == 4
    assert len([p for p in (tmp_path / "m").iterdir() if p.is_dir()]) == 1           # nothing left over
    docs = spark.createDataFrame([(1, "x y"), (2, None)], "id long, text string")
    assert [len(r.probabilities) for r in back.score(docs).collect()] == [2, 2]


def test_tasks_follow_words_not_partitions(spark, monkeypatch):
    """An epoch's gradients come from as many tasks as the words need, whatever the partitions of the input; repeats count."""
    seen, run = [], JM.run_pass
    monkeypatch.setattr(JM, "run_pass", lambda rows, *x: seen.append(rows.rdd.getNumPartitions()) or run(rows, *x))
    df = spark.createDataFrame([(i, "good good fine" if i % 2 else "bad " * (i % 5), i % 2) for i in range(60)], "id int, text string, y int").repartition(23)
    m = JM.fit_joint(df, "text", ["y"], num_features=64, max_epochs=2)
    assert set(seen) == {1} and m.epochs == 2
    held = df.select(JM.features(F.col("text"), 64).alias("words"), F.array(F.col("y").cast("double")).alias("y"), F.lit(0).alias("held"))
    used = {f for r in held.select("words").collect() for f in r["words"]}
    assert {i for i in range(64) if m.idf[i]} == used
