import math

import numpy as np
from pyspark.sql import functions as F

from sparkpanel.llm import hard_negatives as H


def brute(rows, positives=5, keep=3, low=50, high=95, every=10):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    code = {i: [math.floor(256 * float(np.float64(x))) for x in v] for i, (_, v) in kept.items()}
    out = set()
    for a in (i for i in kept if i % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(code[a], code[c])), c) for c in kept if c != a and len(code[c]) == len(code[a]))
        same = [(-s, c) for s, c in scored if kept[c][0] == kept[a][0]][:positives]
        for ps, p in same:
            fit = [(-s, c) for s, c in scored if kept[c][0] != kept[a][0] and low * ps <= -100 * s <= high * ps]
            out |= {(a, p, r + 1, c, ps, s) for r, (s, c) in enumerate(fit[:keep])}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, score int, anchor_id string")
    found = H.mine(df, F.col("vec_id") % 10 == 0, **more).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def test_equals_brute_force_with_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6)).round(1)
    v[100:200] = v[100]                                     # a third are one vector
    v[210:230] = 0.0                                        # windows of score 0
    rows = [(i, int(i % 3), x.tolist()) for i, x in enumerate(v)]
    rows += [(400, None, [1.0] * 6), (410, 1, None), (420, 1, [float("nan")] * 6), (430, 1, [None] * 6), (None, 1, [1.0] * 6), (440, 0, []), (441, 0, []),
             (442, 1, []), (450, 1, [1.0, 2.0]), (451, 1, [1.0, 2.0]), (452, 2, [0.7, 1.2]), (20, 0, [9.0] * 6), (20, 2, rows[20][2])]
    want = brute(rows)
    assert len(want) > 200 and any(r[4] == 0 for r in want)
    assert run(spark, rows) == want
    assert run(spark, rows, anchor_tile=8, candidate_tile=40, group=2) == want
    assert run(spark, rows[:3]) == brute(rows[:3])
    assert run(spark, []) == set()


def test_large_components_are_exact_or_clipped(spark):
    rng = np.random.default_rng(1)
    for size in (1e3, 1e5, 3e6):
        rows = [(i, i % 2, (rng.normal(size=4) * size).tolist()) for i in range(60)]
        want = brute(rows)
        assert want and run(spark, rows) == want
    rows = [(i, i % 2, [1e30 * (i + 1)]) for i in range(20)]
    assert all(abs(r[4]) <= H.LONG and abs(r[5]) <= H.LONG for r in run(spark, rows))


def test_products_agree_in_all_types():
    rng = np.random.default_rng(2)
    for most in (100, 10_000, 10 ** 7, 10 ** 9):
        a, c = (rng.integers(-most, most, (5, 8)) for _ in range(2))
        assert (H.products(a, c) == (a.astype(object) @ c.astype(object).T).clip(-H.LONG, H.LONG).astype(np.int64)).all()


def test_blocks_do_not_change_the_best():
    rng = np.random.default_rng(4)
    best = H.Best(3, 2)
    rows = [(int(rng.integers(3)), int(rng.integers(5)), i) for i in range(40)]
    for part in range(0, 40, 7):
        best.add(*map(np.array, zip(*rows[part:part + 7])))
    want = [sorted((r for r in rows if r[0] == s), key=lambda r: (-r[1], r[2]))[:2] for s in range(3)]
    assert list(zip(best.slot.tolist(), best.score.tolist(), best.id.tolist())) == [r for w in want for r in w]
