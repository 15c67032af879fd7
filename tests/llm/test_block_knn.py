import numpy as np
from pyspark.sql import functions as F

from sparkpanel.llm import block_knn as K


def brute(rows, k, is_query):
    kept = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: (r[0], r[1] if None not in r[1] else [])):
        if all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept.setdefault(i, np.array(v, np.float32).astype(float))
    out = set()
    for q, a in kept.items():
        if is_query(q):
            near = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), c)
                          for c, b in kept.items() if c != q and len(b) == len(a))
            out |= {(q, r + 1, c, round(-s, 12)) for r, (s, c) in enumerate(near[:k])}
    return out


def run(spark, rows, k, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, score string")
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in K.nearest(df, F.col("vec_id") % 7 == 0, k, **more).collect()}


def test_equals_brute_force_with_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 12)).astype(np.float32)
    vecs[100:200] = vecs[100]                      # a third are one vector
    vecs[200:210] = vecs[3] + rng.normal(size=(10, 12)) * 1e-4
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(vecs)]
    rows += [(400, None, 1, ""), (401, [0.0] * 12, 1, ""), (406, [float("nan")] * 12, 1, ""), (413, [None] * 12, 1, ""), (None, [1.0] * 12, 1, ""),
             (420, [], 1, ""), (427, [1.0, 2.0], 1, ""), (5, rows[5][1], 1, "again")]
    want = brute([r[:2] for r in rows], 5, lambda i: i % 7 == 0)
    assert run(spark, rows, 5) == want
    assert run(spark, rows, 5, query_tile=16, candidate_tile=50) == want
    few = rows[:4]
    assert run(spark, few, 5) == brute([r[:2] for r in few], 5, lambda i: i % 7 == 0)
    assert run(spark, [], 5) == set()


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 64))
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    code, scale, err = K.quantise(v)
    near = (code.astype(float) @ code.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(v @ v.T - near) <= err[:, None] + (1 + err[:, None]) * err + 1e-9).all()
