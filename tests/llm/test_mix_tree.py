import numpy as np
import pytest

from sparkpanel.llm import mix_tree as M

SF = "/root/testdata/sf0.01"


def brute_targets(sizes, weights, share, most):
    """Share out, stop what is above, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, rest, free = {s: 0.0 for s in order}, share * sum(sizes.values()), set(order)
    while rest > 1e-9 and free:
        unit = rest / sum(w[s] for s in free)
        rest = 0.0
        for s in list(free):
            got[s] += unit * w[s]
            if got[s] > most * sizes[s]:
                rest += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
                free.discard(s)
    return got


def check(rows, small=1.0):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken in (0, r.size, 2 * r.size) and len(r.shards) <= 2
    want = brute_targets(sizes, M.WEIGHTS, M.SHARE, M.MOST)
    for s in sizes:
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in rows if r.source == s)
        assert abs(taken[s] - want[s]) <= small * max(r.size for r in rows if r.source == s)
    return sizes, taken, want


def test_targets_and_taken_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = M.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.size == len([w for w in r.text.replace("\t", " ").split() if w]) for r in rows[:50])
    sizes, taken, want = check(rows)
    assert all(abs(taken[s] - want[s]) < 0.003 * want[s] for s in sizes)
    again = {(r.doc_id, r.taken, tuple(r.shards)) for r in M.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken, tuple(r.shards)) for r in rows}


def test_edges(spark):
    rows = [(i, "w " * (i % 7), None if i % 3 == 0 else "é" if i % 3 == 1 else "z", 1.0) for i in range(200)]
    rows += [(500, None, "empty", 1.0), (501, "", "empty", 1.0), (502, "big " * 30_000, "a", 1.0), (None, "x y", "a", 1.0), (1, rows[1][1], "é", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    check(got)
    assert M.mix(df.limit(0)).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in M.mix(df.filter("source = 'empty'")).collect())


def test_tree_keeps_every_count_and_is_fair():
    quotas = np.array([1000, 0, 7, 250])
    parts = {k: (a, n) for k, a, n in M.walk(quotas, 13, 0, 13)}
    assert (sum(n for _, n in parts.values()) == quotas).all()
    assert {int(n.sum()) for _, n in parts.values()} <= {1257 // 13, 1257 // 13 + 1}
    for s in range(4):      # ranges follow each other without gaps
        at = 0
        for k in range(13):
            assert parts[k][0][s] == at
            at += parts[k][1][s]
    for k, a, n in M.walk(quotas, 13, 4, 6):
        assert (parts[k][0] == a).all() and (parts[k][1] == n).all()
    mean = np.mean([[n[0] for _, _, n in M.walk(quotas, 13, 0, 13, seed)] for seed in range(300)], axis=0)
    assert np.abs(mean - 1000 / 13).max() < 1


def test_shards_hold_each_copy_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    mixed = M.mix(df, shards=6)
    M.write_shards(mixed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.shard) for r in back.collect()) == sorted((r.doc_id, s) for r in mixed.collect() for s in r.shards)


def test_taken_blocks_are_read_from_files(spark):
    """Their size is then known before the texts are joined with them, so few blocks are broadcast and no text is shuffled."""
    rows = spark.createDataFrame([(i, "some words here " * (i % 7), "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    _, taken = M.plan(rows)
    assert taken.inputFiles() and "Aggregate" not in taken._jdf.queryExecution().optimizedPlan().toString()
