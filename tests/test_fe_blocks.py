"""Absorption by blocks (above DRIVER_VALUES) against dummy variables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import fe, fe_blocks
from sparkpanel.session import Saved, release_unused


def _rows(seed=3, n=900):
    rng = np.random.default_rng(seed)
    # unit 0 is hot, pairs repeat; every 50th row lacks a level and takes no part in the end
    return [(i, int(rng.integers(0, 60)) if i % 3 else 0, int(rng.integers(0, 25)), int(rng.integers(0, 9)), float(rng.normal() + 1e4), float(rng.normal())) for i in range(n)]


@pytest.mark.parametrize("fes", [["u", "s"], ["u", "s", "t"]])
def test_blocks_equal_dummies(spark, monkeypatch, fes):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, u int, s int, t int, a double, b double").union(spark.createDataFrame([(-1, None, 3, 1, 1.0, 1.0)], "k int, u int, s int, t int, a double, b double"))
    monkeypatch.setattr(fe, "DRIVER_VALUES", 0)
    monkeypatch.setattr(fe_blocks, "LEAST_VALUES", 16)      # several parts an FE
    monkeypatch.setattr(fe_blocks, "BLOCK_CELLS", 7)        # several rows a block
    sent = []
    spread = fe_blocks._spread
    monkeypatch.setattr(fe_blocks, "_spread", lambda *a, **k: sent.append(spread(*a, **k)) or sent[-1])
    got = {r["k"]: (r["a"], r["b"]) for r in fe.absorb(df, ["a", "b"], fes).collect()}
    at = {"u": 1, "s": 2, "t": 3}
    x = np.column_stack([np.array([r[at[f]] == v for r in rows], float) for f in fes for v in sorted({r[at[f]] for r in rows})])
    y = np.array([r[4:] for r in rows])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert sorted(got) == [r[0] for r in rows]
    assert np.abs(np.array([got[r[0]] for r in rows]) - want).max() < 1e-7
    # the blocks stay where they are: what is exchanged for a pass is the vectors
    plan = sent[-1]._jdf.queryExecution().executedPlan().toString()
    held = plan[plan.index("ShuffledHashJoin"):plan.index("InMemoryTableScan")]
    assert "Exchange" not in held


def test_a_block_is_one_row(spark):
    """Repeated cells are counted within their block, and there are as many rows as pairs of parts, both ways."""
    pairs = spark.range(5000).selectExpr("cast(id % 2 as int) a", "cast(2 + id % 3 as int) b", "cast(id % 7 as int) i", "cast(id % 5 as int) j")
    blocks = pairs.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(fe_blocks._pack(2), "back boolean, src int, dst int, at binary, first binary, take binary, c binary").collect()
    assert sorted((r["src"], r["dst"]) for r in blocks) == sorted([(a, b) for a in (0, 1) for b in (2, 3, 4)] + [(b, a) for a in (0, 1) for b in (2, 3, 4)])
    assert sum(np.frombuffer(r["c"], float).sum() for r in blocks) == 2 * 5000


def test_rows_in_slices_leave_no_files_behind(spark, monkeypatch):
    """Saved rows are taken slice by slice: results as with dummy variables, null keys left out, and what a slice has used up is gone."""
    rows = [(*r, "x" * (r[0] % 5)) for r in _rows(5, 1200)]
    cut = [(-1, None, 3, 1, 1.0, 1.0, "n"), (-2, None, None, 1, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + cut, "k int, u int, s int, t int, a double, b double, note string").repartition(6)
    monkeypatch.setattr(fe, "DRIVER_VALUES", 0)
    monkeypatch.setattr(fe_blocks, "SLICE_ROWS", 100)
    saved = []

    class Saved(fe_blocks.Saved):
        def __init__(self, frame):
            super().__init__(frame)
            self.rows = frame.count()
            saved.append(self)

    monkeypatch.setattr(fe, "Saved", Saved)
    monkeypatch.setattr(fe_blocks, "Saved", Saved)
    out = fe.absorb(df, ["a", "b"], ["u", "s"])
    got = {r["k"]: r for r in out.collect()}
    x = np.column_stack([np.array([r[k] == v for r in rows], float) for k in (1, 2) for v in sorted({r[k] for r in rows})])
    y = np.array([r[4:6] for r in rows])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert sorted(got) == [r[0] for r in rows] and out.columns == ["k", "u", "s", "t", "note", "a", "b"]
    assert np.abs(np.array([(got[r[0]]["a"], got[r[0]]["b"]) for r in rows]) - want).max() < 1e-7
    assert [got[r[0]]["note"] for r in rows] == [r[6] for r in rows]
    left = [s for s in saved if s._fs.exists(s._at) and any(x.getPath().getName().startswith("part-") for x in s._fs.listStatus(s._at))]
    assert len(left) == fe_blocks.SLICES and sum(s.rows for s in left) == len(rows)       # the results alone


def test_saved_frames(spark):
    df = spark.range(10, numPartitions=5).selectExpr("id", "cast(null as void) v")
    whole = Saved(df.drop("v"))
    slices = whole.slices(3)
    assert sorted(r["id"] for frame, _ in slices for r in frame.collect()) == list(range(10)) and len(slices) == 3
    slices[0][1]()
    assert sum(frame.count() for frame, _ in slices[1:]) == Saved(spark.read.schema("id long").parquet(whole.path)).frame.count() < 10
    whole.drop()
    assert not whole._fs.exists(whole._at)
    held = Saved(df)        # no Parquet type
    assert held.frame.count() == 10 and held.frame.is_cached and len(held.slices(3)) == 1
    held.drop()
    assert not df.is_cached


def test_shuffle_files_go_when_nothing_refers_to_them(spark):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    release_unused(spark)

    def count():
        return spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count().collect()

    for _ in range(20):
        count()
    before = tracker.shuffleStatuses().size()
    assert before >= 20
    for _ in range(50):
        release_unused(spark)
        if tracker.shuffleStatuses().size() <= before - 20:
            break
        time.sleep(0.2)
    assert tracker.shuffleStatuses().size() <= before - 20
