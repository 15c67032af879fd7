"""Hard-negative mining by a secondary-sort shuffle (operator 11).

A component x of a vector becomes the whole number floor(256 * x); the score of
two rows is the inner product of their codes, in whole numbers.

* The anchors and all rows are packed into tiles; an anchor tile meets the
  candidate tiles group by group (``cogroup``), so no task holds more than one
  anchor tile and ``GROUP`` candidate tiles.
* First pass, rows of the anchor's label: a group sends each anchor's best
  ``positives`` rows; the best of these are the anchor's positives, and each
  opens a window of scores.
* Second pass, rows of other labels: a group sends each anchor's best ``keep``
  rows a window.  What it holds back has ``keep`` better rows in the same
  window, so nothing that could be returned is lost, and the shuffle has a
  bounded number of rows an anchor and group instead of one a pair.
* Positives and negatives are shuffled by anchor under the packed key (anchor,
  descending score, kind, id) and sorted within partitions.  An iterator reads
  them in that order with the open windows of one anchor as its only state:
  a positive opens a window, a negative goes to every window that holds its
  score and is not full.

A negative's score is at most the positive's wherever a window is not empty, so
every window is open before its first negative comes by (equal scores: positives
first).

Defined results: rows without an id, label or vector, or with a null or
non-finite component take no part; rows that repeat an id count once (smallest
label, then vector); vectors of another length are not compared; empty vectors
score 0; an anchor without positives, or a window without negatives, gives no
rows; a window of a negative positive score is empty; scores beyond 64 bits are
clipped to them; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkpanel.llm.common import table, written

ANCHOR_TILE = 4_096
CANDIDATE_TILE = 8_192
#: Candidate tiles that one task compares with an anchor tile, at most.
GROUP = 32
#: Anchors and candidates that are multiplied at once.
ROWS, STEP = 512, 2_048
LONG = (1 << 63) - 1


def codes(v: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component, in the smallest type that holds it."""
    x = np.floor(v.astype(np.float64) * 256.0)
    most = np.abs(x).max(initial=0)
    for kind, limit in ((np.int16, 1 << 15), (np.int32, 1 << 31), (np.int64, 1 << 62)):
        if most < limit:
            return x.astype(kind)
    return np.vectorize(int, otypes=[object])(x)


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact; int64, clipped where they do not fit."""
    size = lambda m: int(max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))) if m.size else 0
    bound = max(1, a.shape[1]) * size(a) * size(c)
    if bound < 1 << 24:
        return (a.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < LONG:
        return a.astype(np.int64) @ c.astype(np.int64).T
    exact = a.astype(object) @ c.astype(object).T
    return np.clip(exact, -LONG, LONG).astype(np.int64)


class Best:
    """The k best (largest score, then smallest id) of each slot, from blocks of scores."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(slots, -LONG - 1)      # score of the k-th best so far

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        last = place == self.k - 1
        self.floor[slot[last]] = score[last]
        kept = place < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]


def pack(rows: pd.DataFrame, with_windows: bool) -> pd.DataFrame:
    """One row that holds a whole tile: ids, labels, codes, and the windows' bounds."""
    rows = rows.sort_values(["label", "vec_id"], kind="stable")
    m = codes(np.stack([np.asarray(v, np.float64) for v in rows["v"]]))
    out = {"ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "labels": rows["label"].to_numpy(np.int64).tobytes(),
           "kind": str(m.dtype), "m": m.tobytes() if m.dtype != object else repr(m.tolist()).encode(), "windows": b"", "wide": 0}
    if with_windows:
        wide = max(map(len, rows["scores"])) // 2
        w = np.full((len(rows), wide, 2), (LONG, -LONG), np.int64)        # (least, most); none fits a missing window
        for i, s in enumerate(rows["scores"]):
            w[i, :len(s) // 2] = np.asarray(s).reshape(-1, 2)
        out |= {"windows": w.tobytes(), "wide": wide}
    return pd.DataFrame([out])


def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
    if row.kind == "object":
        import ast
        m = np.array(ast.literal_eval(row.m.decode()), object).reshape(len(ids), -1)
    else:
        m = np.frombuffer(row.m, row.kind).reshape(len(ids), -1)
    return ids, labels, m


def same_label(anchors, tiles, k: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor ids, scores, ids) of each anchor's k best other rows of its label."""
    ids, labels, m = anchors
    best = Best(len(ids), k)
    for c_ids, c_labels, c in tiles:                # both sides are sorted by label
        for label in np.intersect1d(labels, c_labels):
            a0, a1 = np.searchsorted(labels, (label, label + 1))
            c0, c1 = np.searchsorted(c_labels, (label, label + 1))
            for a in range(a0, a1, ROWS):
                b = min(a + ROWS, a1)
                for s in range(c0, c1, STEP):
                    e = min(s + STEP, c1)
                    score = products(m[a:b], c[s:e])
                    i, j = np.nonzero((score >= best.floor[a:b, None]) & (ids[a:b, None] != c_ids[s:e]))
                    best.add(a + i, score[i, j], c_ids[s:e][j])
    return [(ids[best.slot], best.score, best.id)]


def other_labels(anchors, windows: np.ndarray, tiles, k: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor ids, scores, ids) of the k best rows of other labels in each of an anchor's windows."""
    ids, labels, m = anchors
    out = []
    for a in range(0, len(ids), ROWS):
        b, wide = min(a + ROWS, len(ids)), windows.shape[1]
        best = Best((b - a) * wide, k)
        for c_ids, c_labels, c in tiles:
            for s in range(0, len(c_ids), STEP):
                score = products(m[a:b], c[s:s + STEP])
                other = labels[a:b, None] != c_labels[s:s + STEP]
                for w in range(wide):
                    least = np.maximum(windows[a:b, w, 0], best.floor[w::wide])
                    i, j = np.nonzero(other & (score >= least[:, None]) & (score <= windows[a:b, w, 1, None]))
                    best.add(i * wide + w, score[i, j], c_ids[s:s + STEP][j])
        pair = np.unique(np.stack([ids[a + best.slot // wide], best.score, best.id]), axis=1)     # in several windows: sent once
        out.append(tuple(pair))
    return out


def usable(df: DataFrame, label: Column, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, label and v of the rows that take part, one an id."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(df[id_col].cast("long").alias("vec_id"), label.cast("long").alias("label"), df[vec_col].cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


TILE = "dims int, at int, ids binary, labels binary, kind string, m binary, windows binary, wide int"


def tiles(rows: DataFrame, n: int) -> DataFrame:
    """Rows packed into ``n`` tiles for each length of vectors."""
    with_windows = "scores" in rows.columns

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pack(part, with_windows).assign(dims=key[0], at=key[1])[["dims", "at", "ids", "labels", "kind", "m", "windows", "wide"]]

    at = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("at")
    return rows.select("*", F.size("v").alias("dims"), at).groupBy("dims", "at").applyInPandas(one, TILE)


def best_pairs(anchors: DataFrame, cand: DataFrame, n_anchor: int, n_cand: int, group: int, same: bool, k: int) -> DataFrame:
    """anchor_id, score, id: what each group of candidate tiles has for each anchor."""
    groups = -(-n_cand // group)
    left = anchors.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = cand.withColumn("grp", (F.col("at") % groups).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n_anchor - 1))))

    def cell(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(c):
            (row,) = a.itertuples()
            parts = [unpack(x) for x in c.itertuples()]
            if same:
                found = same_label(unpack(row), parts, k)
            else:
                found = other_labels(unpack(row), np.frombuffer(row.windows, np.int64).reshape(-1, row.wide, 2), parts, k)
        anchor, score, ids = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"anchor_id": anchor, "score": score, "id": ids})

    key = ["dims", "at", "grp"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(cell, "anchor_id long, score long, id long")


def windows_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest whole score s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def emit(keep: int, low: int, high: int):
    """The iterator over rows sorted by (anchor, descending score, kind, id)."""

    def read(batches):
        anchor, open_ = None, []                    # open windows: [positive, its score, least, most, emitted]
        for batch in batches:
            out = []
            key = batch.column("key")
            for a, kind, i, s in zip(*(key.field(f).to_pylist() for f in ("anchor_id", "kind", "id")), batch.column("score").to_pylist()):
                if a != anchor:
                    anchor, open_ = a, []
                if kind == 0:
                    open_.append([i, s, *windows_of(s, low, high), 0])
                    continue
                for w in open_:
                    if w[2] <= s <= w[3] and w[4] < keep:
                        w[4] += 1
                        out.append((a, w[0], w[4], i, w[1], s))
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "rank" else pa.int64()) for c, n in zip(cols, names)], names=names)

    return read


def mine(df: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, keep: int = 3, low: int = 50, high: int = 95,
         id_col: str = "vec_id", vec_col: str = "embedding", anchor_tile: int = ANCHOR_TILE, candidate_tile: int = CANDIDATE_TILE,
         group: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (rows of which ``is_anchor`` holds, over vec_id) and each of its first ``positives`` rows of equal
    label: the first ``keep`` rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    """
    spark = df.sparkSession
    rows = written(usable(df, df["label"] if label is None else label, id_col, vec_col))
    n, n_anchor = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    n_a, n_c = max(1, -(-n_anchor // anchor_tile)), max(1, -(-n // candidate_tile))
    # enough cells for all cores, and no more than GROUP tiles in one
    group = group or max(1, min(GROUP, n_a * n_c // (4 * spark.sparkContext.defaultParallelism)))
    cand = written(tiles(rows, n_c))
    anchors = rows.filter(is_anchor)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = best_pairs(tiles(anchors, n_a), cand, n_a, n_c, group, True, positives)
    pos = written(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= positives).drop("r"))
    score = F.col("score")
    # exact in decimals: a score may use all 64 bits
    wide = score.cast("decimal(20,0)")
    least, most = F.ceil(wide * low / 100).cast("long"), F.floor(wide * high / 100).cast("long")
    opened = pos.groupBy("anchor_id").agg(F.flatten(F.collect_list(F.array(least, most))).alias("scores"))
    with_windows = anchors.join(opened.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    neg = best_pairs(tiles(with_windows, n_a), cand, n_a, n_c, group, False, keep)
    both = pos.withColumn("kind", F.lit(0)).unionByName(neg.withColumn("kind", F.lit(1)))
    keyed = both.select(F.struct("anchor_id", F.bitwise_not(score).alias("falling"), "kind", "id").alias("key"), "score")     # ~s falls as s rises, without overflow
    dealt = keyed.repartition(F.col("key.anchor_id")).sortWithinPartitions("key")
    return dealt.mapInArrow(emit(keep, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: vec_id divisible by 50; labels of ids divisible by 7 are moved on by one first."""
    df = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df, F.col("vec_id") % 50 == 0, moved)


ORACLE = """
WITH e AS (
  SELECT vec_id, x.label AS label, list_transform(x.v, lambda c: floor(256 * c)) AS v
  FROM (SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, 'v': embedding::DOUBLE[]}) AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        GROUP BY vec_id)),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
      FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3
"""
