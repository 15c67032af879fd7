"""Nearest neighbours by a block matrix join (operator 2).

The stated queries and all candidates are dealt into tiles; each pair of a
query tile and a candidate tile is one cell, a group of bounded size.  Within a
cell:

* unit vectors are quantised to int8 (one scale a vector) and multiplied tile
  by tile; products of int8 are summed exactly in float32 up to 1,040 dimensions
  and in float64 beyond;
* the norm ``e`` of each vector's quantisation error is known exactly, so the
  cosine lies within ``e_q + (1 + e_q) * e_c`` of the product;
* a candidate whose upper bound is below the k-th largest lower bound found so
  far cannot be among the k nearest and is dropped; the others are recomputed in
  double precision from the original vectors and pushed on the query's heap.

Equal vectors of a tile are multiplied once: only the k + 1 smallest ids of a
vector can be among k neighbours (ties go to the smaller id), so a vector that
makes up a third of the table costs one row a tile.  The heaps of a query's
cells meet in one ranking of at most k rows a cell.  The result is exact.

Defined results: rows without an id and vectors that are null, empty, zero or
hold null or non-finite numbers take no part; rows that repeat an id count once
(smallest vector in array order); vectors of other lengths than the query's are
not its candidates; with fewer candidates than k all are returned; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkpanel.llm.common import table, written

QUERY_TILE = 2_048
CANDIDATE_TILE = 8_192
#: Rows of a tile that are multiplied at once, and pairs recomputed at once.
STEP, PAIRS = 2_048, 32_768


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and norm of the error of unit vectors (rows)."""
    scale = np.abs(v).max(1) / 127
    code = np.rint(v / scale[:, None]).astype(np.int8)
    return code, scale, np.sqrt(((v - code * scale[:, None]) ** 2).sum(1)) + 1e-12


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def unique_rows(ids: np.ndarray, x: np.ndarray, most: int | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """First row of each distinct vector, and its ids in order (the ``most`` smallest)."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(x)[order].view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, of = np.unique(rows, return_index=True, return_inverse=True)
    by = np.argsort(of, kind="stable")
    groups = np.split(ids[order][by], np.flatnonzero(np.diff(of[by])) + 1)
    return order[first], [g[:most] for g in groups]


def search_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, candidate id, cosine) of each query's k nearest in one cell."""
    q, c = q + 0.0, c + 0.0      # -0.0 and 0.0 are one value
    first_q, ids_q = unique_rows(q_ids, q, None)
    first_c, ids_c = unique_rows(c_ids, c, k + 1)
    q, c = q[first_q].astype(np.float64), c[first_c].astype(np.float64)
    many = np.fromiter(map(len, ids_c), np.int64, len(ids_c))
    wide = np.float32 if q.shape[1] <= 1040 else np.float64
    unit = lambda v: (v / np.abs(v).max(1, keepdims=True)) / np.sqrt(((v / np.abs(v).max(1, keepdims=True)) ** 2).sum(1, keepdims=True))
    code_q, scale_q, err_q = quantise(unit(q))
    heaps: list[list[tuple[float, int]]] = [[] for _ in ids_q]   # (cosine, -id): the worst on top
    for a in range(0, len(c), STEP):
        code_c, scale_c, err_c = quantise(unit(c[a:a + STEP]))
        copies = many[a:a + STEP]
        tile_c = code_c.astype(wide)
        for b in range(0, len(q), STEP):
            near = (code_q[b:b + STEP].astype(wide) @ tile_c.T).astype(np.float64) * scale_q[b:b + STEP, None] * scale_c
            slack = err_q[b:b + STEP, None] + (1 + err_q[b:b + STEP, None]) * err_c + 1e-9
            lower = near - slack
            # k + 1 (one may be the query itself) lower bounds; each copy of a vector counts once, which only loosens
            floor = np.full(len(lower), -np.inf)
            if lower.shape[1] > k + 1:
                floor = np.partition(lower, lower.shape[1] - k - 1, axis=1)[:, lower.shape[1] - k - 1]
            held = np.array([h[0][0] if len(h) > k else -np.inf for h in heaps[b:b + STEP]])
            row, col = np.nonzero(near + slack >= np.maximum(floor, held)[:, None])
            for s in range(0, len(row), PAIRS):
                i, j = row[s:s + PAIRS], col[s:s + PAIRS]
                score = cosines(q[b + i], c[a + j])
                for r, at, x in zip((b + i).tolist(), (a + j).tolist(), score.tolist()):
                    heap = heaps[r]
                    for cid in ids_c[at].tolist():
                        item = (x, -cid)
                        if len(heap) <= k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)
                        else:
                            break                                 # further copies have larger ids
    out = []
    for ids, heap in zip(ids_q, heaps):
        best = sorted(heap, reverse=True)
        for qid in ids.tolist():
            out += [(qid, -cid, x) for x, cid in [h for h in best if -h[1] != qid][:k]]
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id long and v array<float or double> of the rows that take part, one an id."""
    v = F.col("v")
    kind = "array<double>" if "double" in df.schema[vec_col].dataType.simpleString() else "array<float>"
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].cast(kind).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            query_tile: int = QUERY_TILE, candidate_tile: int = CANDIDATE_TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row of which ``is_query`` (over vec_id) holds."""
    rows = written(usable(df, id_col, vec_col))
    n, n_q = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    tiles_c, tiles_q = max(1, -(-n // candidate_tile)), max(1, -(-n_q // query_tile))
    tile = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    dims = F.size("v").alias("dims")
    cand = rows.select("vec_id", "v", dims, tile(tiles_c).alias("ct"), F.explode(F.sequence(F.lit(0), F.lit(tiles_q - 1))).alias("qt"))
    quer = rows.filter(is_query).select("vec_id", "v", dims, tile(tiles_q).alias("qt"), F.explode(F.sequence(F.lit(0), F.lit(tiles_c - 1))).alias("ct"))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            found = search_cell(q["vec_id"].to_numpy(), np.stack(q["v"].to_numpy()), c["vec_id"].to_numpy(), np.stack(c["v"].to_numpy()), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["ct", "qt", "dims"]
    found = quer.groupBy(*key).cogroup(cand.groupBy(*key)).applyInPandas(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, min(embedding)::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
