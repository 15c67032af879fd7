"""Absorption of fixed effects with very many levels, by blocks.

The same conjugate gradient as in ``fe``, with every vector in Spark.  The levels of
each FE are dealt by hash over parts and numbered within them, so a vector is one row
a part.  The cells (unit, level) are written once as blocks, one row for the cells
between two parts, in both directions, each laid out by the part it reads from.  A
product with A is then two passes over the blocks: ``sums of the levels' values by
unit`` and ``unit means back to the levels``.  A task multiplies a block with numpy,
and what is shuffled is one row of sums for each pair of parts that meet, with the
levels that occur in it, never a row for each cell.

Two small FEs and more also meet each other: their blocks carry the direct terms.
Only one number per column, part and dot product reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkpanel.session import Saved, cut_lineage, release_unused, ship

PARTS = 6                   # parts of an FE, unless its vectors ask for fewer or more
LANES = 2                   # the blocks that read from one part are dealt over as many tasks
LEAST_VALUES = 1 << 15      # an FE has a part for as many doubles of a vector, up to PARTS of them
PART_VALUES = 1 << 22       # no part holds more than about as many
BLOCK_CELLS = 1 << 22       # cells of a block's row
SLICES = 4                  # saved rows are joined with levels in so many slices, one after the other, to hold fewer shuffled rows at a time
SLICE_ROWS = 1 << 22        # but in slices of about as many rows at least

_TYPES = {"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "double": pa.float64()}


def _map_rows(df: DataFrame, one, schema: str) -> DataFrame:
    """``one`` (row as a dict -> values in the order of ``schema``) over all rows."""
    fields = [f.split() for f in schema.split(", ")]
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out = one({k: batch.column(k)[i].as_py() for k in batch.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array([v], _TYPES[t]) for v, (_, t) in zip(out, fields)], names=[n for n, _ in fields])

    return df.mapInArrow(run, schema)


def _vec(data: bytes, m: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, m)


def _block(src: int, dst: int, s: np.ndarray, d: np.ndarray, c: np.ndarray, back: bool) -> tuple:
    """The cells of a block by the levels they add to: these levels, their first cells, the levels read, the counts (empty: all 1)."""
    order = np.argsort(d, kind="stable")
    s, d, c = s[order], d[order], c[order]
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    ints = lambda x: x.astype(np.int32).tobytes()
    return back, src, dst, ints(d[first]), ints(first), ints(s), b"" if (c == 1).all() else c.astype(np.float64).tobytes()


def _pack(units: int):
    """Rows (a, b, i, j) sorted by the parts a and b: level i of a meets level j of b.  Blocks in both directions.

    ``back`` marks those that read from a unit (parts below ``units``).
    """

    def rows(a, b, pieces):
        code, c = np.unique(np.concatenate(pieces), return_counts=True)
        i, j = code >> 32, code & 0xFFFFFFFF
        return [_block(a, b, i, j, c, a < units), _block(b, a, j, i, c, b < units)]

    def run(batches):
        key, held, n = None, [], 0
        names = ["back", "src", "dst", "at", "first", "take", "c"]
        types = [pa.bool_(), pa.int32(), pa.int32(), *[pa.binary()] * 4]

        def out():
            for row in rows(*key, held):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            a, b, i, j = (batch.column(k).to_numpy() for k in ("a", "b", "i", "j"))
            if not len(a):
                continue
            code = (i.astype(np.int64) << 32) | j
            cuts = np.r_[0, np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, len(a)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                now = (int(a[lo]), int(b[lo]))
                if held and (now != key or n >= BLOCK_CELLS):
                    yield from out()
                    held, n = [], 0
                key = now
                held.append(code[lo:hi])
                n += hi - lo
        if held:
            yield from out()

    return run


def _spread(blocks: DataFrame, vectors: DataFrame, m: int, power: int = 1) -> DataFrame:
    """(part, at, v): for every block the sums of its source's values, by the levels of its target that occur."""

    def one(row):
        x = _vec(row["v"], m)[np.frombuffer(row["take"], np.int32)]
        if row["c"]:
            x = x * np.frombuffer(row["c"], np.float64)[:, None] ** power
        return row["dst"], row["at"], np.add.reduceat(x, np.frombuffer(row["first"], np.int32), axis=0).tobytes()

    lanes = vectors.select(F.col("part").alias("src"), "v", F.explode(F.array(*[F.lit(k) for k in range(LANES)])).alias("lane"))
    joined = blocks.join(lanes.hint("shuffle_hash"), ["src", "lane"])      # the blocks are held in this layout and stay where they are
    return _map_rows(joined.select("dst", "at", "first", "take", "c", "v"), one, "part int, at binary, v binary")


def _gather(sums: DataFrame, sizes: dict[int, int], m: int) -> DataFrame:
    """(part, v): the sums of all blocks added up."""
    ship(sums.sparkSession)

    def run(batches):
        total = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column("part")[i].as_py()
                if part not in total:
                    total[part] = np.zeros((sizes[part], m))
                total[part][np.frombuffer(batch.column("at")[i].as_buffer(), np.int32)] += _vec(batch.column("v")[i].as_buffer(), m)
        for part, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["part", "v"])

    return sums.repartition("part").mapInArrow(run, "part int, v binary")


def _vectors(levels: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """(part, size, a vector for each name): the columns of a level table packed by part."""
    columns = [c for cs in names.values() for c in cs]
    ship(levels.sparkSession)

    def run(batches):
        held, part = [], None

        def out():
            t = pa.Table.from_batches(held)
            vecs = [np.column_stack([t.column(c).to_numpy() for c in cs]).astype(np.float64).tobytes() for cs in names.values()]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([v], pa.binary()) for v in vecs]], names=["part", *names])

        for batch in batches:
            p = batch.column("part").to_numpy()
            cuts = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1, len(p)] if len(p) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and part != p[lo]:
                    yield out()
                    held = []
                part = int(p[lo])
                held.append(batch.slice(lo, hi - lo).select(columns))
        if held:
            yield out()

    sorted_ = levels.repartition("part").sortWithinPartitions("part", "idx")
    return sorted_.select("part", *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, "part int, " + ", ".join(f"{n} binary" for n in names))


def _unpack(vectors: DataFrame, m: int, prefix: str) -> DataFrame:
    """(part, idx, one column a value) from (part, v)."""
    names = [f"{prefix}{i}" for i in range(m)]
    ship(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                v, part = _vec(batch.column("v")[i].as_buffer(), m), batch.column("part")[i].as_py()
                for lo in range(0, len(v), 100_000):
                    x = v[lo:lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part, np.int32)), pa.array(np.arange(lo, lo + len(x), dtype=np.int32)),
                                                      *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(m)]], names=["part", "idx", *names])

    return vectors.select("part", "v").mapInArrow(run, "part int, idx int, " + ", ".join(f"{n} double" for n in names))


def parts(levels: int, m: int) -> int:
    values = levels * m
    return max(min(PARTS, -(-values // LEAST_VALUES)), -(-values // PART_VALUES), 1)


def _by_slices(slices: list[tuple], one, use_up: bool = False) -> tuple[DataFrame, list[Saved]]:
    """(``one`` over the rows of all slices, what is saved for it): nothing for a single slice, or else the results, slice after slice."""
    if len(slices) == 1:
        return one(slices[0][0]), []
    saved, out = [], None
    for frame, drop in slices:
        saved.append(Saved(one(frame)))
        if use_up:
            drop()
        release_unused(frame.sparkSession)
        out = saved[-1].frame if out is None else out.unionByName(saved[-1].frame)
    return out, saved


def solve(d: DataFrame, cols: list[str], ucols: list[str], small: list[list[str]], levels: list[int], steps, rows: Saved | None = None) -> tuple[DataFrame, int, list[DataFrame]]:
    """(``d`` with ``cols`` residualised, number of CG steps, frames to release after use); ``levels``: of the unit and of the small FEs, about; ``steps``: see ``fe._Steps``.

    ``rows``: ``d`` in files of its own.  They are read in slices and deleted as their results are there.
    """
    m, fes, spark = len(cols), [ucols, *small], d.sparkSession
    release_unused(spark)
    keys = list(dict.fromkeys(c for f in fes for c in f))
    centre = d.agg(*[F.avg(c) for c in cols]).first()       # the FEs absorb a constant; sums lose fewer digits without it

    def centred(d: DataFrame) -> DataFrame:
        return d.withColumns({c: F.col(c) - F.lit(centre[k] if centre[k] is not None and np.isfinite(centre[k]) else 0.0) for k, c in enumerate(cols)})

    d = centred(d)
    whole = d.dropna(subset=keys)
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    base, tables = 0, []
    for i, f in enumerate(fes):
        n = parts(levels[i], m)
        if i == 0:
            t = d.dropna(subset=f).groupBy(*f).agg(F.count_if(complete).alias("n"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)],
                                                  *[(F.count_if(complete & F.col(c).isNull())).alias(f"z{k}") for k, c in enumerate(cols)]).filter("n > 0")
        else:
            t = whole.groupBy(*f).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"b{k}") for k, c in enumerate(cols)])
        part = (F.lit(base) + F.pmod(F.xxhash64(*f), F.lit(n))).cast("int")
        t = t.withColumn("part", part)
        t = t.withColumn("idx", (F.row_number().over(Window.partitionBy("part").orderBy(*f)) - 1).cast("int"))
        tables.append(cut_lineage(t))
        release_unused(spark)
        base += n
    unit, few = tables[0], tables[1:]
    units = parts(levels[0], m)
    sizes = {r["part"]: r["count"] for t in tables for r in t.groupBy("part").count().collect()}     # a row a part

    n_rows = unit.agg(F.sum("n")).first()[0] or 0
    slices = rows.slices(max(1, min(SLICES, n_rows // SLICE_ROWS))) if rows else [(None, None)]
    slices = [(centred(x).dropna(subset=keys), drop) for x, drop in slices] if len(slices) > 1 else [(whole, None)]

    # blocks: the unit with every small FE, and every two small FEs
    def met(some: DataFrame) -> DataFrame:
        at, pairs = some.select(*keys), None
        for i, (f, t) in enumerate(zip(fes, tables)):
            at = at.join(t.select(*f, F.col("part").alias(f"__p{i}"), F.col("idx").alias(f"__i{i}")).hint("shuffle_hash"), f)     # the rows are not sorted
        for i in range(len(fes)):
            for j in range(i + 1, len(fes)):
                x = at.select(F.col(f"__p{i}").alias("a"), F.col(f"__p{j}").alias("b"), F.col(f"__i{i}").alias("i"), F.col(f"__i{j}").alias("j"))
                pairs = x if pairs is None else pairs.unionByName(x)
        return pairs

    pairs, saved = _by_slices(slices, met)
    ship(spark)
    blocks = pairs.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_pack(units), "back boolean, src int, dst int, at binary, first binary, take binary, c binary")
    packed = Saved(blocks)
    blocks = packed.frame.withColumn("lane", F.pmod("dst", F.lit(LANES)).cast("int"))
    del pairs
    for x in saved:
        x.drop()
    release_unused(spark)
    # a frame that is read from a checkpoint has lost its partitioning, a persisted one keeps it
    forth, back = held = [blocks.filter(F.col("back") == b).drop("back").repartition(4 * base, "src", "lane").persist(StorageLevel.MEMORY_AND_DISK) for b in (False, True)]

    def settled(df: DataFrame) -> DataFrame:
        """Checkpointed; the shuffles of its making go before the next frame is made."""
        out = cut_lineage(df)
        del df
        release_unused(spark)
        return out

    stat = settled(_vectors(unit, {"n": ["n"], "mean": [f"m{k}" for k in range(m)]}))

    def unit_means(values: DataFrame) -> DataFrame:
        """(part, v) of the units: the mean over their rows of the levels' values (part, v)."""
        sums = _gather(_spread(forth.filter(F.col("dst") < units), values, m), sizes, m)
        return _map_rows(sums.join(stat.select("part", "n"), "part"), lambda r: (r["part"], (_vec(r["v"], m) / _vec(r["n"], 1)).tobytes()), "part int, v binary")

    def to_levels(means: DataFrame, values: DataFrame | None) -> DataFrame:
        """(part, v) of the levels: what other small FEs add (of ``values``) less the sums over the rows of the units' means."""
        minus = _map_rows(means, lambda r: (r["part"], (-_vec(r["v"], m)).tobytes()), "part int, v binary")
        sums = _spread(back, minus, m)
        if values is not None and len(small) > 1:
            sums = sums.unionByName(_spread(forth.filter(F.col("dst") >= units), values, m))
        return _gather(sums, sizes, m)

    def times_a(vectors: DataFrame, name: str) -> DataFrame:
        """``vectors`` with the binary column a: A times the column ``name``."""
        values = vectors.select("part", F.col(name).alias("v"))
        rest = to_levels(unit_means(values), values).select("part", F.col("v").alias("rest"))
        names = [c for c in vectors.columns if c != "a"]
        one = lambda r: (*[r[c] for c in names], (_vec(r["n"], 1) * _vec(r[name], m) + _vec(r["rest"], m)).tobytes())
        return _map_rows(vectors.join(rest, "part"), one, ", ".join(f"{c} {'int' if c == 'part' else 'binary'}" for c in [*names, "a"]))

    def dots(vectors: DataFrame, *pairs_) -> np.ndarray:
        """Sums over all levels of products of columns: rows of one number per column; one small row a part reaches the driver."""
        def one(r):
            v = {c: _vec(x, 1 if c in ("n", "inv") else m) for c, x in r.items() if c != "part"}
            return (np.array([p(v).sum(0) for p in pairs_]).ravel().tolist(),)

        got = [r["x"] for r in _map_rows(vectors, one, "x array<double>").collect()]
        return np.sum(got, axis=0).reshape(len(pairs_), m) if got else np.zeros((len(pairs_), m))

    # right-hand sides (a missing value adds nothing) and diag(A), the preconditioner
    levels_ = None
    for t, f in zip(few, small):
        levels_ = t.drop(*f) if levels_ is None else levels_.unionByName(t.drop(*f))
    missing = unit.agg(*[F.sum(f"z{k}") for k in range(m)]).first()
    if any(missing):
        levels_ = None
        means = unit.select(*ucols, *[F.col(f"m{k}").alias(f"__m{k}") for k in range(m)])
        for t, f in zip(few, small):
            b = whole.join(means, ucols).groupBy(*f).agg(*[F.sum(F.col(c) - F.col(f"__m{k}")).alias(f"b{k}") for k, c in enumerate(cols)])
            x = t.drop(*[f"b{k}" for k in range(m)]).join(b, f).drop(*f)
            levels_ = x if levels_ is None else levels_.unionByName(x)
    levels_ = levels_.withColumns({f"b{k}": F.coalesce(f"b{k}", F.lit(0.0)) for k in range(m)})
    start = settled(_vectors(levels_, {"n": ["n"], "b": [f"b{k}" for k in range(m)]}))
    means = stat.select("part", F.col("mean").alias("v"))
    less = settled(to_levels(means, None).select("part", F.col("v").alias("less")))
    inner = _map_rows(stat, lambda r: (r["part"], (1 / _vec(r["n"], 1)).tobytes()), "part int, v binary")
    diag = settled(_gather(_spread(back, inner, 1, power=2), sizes, 1).select("part", F.col("v").alias("diag")))

    def first(r):
        n, b = _vec(r["n"], 1), _vec(r["b"], m)
        if not any(missing):
            b = b + _vec(r["less"], m)
        diag = n - _vec(r["diag"], 1)
        inv = np.where(diag > 1e-12 * n, 1.0 / np.where(diag == 0, 1.0, diag), 0.0)
        return r["part"], n.tobytes(), inv.tobytes(), b.tobytes(), np.zeros_like(b).tobytes(), b.tobytes(), (inv * b).tobytes()

    begun = settled(_map_rows(start.join(less, "part").join(diag, "part"), first, "part int, n binary, inv binary, b binary, x binary, r binary, p binary"))
    rz, bb = dots(begun, lambda v: v["r"] * v["inv"] * v["r"], lambda v: v["b"] * v["b"])
    state = steps(rz, np.sqrt(bb))
    schema = "part int, n binary, inv binary, x binary, r binary, p binary"
    now, here = begun.drop("b"), None

    def moved(step, beta):
        def one(r):
            p, a, inv = _vec(r["p"], m), _vec(r["a"], m), _vec(r["inv"], 1)
            x, left = _vec(r["x"], m) + step * p, _vec(r["r"], m) - step * a
            if beta is not None:
                p = np.where(state_done, 0.0, inv * left + beta * p)
            return r["part"], r["n"], r["inv"], x.tobytes(), left.tobytes(), p.tobytes()

        state_done = state.done.copy()
        return one

    while state.going():
        here = settled(times_a(now, "p"))
        (pap,) = dots(here, lambda v: v["p"] * v["a"])
        step = state.step(pap)
        rz, rr = dots(_map_rows(here, moved(step, None), schema), lambda v: v["r"] * v["inv"] * v["r"], lambda v: v["r"] * v["r"])
        beta = state.beta(rz, np.sqrt(rr))
        now = _map_rows(here, moved(step, beta), schema)
    final = settled(times_a(now.select("part", "n", "x").join(begun.select("part", "b"), "part"), "x"))
    (rr,) = dots(final, lambda v: (v["b"] - v["a"]) ** 2)
    state.verify(np.sqrt(rr))

    # v - alpha of the row's levels - (mean of v less mean of alpha) of its unit
    alpha = final.select("part", F.col("x").alias("v"))
    means = settled(unit_means(alpha))
    if len(slices) > 1:         # the slices need the room
        while held:
            held.pop().unpersist(blocking=True)
        del forth, back
    del blocks, here, now, begun, start, less, diag
    packed.drop()
    release_unused(spark)
    shift = _unpack(means, m, "__u").join(unit, ["part", "idx"]).select(*ucols, *[(F.col(f"m{k}") - F.col(f"__u{k}")).alias(f"__g{k}") for k in range(m)])
    loose = _unpack(alpha, m, "__v")
    alphas = [loose.join(t.select(*f, "part", "idx"), ["part", "idx"]).select(*f, *[F.col(f"__v{k}").alias(f"__a{k}") for k in range(m)]) for t, f in zip(few, small)]
    shared = []
    if len(slices) > 1:         # every slice reads them
        shared = [Saved(x) for x in (shift, *alphas)]
        shift, *alphas = [x.frame for x in shared]
    keep = [c for c in d.columns if c not in cols]

    def residuals(some: DataFrame) -> DataFrame:
        for a, f in zip(alphas, small):
            # subtracted here, a row goes into the next join with one number a column
            some = some.join(a.hint("shuffle_hash"), f).select(*keep, *[(F.col(c) - F.col(f"__a{k}")).alias(c) for k, c in enumerate(cols)])
        return some.join(shift.hint("shuffle_hash"), ucols).select(*keep, *[(F.col(c) - F.col(f"__g{k}")).alias(c) for k, c in enumerate(cols)])

    out, _ = _by_slices(slices, residuals, use_up=True)
    for x in shared:
        x.drop()
    return out, state.n, held
