"""Global order statistics without a single-task window.

``global_rank`` range-partitions and sorts the data, checkpoints it so the
partition layout is stable, counts rows per partition (a tiny table), turns
the counts into running offsets and adds the position inside the partition.
The position comes from ``monotonically_increasing_id``, whose low 33 bits are
the row's index inside its partition.  All of it stays in the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkpanel.session import cut_lineage, ship

_LOW33 = (1 << 33) - 1


def _order_exprs(order_cols) -> list[Column]:
    out = []
    for c in order_cols:
        col = F.col(c) if isinstance(c, str) else c
        out.append(col.asc_nulls_last() if isinstance(c, str) else col)
    return out


def global_rank(df: DataFrame, order_cols, name: str = "_n", total: str | None = "n_total",
                num_partitions: int | None = None) -> DataFrame:
    """1-based row number in ``order_cols`` order (missing last), plus the total.

    (Stata's ``_N`` is called ``n_total``: Spark resolves names case-insensitively.)
    """
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a hash of the whole row breaks ties, so that the order is the same in every run; rows that
    # are equal altogether are exchangeable and are spread by their place in the input, so that
    # a value that a third of the rows share still goes to many tasks
    order = _order_exprs(order_cols) + [F.col("__tb"), F.col("__at")]
    s = (df.withColumns({"__tb": F.xxhash64(*df.columns), "__at": F.monotonically_increasing_id()})
         .repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
         .drop("__tb", "__at")
         .withColumn("__mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    s = s.withColumn("__pid", F.shiftright(F.col("__mid"), 33))
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("__pid", (F.sum("__cnt").over(w) - F.col("__cnt")).alias("__off"),
                            F.sum("__cnt").over(Window.partitionBy()).alias("__tot"))
    out = s.join(F.broadcast(offsets), "__pid")
    cols = [c for c in df.columns]
    res = out.select(*cols, (F.col("__off") + F.col("__mid").bitwiseAND(F.lit(_LOW33)) + 1).alias(name),
                     F.col("__tot").alias(total or "__tot"))
    return res if total else res.drop("__tot")


def quantile_bucket(df: DataFrame, order_cols, k: int = 4, name: str = "group") -> DataFrame:
    """``ceil(k * _n / _N)`` after an ascending sort (missing last).  Not ntile."""
    r = global_rank(df, order_cols, "__rk", "__cnt_all")
    return r.withColumn(name, F.ceil(F.lit(k) * F.col("__rk") / F.col("__cnt_all")).cast("int")).drop("__rk", "__cnt_all")


def group_id(df: DataFrame, keys: list[str], name: str = "group_id") -> DataFrame:
    """Dense id 1..G in sorted key order; NULL when any key is NULL."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    levels = df.filter(complete).select(*keys).distinct()
    ranked = global_rank(levels, keys, name, None)
    return df.join(ranked, keys, "left").select(*df.columns, F.col(name).cast("long").alias(name))


def global_cumsum(df: DataFrame, order_cols, value: str, name: str = "cumsum",
                  num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` in ``order_cols`` order without a single-task window:
    range partitions, per-partition totals (one row each) turned into offsets,
    and a window inside each partition."""
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _order_exprs(order_cols)
    s = (df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
         .withColumn("__pid", F.spark_partition_id()))
    s = cut_lineage(s)
    tots = s.groupBy("__pid").agg(F.sum(value).alias("__t"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = tots.select("__pid", (F.sum("__t").over(w) - F.col("__t")).alias("__off"))
    inner = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (s.join(F.broadcast(offsets), "__pid")
            .withColumn(name, F.col("__off") + F.sum(value).over(inner))
            .drop("__pid", "__off"))


def tabulate(df: DataFrame, col: str) -> DataFrame:
    """Frequency, percent and cumulative percent of a categorical column."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("freq"))
    total = counts.agg(F.sum("freq").alias("t")).first()["t"] or 0
    cum = global_cumsum(counts, [col], "freq", "__cum")
    return cum.select(col, "freq", (100.0 * F.col("freq") / F.lit(total)).alias("percent"),
                      (100.0 * F.col("__cum") / F.lit(total)).alias("cum"))


STATA_PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


#: Bits of a key that one pass counts; values that are few enough to be read as they are.
RADIX, FEW = 18, 50_000


def _keys(x: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of the doubles; NaN is the largest and -0.0 equals 0.0."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits >= top, ~bits, bits | top)


def _value(key: int) -> float:
    bits = np.array([key], np.uint64)
    top = np.uint64(1 << 63)
    return float(np.where(bits >= top, bits & ~top, ~bits).astype(np.uint64).view(np.float64)[0])


def order_statistics(df: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """The values of the given 1-based ranks among the non-null values of ``col``, by radix selection.

    Each pass counts the values by the next ``RADIX`` bits of their keys, within the bins that still hold a wanted rank; a
    task sends one row a bin.  Nothing is sorted, shuffled by value or written.  Once the wanted bins hold at most ``FEW``
    values, these are read; a value that many rows share ends up alone in its bin after 64 bits.
    """
    ship(df.sparkSession)
    values = df.select(F.col(col).cast("double").alias("v")).filter("v is not null")
    wanted = {0: (sorted(set(ranks)), 0)}           # prefix: ranks within the bin, and how many values the bin holds
    out: dict[int, float] = {}
    depth = 0

    def inside(x, prefixes, bits):
        key = _keys(x)
        keep = np.isin(key >> np.uint64(64 - bits), np.array(prefixes, np.uint64)) if bits else np.ones(len(key), bool)
        return x[keep], key[keep]

    def counted(prefixes, bits, to):
        def read(batches):
            total: dict[int, int] = {}
            for batch in batches:
                _, key = inside(batch.column("v").to_numpy(), prefixes, bits)
                u, n = np.unique(key >> np.uint64(64 - to), return_counts=True)
                for k, c in zip(u.tolist(), n.tolist()):
                    total[k] = total.get(k, 0) + c
            k = np.array(list(total), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(list(total.values()), pa.int64())], names=["k", "n"])
        return read

    def chosen(prefixes, bits):
        def read(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(inside(batch.column("v").to_numpy(), prefixes, bits)[0])], names=["v"])
        return read

    back = {r: r for r in wanted[0][0]}             # rank within the bin: the ranks asked for
    names = {0: back}
    while names:
        prefixes = list(names)
        if depth and sum(size for p, (_, size) in wanted.items()) <= FEW:
            found = np.sort(values.mapInArrow(chosen(prefixes, depth), "v double").toPandas()["v"].to_numpy())
            key = _keys(found) >> np.uint64(64 - depth)
            for p in prefixes:
                mine = found[key == np.uint64(p)]
                out.update({asked: float(mine[r - 1]) for r, asked in names[p].items()})
            return out
        to = min(64, depth + RADIX)
        rows = values.mapInArrow(counted(prefixes, depth, to), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
        counts = sorted((int(np.int64(r["k"]).view(np.uint64)), r["n"]) for r in rows.collect())      # 2^RADIX rows a prefix at most
        after, sizes = {}, {}
        seen = dict.fromkeys(prefixes, 0)
        for k, n in counts:
            p = k >> (to - depth) if depth else 0
            for r, asked in names[p].items():
                if seen[p] < r <= seen[p] + n:
                    after.setdefault(k, {})[r - seen[p]] = asked
                    sizes[k] = n
            seen[p] += n
        if to == 64:
            out.update({asked: _value(k) for k, ask in after.items() for asked in ask.values()})
            return out
        names, wanted, depth = after, {k: (list(after[k]), sizes[k]) for k in after}, to
    return out


def summarize_detail(df: DataFrame, col: str, percentiles=STATA_PERCENTILES) -> DataFrame:
    """A3: ``summarize, detail`` as one row.

    Moments come from one aggregate; percentiles use the summarize rule (when
    N*p/100 is whole the mean of that and the next order statistic, else the
    next one) on order statistics found by radix selection.
    """
    d = df.select(F.col(col).alias("__v")).filter(F.col("__v").isNotNull())
    mom = d.agg(F.count(F.lit(1)).alias("N"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("sd"),
                F.var_samp("__v").alias("variance"), F.skewness("__v").alias("skewness"),
                (F.kurtosis("__v") + 3.0).alias("kurtosis"), F.min("__v").alias("min"),
                F.max("__v").alias("max"), F.sum("__v").alias("sum"))
    n = d.count()
    # position np/100 as an exact rational: whole when (N * p) % 100 == 0
    pairs = {p: (n * p // 100, n * p // 100 + 1) if n * p % 100 == 0 else (n * p // 100 + 1,) * 2 for p in percentiles}
    fit = lambda r: min(max(r, 1), n)
    found = order_statistics(d, "__v", [fit(r) for pair in pairs.values() for r in pair]) if n else {}
    value = {p: (found[fit(a)] + found[fit(b)]) / 2.0 if n else None for p, (a, b) in pairs.items()}
    return mom.select("*", *[F.lit(v).cast("double").alias(f"p{p}") for p, v in value.items()])
