"""Reproducible exact-size samples and splits.

The order key is ``md5(seed || ':' || key)`` - the same text in Spark and in
SQL engines, so results can be checked elsewhere.  ``df.sample`` is Bernoulli
and cannot give an exact count, so it is not used.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3       # hexadecimal digits of the hash by which one pass counts (4,096 ranges)
EDGE = 10_000    # keys that are ranked at most, unless equal hashes are more


def hash_key(key: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _first_n(df: DataFrame, n: int, counts: dict[str, int], key: str, seed: int) -> tuple[F.Column, DataFrame]:
    """(condition of the ranges that belong whole to the first n rows in hash order, the rows still needed).

    ``counts``: rows per range of the first digits.  The range in which the n-th row falls is counted by its next digits,
    and so on until it is small; only its keys are ranked.  Whole ranges are taken by a filter.
    """
    h, done, cut = hash_key(key, seed), 0, ""
    while True:
        for prefix, size in sorted(counts.items()):
            if done + size > n:
                break
            done += size
        else:
            return F.lit(True) if not cut else h < cut, df.limit(0).select(key)
        cut = prefix
        if size <= EDGE or len(cut) >= 30:
            break
        counts = _counts(df.filter(h.startswith(cut)), key, seed, len(cut) + DIGITS)
    edge = df.filter(h.startswith(cut)).select(key, h.alias("__h")).orderBy("__h", key).limit(n - done)
    return h < cut, edge.select(key)


def _counts(df: DataFrame, key: str, seed: int, digits: int = DIGITS) -> dict[str, int]:
    """Rows per range of the hash, by its first digits; a null key belongs to none."""
    b = F.substring(hash_key(key, seed), 1, digits).alias("b")
    return {r["b"]: r["count"] for r in df.groupBy(b).count().collect() if r["b"] is not None}     # 16 ** DIGITS rows


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly ``n`` rows without replacement (``key`` identifies a row); error when n > N."""
    counts = _counts(df, key, seed)
    total = sum(counts.values())
    if n > total:
        raise ValueError(f"cannot take a sample of {n} rows from {total} without replacement")
    whole, edge = _first_n(df, n, counts, key, seed)
    return df.filter(whole).unionByName(df.join(edge, key, "left_semi").select(*df.columns))


def split(df: DataFrame, test: float, seed: int, key: str, name: str = "split") -> DataFrame:
    """The ``ceil(test * N)`` rows with the smallest hash are 'test', the rest 'train'.

    The rows themselves are not moved: only the keys of one hash range are ranked.
    """
    counts = _counts(df, key, seed)
    fr = Fraction(str(test))   # exact ceil(test * N) in integer arithmetic
    n_test = -(-sum(counts.values()) * fr.numerator // fr.denominator)
    whole, edge = _first_n(df, n_test, counts, key, seed)
    marked = df.join(edge.withColumn("__e", F.lit(True)), key, "left")
    return marked.withColumn(name, F.when(whole | F.coalesce("__e", F.lit(False)), F.lit("test")).otherwise(F.lit("train"))).select(*df.columns, name)


def sample_per_topic(df_flags: DataFrame, key: str, topic_cols: list[str], n: int, seed: int) -> DataFrame:
    """``n`` texts per topic among those carrying it; (topic, key) pairs.

    ``row_number() <= n`` lets Spark insert a per-partition group limit before
    the shuffle, so a topic held by a third of the rows ships only n rows per
    partition.
    """
    long = df_flags.unpivot([key], topic_cols, "topic", "flag").filter(F.col("flag") == 1)
    w = Window.partitionBy("topic").orderBy(hash_key(key, seed), F.col(key))
    return long.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).select("topic", key)
