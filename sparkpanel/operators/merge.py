"""Checked merges.

``merge`` mirrors a 1:1 / m:1 / 1:m merge with provenance: null-safe keys,
uniqueness asserted on the side(s) that must be unique, the left value wins on
shared non-key columns for matched rows, and ``_merge`` = 1 (left only),
2 (right only), 3 (both).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    pass


def assert_unique(df: DataFrame, keys: list[str], side: str = "data", examples: int = 5) -> None:
    """Raise if ``keys`` do not identify rows; shows a few offending keys."""
    dup = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
           .limit(examples).collect())
    if dup:
        shown = ", ".join(str(tuple(r[k] for k in keys)) + f" x{r['n']}" for r in dup)
        raise DuplicateKeyError(f"keys {keys} are not unique in {side}: {shown}")


def _unique_rows(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """J3 without a pass of its own: ``df`` whose rows raise as soon as a key has a second one.

    The count per key shares the join's partitioning by the keys, so the check
    costs no further shuffle.
    """
    w = Window.partitionBy(*keys)
    shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    message = F.concat(F.lit(f"keys {keys} are not unique in {side}: ("), shown, F.lit(")"))
    once = F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("__n", F.count(F.lit(1)).over(w)).filter(once).drop("__n")


def merge(left: DataFrame, right: DataFrame, keys: list[str], kind: str = "1:1",
          keep: str | None = None, check: bool | str = True) -> DataFrame:
    """J1 / J2.  ``keep``: None (all rows, with ``_merge``) or "match" (inner, no ``_merge``).

    A key that occurs twice on a side that must be unique is an error.  ``check``
    True looks at once, in a pass over that side; "join" looks within the join's
    own shuffle, and the job stops when the result is computed.
    """
    unique = (["right"] if kind in ("1:1", "m:1") else []) + (["left"] if kind in ("1:1", "1:m") else [])
    if check == "join":
        right = _unique_rows(right, keys, "right") if "right" in unique else right
        left = _unique_rows(left, keys, "left") if "left" in unique else left
    elif check:
        for side in unique:
            assert_unique(left if side == "left" else right, keys, side)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    if keep == "match":
        r = right.select(*keys, *[c for c in right.columns if c not in keys and c not in shared])
        cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[k]) for k in keys])
        out = left.join(r, cond, "inner")
        return out.select(*[left[k] for k in keys], *[left[c] for c in left.columns if c not in keys],
                          *[r[c] for c in r.columns if c not in keys])
    lt = left.select(*[F.col(c).alias(f"__l_{c}") for c in left.columns], F.lit(True).alias("__lf"))
    rt = right.select(*[F.col(c).alias(f"__r_{c}") for c in right.columns], F.lit(True).alias("__rf"))
    cond = reduce(lambda a, b: a & b, [F.col(f"__l_{k}").eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    j = lt.join(rt, cond, "full_outer")
    from_left = F.col("__lf").isNotNull()
    from_right = F.col("__rf").isNotNull()

    def pick(c: str) -> Column:
        return F.when(from_left, F.col(f"__l_{c}")).otherwise(F.col(f"__r_{c}")).alias(c)

    cols = [pick(k) for k in keys]
    cols += [pick(c) if c in shared else F.col(f"__l_{c}").alias(c) for c in left.columns if c not in keys]
    cols += [F.col(f"__r_{c}").alias(c) for c in right.columns if c not in keys and c not in shared]
    merge_flag = (F.when(from_left & from_right, F.lit(3)).when(from_left, F.lit(1)).otherwise(F.lit(2))
                  .cast("int").alias("_merge"))
    return j.select(*cols, merge_flag)


def with_group_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Attach group statistics (``bysort key: egen``) to every row.

    Aggregated with a map-side combine and joined back, rather than a window,
    so a hot key is not sorted inside one task; AQE broadcasts the per-group
    table when it is small and splits a skewed partition otherwise.
    """
    g = df.groupBy(*keys).agg(*[e.alias(n) for n, e in stats.items()])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(g[k]) for k in keys])
    return df.join(g, cond, "left").select(df["*"], *[g[n] for n in stats])
