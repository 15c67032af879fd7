"""Missing-value rules of the panel scripts.

Stata treats a missing number as larger than every number, so ``x > c`` is
true for a missing ``x``.  ``missing="stata"`` reproduces that; ``"null"``
keeps SQL three-valued logic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gt(a: Column, b: Column, missing: str = "stata") -> Column:
    """``a > b`` with missing-as-large semantics (a missing b compares false)."""
    if missing == "null":
        return a > b
    return F.when(b.isNull(), F.lit(False)).otherwise(F.coalesce(a > b, F.lit(True)))


def ge(a: Column, b: Column, missing: str = "stata") -> Column:
    if missing == "null":
        return a >= b
    return F.when(b.isNull(), a.isNull()).otherwise(F.coalesce(a >= b, F.lit(True)))


def lt(a: Column, b: Column, missing: str = "stata") -> Column:
    """``a < b``: false for missing a (missing is large), true for missing b."""
    if missing == "null":
        return a < b
    return F.when(b.isNull(), a.isNotNull()).otherwise(F.coalesce(a < b, F.lit(False)))


def eq(a: Column, b: Column) -> Column:
    """``a == b`` is false when either side is missing (except both missing)."""
    return a.eqNullSafe(b)


def inrange(x: Column, lo, hi) -> Column:
    """``inrange(x, lo, hi)``: inclusive; 0 for missing x and finite bounds."""
    return F.coalesce(x.between(lo, hi), F.lit(False))


def cond(c: Column, yes: Column, no: Column | None = None) -> Column:
    """``cond(c, yes, .)``: value when c holds, missing otherwise."""
    return F.when(c, yes) if no is None else F.when(c, yes).otherwise(no)


def flag(c: Column) -> Column:
    """Boolean condition -> 0/1 int, never NULL."""
    return F.coalesce(c.cast("int"), F.lit(0))
