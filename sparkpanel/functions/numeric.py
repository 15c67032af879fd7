"""Element-wise scoring helpers and strict casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(arr: Column) -> Column:
    """1 / (1 + e^-x) for every element."""
    return F.transform(arr, lambda x: 1.0 / (1.0 + F.exp(-x.cast("double"))))


def binarize(arr: Column, threshold: float = 0.5) -> Column:
    """1 when strictly greater than the threshold."""
    return F.transform(arr, lambda p: (p > F.lit(threshold)).cast("int"))


def strict_cast(col: Column, dtype: str, name: str = "value") -> Column:
    """ANSI cast (bad text fails the job) that also rejects NULL."""
    return F.when(col.isNull(), F.raise_error(F.lit(f"{name}: NULL where a {dtype} is required"))) \
        .otherwise(col.cast(dtype))


def log_level(col: Column, plus: int = 0) -> Column:
    """ln(x) or ln(1 + x)."""
    return F.ln(col) if plus == 0 else F.log1p(col)


def fmt(col: Column, dec: int) -> Column:
    """fixed number of decimals."""
    return F.format_string(f"%.{dec}f", col)


def percent(col: Column, dec: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{dec}f", col * 100), F.lit("%"))
