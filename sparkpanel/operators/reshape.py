"""Pack / unpack label vectors and wide <-> long reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(df: DataFrame, cols: list[str], name: str = "labels") -> DataFrame:
    """Columns -> one array in the given (contractual) order."""
    return df.withColumn(name, F.array(*[F.col(c) for c in cols]))


def unpack(df: DataFrame, arr: str, names: list[str], suffix: str = "") -> DataFrame:
    """Array -> positional columns ``{name}{suffix}``; fails when a length differs."""
    n = len(names)
    checked = F.when(F.size(F.col(arr)) == n, F.col(arr)).otherwise(
        F.raise_error(F.concat(F.lit(f"{arr}: expected {n} elements, got "), F.size(F.col(arr)).cast("string"))))
    return df.withColumns({f"{nm}{suffix}": F.element_at(checked, i + 1) for i, nm in enumerate(names)})


def find_pairs(columns: list[str], left_suffix: str = "_human", right_suffix: str = "_bert") -> list[tuple]:
    """(base, left_col, right_col) for every ``*{left_suffix}`` with a partner.

    Pairs are matched by name (the micro block of the reference pairs by order;
    we use names everywhere and raise when a partner is missing).
    """
    out = []
    for c in columns:
        if c.endswith(left_suffix):
            base = c[: -len(left_suffix)]
            partner = f"{base}{right_suffix}"
            if partner not in columns:
                raise ValueError(f"column {c} has no partner {partner}")
            out.append((base, c, partner))
    return out


def to_long(df: DataFrame, id_cols: list[str], pairs: list[tuple], extra: dict | None = None,
            names=("actual", "predicted")) -> DataFrame:
    """Wide paired columns -> (id..., topic, actual, predicted[, extra...]) in one pass.

    ``extra`` maps a value name to {base: column}, e.g. a probability per topic.
    """
    extra = extra or {}
    structs = []
    for base, a, p in pairs:
        fields = [F.lit(base).alias("topic"), F.col(a).alias(names[0]), F.col(p).alias(names[1])]
        fields += [F.col(cols[base]).alias(k) for k, cols in extra.items()]
        structs.append(F.struct(*fields))
    return (df.select(*id_cols, F.explode(F.array(*structs)).alias("__r"))
            .select(*id_cols, "__r.*"))
