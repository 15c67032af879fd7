"""Shared helpers: tables, Arrow text buffers, vectorised word splitting and hashing.

The numpy helpers work on one bounded slice of texts at a time, inside Spark tasks.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import lru_cache
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the five controls 0x09-0x0D.
SEPARATORS = b" \t\n\x0b\x0c\r"
#: The same, as a Java regular expression of one separator.
SEP_RE = r"[\x20\x09-\x0D]"
#: Bytes of text handled at once inside a task.
SLICE_BYTES = 2 << 20

_names = count()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of an application, unless they find it by PYTHONPATH or working folder."""
    package = Path(__file__).resolve().parent.parent
    places = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    if spark.sparkContext.applicationId in _shipped or any(Path(p, package.name).is_dir() for p in places):
        return
    zipped = Path(tempfile.mkdtemp(prefix="sparkpanel-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(zipped, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(zipped))
    _shipped.add(spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder.

    Rows survive the loss of any executor and no earlier stage runs twice.
    """
    from sparkpanel.session import checkpoint_dir

    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{app}-{next(_names)}.parquet"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def largest(df: DataFrame, count_col: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of largest count (a positive whole number), ties by the given columns.

    Rows are counted by powers of two first, and only those from the power that
    holds the n-th row on are sorted, so that tasks do not each send n rows.
    """
    power = F.floor(F.log2(F.col(count_col).cast("double"))).cast("int")
    bins = sorted(((r["b"], r["count"]) for r in df.groupBy(power.alias("b")).count().collect()), reverse=True)     # 64 rows at most
    least, seen = 0, 0
    for b, k in bins:
        least, seen = b, seen + k
        if seen >= n:
            break
    return df.filter(power >= least).orderBy(F.desc(count_col), *ties).limit(n)


def words_col(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null: empty."""
    parts = F.split(F.coalesce(text, F.lit("")), SEP_RE + "+")
    return F.filter(parts, lambda w: w != "")


def text_slices(arr: pa.Array, max_bytes: int = SLICE_BYTES):
    """Yield (start, stop) row ranges whose texts hold about ``max_bytes`` bytes (one row at least)."""
    size = np.asarray(pc.fill_null(pc.binary_length(arr), 0)).astype(np.int64)
    done = np.cumsum(size)
    start, n = 0, len(size)
    while start < n:
        base = done[start] - size[start]
        stop = max(start + 1, int(np.searchsorted(done, base + max_bytes, side="right")))
        yield start, stop
        start = stop


def text_bytes(arr: pa.Array, end: str = "") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by ``end``, and n + 1 offsets.  Null is empty."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if end:
        arr = pc.binary_join_element_wise(arr, pa.scalar(end, pa.large_string()), pa.scalar("", pa.large_string()))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64, len(arr) + 1, arr.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[off[0]:off[-1]], off - off[0]


@lru_cache(1)
def _byte_values() -> np.ndarray:
    """Odd 64-bit value of each byte (from a fixed seed); A-Z have those of a-z, separators 0."""
    v = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    exact = v.copy()
    v[65:91] = v[97:123]
    for x in (v, exact):
        x[list(SEPARATORS)] = 0
    return np.stack([exact, v])


_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(arr: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
    """64-bit hash of every word, the n + 1 word offsets of the texts, and (data, starts, ends).

    ``lower`` folds A-Z to a-z first.  A word's hash depends on its bytes alone.
    """
    data, off = text_bytes(arr, " ")
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), (data, off[:0], off[:0])
    val = _byte_values()[int(lower)][data]
    inside = val != 0
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), (data, starts, ends)
    size = ends - starts
    powers = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
    at = np.flatnonzero(inside)
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    h = np.add.reduceat(val[at] * powers[place], first)
    words_off = np.searchsorted(starts, off)
    return mix(h + size.astype(np.uint64)), words_off, (data, starts, ends)
