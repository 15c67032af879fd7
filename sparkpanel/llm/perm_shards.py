"""Sharding by a permutation-filled lookup table (operator 8).

Every shard has its own order of preference over the slots of a prime-sized
table.  The shards take turns, each claiming the next free slot of its order,
until the table is full; a shard of weight ``w`` gets ``w`` turns a round.  So
slots are shared evenly, and removing a shard moves few other slots.  A row's
shard is the slot its key hashes to.  The table has ``slots`` entries whatever
the data (bounded by the parameter) and goes to the executors as one array
literal: placement is one array access a row, without a shuffle or a join.

Defined results: a null key column is hashed as an absent value, so all-null
keys share one slot; equal keys, hence repeated rows, go to the same shard; an
empty table gives no rows; other columns pass through, and ``slot`` and
``shard`` replace columns of those names.  A key that holds a third of the rows
fills one shard by definition; pass ``spread`` to deal such keys over shards by
further columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.llm.common import table

#: Prime table size of the registered query: over 100 slots a shard, so loads differ by under 1 %.
SLOTS = 10_007
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _preference(name: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's order; slots is prime, so every step visits all of them."""
    d = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(d[:8], "big") % slots, 1 + int.from_bytes(d[8:16], "big") % (slots - 1)


def fill_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """Index of the owning shard for each slot."""
    if not is_prime(slots):
        raise ValueError(f"{slots} is not prime")
    weights = weights or [1] * len(shards)
    if not shards or len(set(shards)) < len(shards) or len(weights) != len(shards) or min(weights) < 0 or not sum(weights):
        raise ValueError("need distinct shards and a weight of 0 or more for each, not all 0")
    if sum(weights) > slots:
        raise ValueError("more turns in a round than slots")
    start, step = zip(*(_preference(s, slots) for s in shards))
    owner, tried, left = np.full(slots, -1, np.int32), [0] * len(shards), slots
    while left:
        for i, turns in enumerate(weights):
            for _ in range(min(turns, left)):
                while owner[at := (start[i] + tried[i] * step[i]) % slots] >= 0:
                    tried[i] += 1
                owner[at] = i
                left -= 1
    return owner


def slot_of(keys: list[Column], slots: int) -> Column:
    """The slot of a key: the first 60 bits of an MD5 over its columns, modulo the table size."""
    parts = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in keys]
    text = parts[0] if len(parts) == 1 else F.concat_ws("\u001f", *parts)
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS,
                  weights: list[int] | None = None, spread: list[str] | None = None) -> DataFrame:
    """``df`` with ``slot`` (from 0) and ``shard`` (index into ``shards``)."""
    owner = F.lit(fill_table(shards, slots, weights).tolist())
    cols = [df[k] for k in [*keys, *(spread or [])]]
    out = df.withColumn("slot", slot_of(cols, slots))
    return out.withColumn("shard", F.get(owner, F.col("slot")).cast("int"))


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, ["doc_id"], shard_names(SHARDS))


def oracle() -> str:
    owner = fill_table(shard_names(SHARDS), SLOTS).tolist()
    return f"""
SELECT doc_id, slot, ({owner})[slot + 1]::INTEGER AS shard
FROM (SELECT doc_id, (('0x' || substr(md5(coalesce('=' || doc_id, '-')), 1, 15))::BIGINT % {SLOTS})::INTEGER AS slot
      FROM documents)
"""
