"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 5).

1. Targets.  Sources in code point order (null last) have weights that repeat;
   they share ``share`` times all words.  No target exceeds ``most`` times its
   source: what is above is shared out again by weight, until nothing is.
2. Blocks.  A document's block is a seeded hash modulo the number of blocks of
   its source, so blocks are disjoint and their order is a random permutation.
   A source has a block for about ``BLOCK_WORDS`` words, but not fewer than
   four a document (at most 1,024 of those) and not more than ``MAX_BLOCKS``.
3. Quotas.  Per source, blocks are taken in permuted order, once around and then
   a second time, until its target is met; a block that would overshoot is
   passed over.  A few exchanges of single blocks then close what is left.
   A group is one source's block table, at most ``MAX_BLOCKS`` rows.
4. Splitting tree.  All taken blocks are dealt over the output shards.  A node
   holds the exact count of blocks of every source in a range of shards; its left
   half draws its counts from the multivariate hypergeometric distribution, the
   right half keeps the rest.  Each node is seeded by its place, so any task can
   walk from the root to its own shards; no counts are lost and reruns agree.
   A source's blocks go to the shards in permuted order, in disjoint ranges.
5. Shards are shuffled locally by a seeded hash of document and copy.

Defined results: a null text has size 0; null is a source of its own; a source
without words has target 0; with no words at all nothing is taken; repeated rows
are documents of their own (in the same block); an empty table gives no rows;
further columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.llm.common import table, words_col, written
from sparkpanel.operators.ranks import global_rank

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK_WORDS, MAX_BLOCKS = 1_000_000, 1 << 16
SHARD_WORDS, MIN_SHARDS = 5_000_000, 8
SWAPS = 8      # single exchanges of blocks that bring a source nearer to its target
SEED = 20240607


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row a source: source, number (from 0), source_size, n_docs, weight, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = global_rank(per, ["source"], "number", None).withColumn("number", F.col("number") - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    rows = written(ranked.withColumn("weight", weight))
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:     # each round stops one more source at least, or ends
        above = F.col("weight") * level > most * F.col("source_size")
        n, full, free = rows.agg(F.count_if(above), F.sum(F.when(above, most * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - float(full or 0)) / float(free)
    return rows.withColumn("target", F.least(F.col("weight") * level, most * F.col("source_size").cast("double")))


def with_blocks(targets: DataFrame) -> DataFrame:
    fine = F.least(4 * F.col("n_docs"), F.lit(1024))
    blocks = F.least(F.greatest(fine, F.ceil(F.col("source_size") / BLOCK_WORDS)), F.lit(MAX_BLOCKS))
    return targets.withColumn("blocks", blocks.cast("int"))


def block_of(doc_key: Column, blocks: Column, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), doc_key), blocks).cast("int")


def draw(words: np.ndarray, target: float, order: np.ndarray, passes: int) -> np.ndarray:
    """Places in ``order`` repeated ``passes`` times that are taken, rising; their words come near the target."""
    seq = np.tile(words[order], passes)
    done = np.append(0, np.cumsum(seq))
    taken, at, rest = [], 0, target
    while at < len(seq):
        stop = int(np.searchsorted(done, done[at] + rest, side="right")) - 1
        taken.append(np.arange(at, stop))
        rest -= done[stop] - done[at]
        at = stop + 1                      # this one would overshoot
    chosen = np.zeros(len(seq), bool)
    for part in taken:
        chosen[part] = True
    for _ in range(SWAPS):
        rest = target - seq[chosen].sum()
        ins, outs = np.flatnonzero(~chosen), np.flatnonzero(chosen)
        # nothing leaves or enters, or the best pair: for each that enters, the one whose leaving fits best
        ins, outs = np.append(ins, -1), np.append(outs, -1)
        size_in, size_out = np.append(seq[ins[:-1]], 0.0), np.append(seq[outs[:-1]], 0.0)
        order_out = np.argsort(size_out, kind="stable")
        at = np.searchsorted(size_out[order_out], size_in - rest)
        best = (abs(rest), -1, -1)
        for near in (np.maximum(at - 1, 0), np.minimum(at, len(outs) - 1)):
            gap = np.abs(rest - size_in + size_out[order_out[near]])
            i = int(gap.argmin())
            best = min(best, (float(gap[i]), int(ins[i]), int(outs[order_out[near[i]]])))
        if best[0] >= abs(rest):
            break
        if best[1] >= 0:
            chosen[best[1]] = True
        if best[2] >= 0:
            chosen[best[2]] = False
    return np.flatnonzero(chosen)


def draw_blocks(blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """number, block, place: the taken blocks of each source, numbered from 0 in permuted order (a block at most twice)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        words, target = pdf["words"].to_numpy(float), float(pdf["target"].iloc[0])
        number = int(pdf["number"].iloc[0])
        order = np.random.default_rng([seed, number]).permutation(len(pdf))
        passes = 0 if words.sum() <= 0 else int(min(MOST, np.ceil(target / words.sum())))
        got = draw(words, target, order, passes) if passes else np.zeros(0, int)
        return pd.DataFrame({"number": number, "block": pdf["block"].to_numpy()[order[got % max(1, len(order))]], "place": np.arange(len(got))})

    return blocks.groupBy("number").applyInPandas(one, "number long, block int, place long")


def walk(quotas: np.ndarray, shards: int, lo: int, hi: int, seed: int = SEED):
    """Yield (shard, first place, count) arrays by source for the shards lo to hi - 1."""
    total = int(quotas.sum())
    upto = lambda k: total * k // shards
    stack = [(0, shards, np.zeros_like(quotas), quotas)]
    while stack:
        a, b, start, counts = stack.pop()
        if b <= lo or a >= hi:
            continue
        if b - a == 1:
            yield a, start, counts
            continue
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        left = rng.multivariate_hypergeometric(counts, upto(mid) - upto(a), method="marginals") if counts.sum() else counts
        stack += [(mid, b, start + left, counts - left), (a, mid, start, left)]


def deal(spark: SparkSession, quotas: dict[int, int], shards: int, seed: int = SEED) -> DataFrame:
    """number, place, shard of every taken block.  ``quotas`` has one count a source."""
    numbers = np.array(sorted(quotas), np.int64)
    counts = np.array([quotas[i] for i in numbers.tolist()], np.int64)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                for shard, start, n in walk(counts, shards, int(pdf["id"].min()), int(pdf["id"].max()) + 1, seed):
                    yield pd.DataFrame({"number": numbers, "shard": shard, "start": start, "n": n})

    ranges = spark.range(shards).mapInPandas(run, "number long, shard int, start long, n long").filter("n > 0")
    return ranges.select("number", "shard", F.explode(F.expr("sequence(start, start + n - 1)")).alias("place"))


def doc_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col], docs[text_col].cast("string"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, shards: int | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sources with their targets and blocks, taken blocks: number, block, shards).  Reads the texts once."""
    sized = written(docs.select(docs[source_col].cast("string").alias("source"), F.size(words_col(docs[text_col].cast("string"))).cast("long").alias("size"),
                                doc_key(docs, id_col, text_col).alias("key")))
    targets = written(with_blocks(source_targets(sized, weights, share, most)))
    t = targets.select(F.col("source").alias("s"), "number", "blocks", "target")
    numbered = sized.join(t, sized["source"].eqNullSafe(t["s"]))
    blocks = numbered.groupBy("number", block_of(F.col("key"), F.col("blocks"), seed).alias("block")).agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    taken = written(draw_blocks(blocks, seed))
    quotas = {r["number"]: r["count"] for r in taken.groupBy("number").count().collect()}      # one row a source
    if shards is None:
        words = targets.agg(F.sum("target")).first()[0] or 0
        shards = max(MIN_SHARDS, -(-int(words) // SHARD_WORDS))
    dealt = taken.join(deal(docs.sparkSession, quotas, shards, seed), ["number", "place"]) if quotas else taken.withColumn("shard", F.lit(0))
    # written, so that its size is known: where it is small no text is shuffled to meet it
    return targets, written(dealt.groupBy("number", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, shards: int | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, taken (words) and shards (one entry a copy that the mix takes, at most two)."""
    targets, taken = plan(docs, weights, share, most, seed, shards, id_col, text_col, source_col)
    rows = docs.drop("size", "source_size", "target", "taken", "shards")
    size = F.size(words_col(rows[text_col].cast("string"))).cast("long")
    rows = rows.withColumns({"size": size, "__key": doc_key(rows, id_col, text_col)})
    t = targets.select(F.col("source").alias("__source"), F.col("number").alias("__number"), F.col("blocks").alias("__blocks"), "source_size", "target")
    rows = rows.join(t, rows[source_col].cast("string").eqNullSafe(t["__source"])).withColumn("__block", block_of(F.col("__key"), F.col("__blocks"), seed))
    b = taken.select(F.col("number").alias("__n"), F.col("block").alias("__b"), "shards")
    rows = rows.join(b, (F.col("__number") == F.col("__n")) & (F.col("__block") == F.col("__b")), "left")
    rows = rows.withColumn("shards", F.coalesce("shards", F.array().cast("array<int>"))).withColumn("taken", F.col("size") * F.size("shards"))
    return rows.drop("__key", "__source", "__number", "__blocks", "__block", "__n", "__b")


def copies(mixed: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """A row for each copy, with ``shard`` and ``place``, the key of the local shuffle."""
    rows = mixed.select("*", F.posexplode("shards").alias("copy", "shard"))
    return rows.withColumn("place", F.xxhash64(F.lit(seed), F.col(id_col), "copy", "shard")).drop("shards", "copy")


def write_shards(mixed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The mix as one folder a shard, each shuffled by its own key."""
    copies(mixed, id_col).repartition("shard").sortWithinPartitions("shard", "place").drop("place").write.mode("overwrite").partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")
