"""Ranked lexical search with bag deduplication (operator 12).

Every item is a query against all documents.  Terms are the maximal runs of
ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.

1. One pass over the whole texts counts each document's terms (``n``) and keeps
   of its bag only the terms that some item has: a sorted vector of (term, tf).
   The same pass gives the corpus totals N and L and the document frequencies,
   summed in the task first.
2. With N and L a document's length norm ``m`` is known.  Documents of equal
   vector and equal m have the same score for every item: they are one class,
   found by hash and told apart by the vectors themselves.  Of a class only the
   smallest ``k`` ids can be returned; they are cut down by salted groups first,
   so that a class of a third of all rows meets no task as a whole.
3. Each class is scored once against the postings of the items, in 64-bit whole
   numbers; a task holds the best ``k`` classes of each item (by score, then by
   their smallest id).
4. The classes that are left are expanded to their members by ascending doc_id,
   and the best ``k`` of an item are ranked.

Items are taken in blocks of about ``BLOCK_TERMS`` terms (dealt by hash), so the
vocabulary and the postings that travel to the tasks are bounded; more items
mean more blocks, each with a pass of its own.

Terms are compared by 64-bit hashes of their bytes.

Defined results: a null or empty text has no terms and is counted nowhere; a
null doc_id comes after all others; every row is a document of its own, so a
repeated row takes a rank of its own; items without an id take no part, those
that repeat an id count once (smallest text); an item without terms, or without
documents, has no rows; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkpanel.llm.common import _BASE, mix, table, text_bytes, text_slices, written

#: Item terms (with repeats) of one block, about.
BLOCK_TERMS = 500_000
#: Groups that a class's members are first cut down in.
SALTS = 32
#: Cells (class, item) and postings that a task scores at once.
CELLS, POSTINGS = 2_000_000, 2_000_000
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _byte_values() -> np.ndarray:
    """Odd 64-bit value of each byte of a term (from a fixed seed); A-Z have those of a-z, all others 0."""
    v = np.random.default_rng(20250311).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    v[65:91] = v[97:123]
    code = np.arange(256)
    inside = (code >= 128) | np.isin(code, [ord(c) for c in string.ascii_letters + string.digits])
    return np.where(inside, v, np.uint64(0))


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every term in order, and the n + 1 term offsets of the texts."""
    data, off = text_bytes(texts, " ")
    val = _byte_values()[data]
    edge = np.diff((val != 0).astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    size = ends - starts
    powers = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
    at = np.flatnonzero(val)
    first = np.cumsum(size) - size
    h = np.add.reduceat(val[at] * powers[np.arange(len(at)) - np.repeat(first, size)], first)
    return mix(h + size.astype(np.uint64)), np.searchsorted(starts, off)


def encode(terms: np.ndarray, tf: np.ndarray) -> bytes:
    """A vector of (term, tf), terms ascending: gaps and counts as bytes where they fit, else as 32 bits."""
    gaps = np.diff(terms, prepend=0)
    narrow = [np.uint8 if x.max(initial=0) < 256 else np.uint32 for x in (gaps, tf)]
    return bytes([(narrow[0] is np.uint8) + 2 * (narrow[1] is np.uint8)]) + gaps.astype(narrow[0]).tobytes() + tf.astype(narrow[1]).tobytes()


def decode(vec: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.dtype(np.uint8 if vec[0] & bit else np.uint32) for bit in (1, 2))
    n = (len(vec) - 1) // (a.itemsize + b.itemsize)
    return np.cumsum(np.frombuffer(vec, a, n, 1).astype(np.int64)), np.frombuffer(vec, b, n, 1 + n * a.itemsize).astype(np.int64)


BAG = "kind int, doc_id long, n long, vec binary"


def bags(vocabulary) -> callable:
    """Reads (doc_id, text); rows: kind 0 a document with its vector, 1 (term, documents), 2 (documents, terms) of the task."""

    def rows(kind: int, ids, n, vec=None) -> pa.RecordBatch:
        size = len(n)
        cols = [pa.array(np.full(size, kind, np.int32)), ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(vec or [None] * size, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["kind", "doc_id", "n", "vec"])

    def read(batches):
        known = vocabulary.value                    # sorted hashes
        df, docs, total = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in text_slices(texts):
                h, off = term_hashes(texts[a:b])
                n = np.diff(off)
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
                if not len(known) or not len(h):
                    continue
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                doc = np.searchsorted(off, hit, side="right") - 1
                cell, tf = np.unique(doc * len(known) + at[hit], return_counts=True)
                doc, term = np.divmod(cell, len(known))
                df += np.bincount(term, minlength=len(known))
                held, first = np.unique(doc, return_index=True)
                vec = [encode(term[s:e], tf[s:e]) for s, e in zip(first, [*first[1:], len(doc)])]
                if len(held):
                    yield rows(0, batch.column("doc_id")[a:b].take(pa.array(held)), n[held], vec)
        at = np.flatnonzero(df)
        yield rows(1, at, df[at])
        yield rows(2, [docs], [total])

    return read


def scores(shared, k: int) -> callable:
    """Reads classes (vec, m, ids); rows (item, score, ids): the task's k best classes of each item."""

    def read(batches):
        weight, start, of_item, times, n_items = shared.value
        floor = np.zeros(n_items, np.int64)         # score of an item's k-th class
        item, score, least = (np.zeros(0, np.int64) for _ in range(3))
        ids = np.zeros(0, object)
        last = (1 << 63) - 1
        for batch in batches:
            vecs, m, members = (batch.column(c).to_pylist() for c in ("vec", "m", "ids"))
            step = max(1, CELLS // max(1, n_items))
            for a in range(0, len(vecs), step):
                parts = [decode(v) for v in vecs[a:a + step]]
                row = np.repeat(np.arange(len(parts)), [len(t) for t, _ in parts])
                term, tf = (np.concatenate(x) for x in zip(*parts))
                norm = np.asarray(m[a:a + step], np.int64)[row]
                value = weight[term] * ((1_000_000_000 * tf) // (1_000 * tf + 8 * norm))
                total = np.zeros((len(parts), n_items), np.int64)
                size = start[term + 1] - start[term]
                upto = np.cumsum(size)
                s = 0
                while s < len(term):                # so many entries that their postings stay bounded
                    e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + POSTINGS, side="right")))
                    rep = np.repeat(np.arange(s, e), size[s:e])
                    at = start[term[rep]] + np.arange(len(rep)) - np.repeat(upto[s:e] - size[s:e] - (upto[s] - size[s]), size[s:e])
                    np.add.at(total, (row[rep], of_item[at]), value[rep] * times[at])
                    s = e
                first = np.array([last if x[0] is None else x[0] for x in members[a:a + step]], np.int64)
                i, j = np.nonzero((total > 0) & (total >= floor))
                own = np.empty(len(parts), object)
                own[:] = members[a:a + step]
                item, score, least, ids = (np.concatenate(x) for x in ((item, j), (score, total[i, j]), (least, first[i]), (ids, own[i])))
                order = np.lexsort((least, -score, item))
                begin = np.searchsorted(item[order], np.arange(n_items + 1))
                place = np.arange(len(order)) - begin[item[order]]
                full = order[place == k - 1]
                floor[item[full]] = score[full]
                order = order[place < k]
                item, score, least, ids = item[order], score[order], least[order], ids[order]
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(list(ids), pa.list_(pa.int64()))], names=["item", "score", "ids"])

    return read


def classes(docs: DataFrame, k: int) -> DataFrame:
    """vec, m, ids: documents of equal vector and m with their smallest k ids, null last."""
    same = ["h", "m", "vec"]
    by_id = [F.col("doc_id").asc_nulls_last()]
    keyed = docs.select(F.xxhash64("vec", "m").alias("h"), "m", "vec", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).alias("salt"))
    few = keyed.withColumn("r", F.row_number().over(Window.partitionBy(*same, "salt").orderBy(*by_id))).filter(F.col("r") <= k)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy(*same).orderBy(*by_id))).filter(F.col("r") <= k)
    members = F.sort_array(F.collect_list(F.struct(F.col("r"), F.col("doc_id"))))
    return few.groupBy(*same).agg(members.alias("x")).select("vec", "m", F.col("x.doc_id").alias("ids"))


def terms_col(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(F.coalesce(lower, F.lit("")), BREAKS), lambda t: t != "")


def search_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """item_id, score, doc_id: the best documents of each item of one block."""
    spark = docs.sparkSession
    word = [t for _, t, _ in items]
    hashes = term_hashes(pa.array(word))[0]
    known, term = np.unique(hashes, return_inverse=True)
    found = written(docs.mapInArrow(bags(spark.sparkContext.broadcast(known)), BAG))
    n, total = found.filter("kind = 2").agg(F.sum("doc_id"), F.sum("n")).first()
    n, total = n or 0, total or 0
    # bounded by the block's vocabulary
    seen = found.filter("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("df")).withColumn(
        "w", F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1)))).collect()
    weight = np.zeros(len(known), np.int64)
    weight[[r["doc_id"] for r in seen]] = [r["w"] for r in seen]
    ids = sorted({i for i, _, _ in items})
    number = {i: at for at, i in enumerate(ids)}
    order = np.argsort(term, kind="stable")
    start = np.searchsorted(term[order], np.arange(len(known) + 1))
    of_item = np.array([number[i] for i, _, _ in items], np.int64)[order]
    times = np.array([c for _, _, c in items], np.int64)[order]
    shared = spark.sparkContext.broadcast((weight, start, of_item, times, len(ids)))
    m = (F.lit(25) + F.expr(f"(75L * n * {n}L) div {max(1, total)}L")).cast("long").alias("m")
    best = classes(found.filter("kind = 0").select("doc_id", "vec", m), k).mapInArrow(scores(shared, k), "item long, score long, ids array<long>")
    names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
    return best.select("item", "score", F.explode("ids").alias("doc_id")).join(F.broadcast(names), "item").drop("item")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text",
         block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of positive score, ties by ascending doc_id."""
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    once = items.select(items[item_id].cast("long").alias("item_id"), items[text].alias("t")).filter("item_id is not null").groupBy("item_id").agg(F.min("t").alias("t"))
    counted = written(once.select("item_id", F.explode(terms_col(F.col("t"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("c")))
    blocks = max(1, -(-counted.count() // block_terms))
    out = spark.createDataFrame([], "score long, doc_id long, item_id long")
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    for b in range(blocks):
        terms = [tuple(r) for r in counted.filter(block == b).collect()]      # about block_terms rows
        if terms:
            out = out.unionByName(search_block(rows, terms, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = ("regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLE = f"""
WITH i AS MATERIALIZED (SELECT item_id, unnest({_TERMS.format('t')}) AS term FROM (SELECT item_id, min(text) AS t FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS c FROM i GROUP BY ALL),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format('text')} AS terms FROM documents),
c AS MATERIALIZED (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM d),
x AS MATERIALIZED (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
f AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM x SEMI JOIN q USING (term) GROUP BY r, term),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * any_value(c.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
s AS (SELECT item_id, r, any_value(f.doc_id) AS doc_id,
        sum(q.c * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (100 - 75 + ((75 * f.n * c.n) // c.l)))))::BIGINT AS score
      FROM f JOIN q USING (term) JOIN w USING (term), c GROUP BY item_id, r)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER o <= 10
"""
