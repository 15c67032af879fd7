"""Corpus pipeline: from raw documents to token ids, in five stages.

Each stage works on all that its predecessor kept and is written as Parquet in
the shared checkpoint folder before the next one reads it.  All but the last
return the columns of ``documents``.  Defined results for nulls, empty and very
long texts, ties and repeated rows are those of the operators that are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.llm import byte_bpe, lang_tree, mix_tree, partition_join, winnow
from sparkpanel.llm.common import table, written

#: Share of the held-out texts of known language that the language stage's least confidence keeps; texts without a letter are rejected too.
KEEP_LANG = 0.999
#: That confidence is never set above this: a prediction likelier than not is taken, however sure the held-out texts are.
MOST_LEAST = 0.5
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.  A missing ``lang`` is filled in by the prediction.

    The least confidence is set on the held-out texts; where there are none, any prediction is taken.
    """
    tree = lang_tree.tree_of(docs)
    least = min(lang_tree.least_score(docs, tree, KEEP_LANG) or 0.0, MOST_LEAST)
    rows = lang_tree.predict(docs, tree).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return rows.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 50 words and more are deleted from the texts; n_chars follows."""
    rows = winnow.dedup_lines(docs)
    return rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id; of its repeated rows the smallest by all columns.

    Documents without words all stay.
    """
    sets = partition_join.near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT).filter("n_shingles > 0")
    first = sets.groupBy("comp").agg(F.min(F.struct("doc_id", "th")).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.th").alias("__th"))
    rows = docs.withColumn("__h", F.xxhash64("text"))
    empty = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = rows.filter(~empty).join(first, rows["doc_id"].eqNullSafe(first["__id"]) & (rows["__h"] == first["__th"]))
    # of rows that repeat an id and a text the smallest in the order of all columns stays, in any partitioning
    kept = found.groupBy("__id", "__th").agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")
    return kept.select(*docs.columns).unionByName(rows.filter(empty).select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken (0 to 2 times)."""
    return mix_tree.copies(mix_tree.mix(docs)).select(*docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded texts and of their decoding."""
    return byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), byte_bpe.default_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]

#: Trained models, hashed order and token merges are not expressible in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
