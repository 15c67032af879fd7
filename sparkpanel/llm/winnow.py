"""Line deduplication by winnowing (operator 6, DataFrame functions only).

Texts are sequences of lines that hold a word; a line is compared without the
white space around it, by 128 bits of hash.  A repeated run is a sequence of
successive lines, ``MIN_WORDS`` words or more in all, that an earlier place
(smaller doc_id, then smaller line number) holds too.

* Window: the fewest lines from a given one on that hold ``MIN_WORDS`` words.
  The line of smallest hash in each window is selected as its fingerprint.
  Equal windows select equal lines, so every repeated run has a fingerprint
  that occurs twice; this is winnowing's guarantee, here in words.
* Join: fingerprints are counted with map-side combining; only windows whose
  fingerprint occurs at two places or more go on.  Among them, the earliest
  place of every window content is found (an aggregate again, no pairs).
* Extension: each later place is extended both ways, line by line, as far as
  its earliest place agrees.  Fewer than ``MIN_WORDS`` further words are looked
  at on each side, for longer agreement is itself a window.
* The lines of the extended later runs are deleted.  The earliest place of a
  line is never deleted, so each line of the corpus stays somewhere; a text that
  repeats itself keeps the first period.

All steps on one text are array expressions in its row; what is shuffled are
fingerprints and windows, and the texts once, to meet their deletions.

Defined results: a null text stays null and has no lines; lines without a word
are never compared nor deleted; a null doc_id comes before all others; rows that
repeat both doc_id and text are one document (all of them keep the same lines);
an empty table gives no rows; further columns pass through, those named like an
output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.llm.common import SEP_RE, SEPARATORS, let, table, written

MIN_WORDS = 50


def lines_of(text: Column) -> Column:
    """array<struct<p, n, a, b>> of a text's lines with a word: place, words, two hashes."""
    def line(raw: Column, p: Column) -> Column:
        s = F.btrim(raw, F.lit(SEPARATORS.decode()))
        return F.struct(p.cast("int").alias("p"), F.when(s == "", 0).otherwise(F.size(F.split(s, SEP_RE + "+"))).alias("n"),
                        F.xxhash64(s).alias("a"), F.xxhash64(F.lit(7), s).alias("b"))

    return F.filter(F.transform(F.split(text, "\n"), line), lambda x: x["n"] > 0)


def windows_of(lines: Column, min_words: int) -> Column:
    """array<struct> of a text's windows: first line i, fingerprint f at line fp, content ka, kb, and the lines in and around them."""
    def window(i: Column, most: Column) -> Column:
        start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("len"), F.lit(None).cast("struct<a:bigint,p:int>").alias("f"),
                         F.lit(0).cast("long").alias("ka"), F.lit(0).cast("long").alias("kb"))

        def grow(s: Column, x: Column) -> Column:
            here = F.struct(x["a"].alias("a"), x["p"].alias("p"))
            more = F.struct((s["w"] + x["n"]).alias("w"), (s["len"] + 1).alias("len"), F.when(s["f"].isNull() | (x["a"] < s["f"]["a"]), here).otherwise(s["f"]).alias("f"),
                            F.xxhash64(s["ka"], x["a"]).alias("ka"), F.xxhash64(s["kb"], x["b"]).alias("kb"))
            return F.when(s["w"] >= min_words, s).otherwise(more)

        return F.struct(i.cast("int").alias("i"), F.aggregate(F.slice(lines, i + 1, most), start, grow).alias("g"))

    def around(part: Column) -> Column:
        """(p, a) of successive lines while they hold fewer than min_words words."""
        start = F.struct(F.lit(0).alias("w"), F.array().cast("array<struct<p:int,a:bigint>>").alias("xs"))

        def grow(s: Column, x: Column) -> Column:
            fits = F.struct((s["w"] + x["n"]).alias("w"), F.concat(s["xs"], F.array(F.struct(x["p"].alias("p"), x["a"].alias("a")))).alias("xs"))
            return F.when(s["w"] + x["n"] < min_words, fits).otherwise(F.struct(F.lit(min_words).alias("w"), s["xs"].alias("xs")))

        return F.aggregate(part, start, grow, lambda s: s["xs"])

    def full(w: Column, most: Column) -> Column:
        i, size = w["i"], w["g"]["len"]
        before = F.reverse(F.slice(lines, F.greatest(F.lit(1), i - most + 1), F.least(i, most)))
        return F.struct(i.alias("i"), w["g"]["f"]["a"].alias("f"), w["g"]["f"]["p"].alias("fp"), w["g"]["ka"].alias("ka"), w["g"]["kb"].alias("kb"),
                        F.transform(F.slice(lines, i + 1, size), lambda x: x["p"]).alias("own"),
                        around(before).alias("left"), around(F.slice(lines, i + size + 1, most)).alias("right"))

    # the lines of a window at most
    most = F.ceil(F.lit(min_words) / F.array_min(F.transform(lines, lambda x: x["n"]))).cast("int")
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    found = let(most, lambda m: F.transform(F.filter(F.transform(places, lambda i: window(i, m)), lambda w: w["g"]["w"] >= min_words), lambda w: full(w, m)))
    return F.when(F.size(lines) > 0, found)


def agreeing(mine: Column, other: Column) -> Column:
    """Places of the first lines of ``mine`` that equal those of ``other``, up to the first difference."""
    start = F.struct(F.lit(True).alias("on"), F.array().cast("array<int>").alias("ps"))

    def step(s: Column, x: Column) -> Column:
        return F.when(s["on"] & F.coalesce(x["m"]["a"] == x["o"]["a"], F.lit(False)), F.struct(F.lit(True).alias("on"), F.concat(s["ps"], F.array(x["m"]["p"])).alias("ps"))) \
            .otherwise(F.struct(F.lit(False).alias("on"), s["ps"].alias("ps")))

    return F.aggregate(F.zip_with(mine, other, lambda m, o: F.struct(m.alias("m"), o.alias("o"))), start, step, lambda s: s["ps"])


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text) and ``gone``: the line numbers (from 0) to delete, for each text that has some."""
    rows = docs.filter(docs[text_col].isNotNull()).select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), lines_of(docs[text_col]).alias("lines"))
    # read twice: for the counts of fingerprints, and for the windows that go on
    spots = written(rows.select("id", "th", F.explode(windows_of(F.col("lines"), min_words)).alias("w")).select("id", "th", "w.*"))
    marks = spots.select("f", "id", "th", "fp").distinct()
    twice = marks.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f")
    spots = written(spots.join(twice, "f", "left_semi").drop("f", "fp"))
    first = spots.groupBy("ka", "kb").agg(F.min(F.struct("id", "th", "i", "left", "right")).alias("r"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = spots.join(first, ["ka", "kb"]).filter(~(F.col("id").eqNullSafe(F.col("r.id")) & (F.col("th") == F.col("r.th")) & (F.col("i") == F.col("r.i"))))
    run = F.concat("own", agreeing(F.col("left"), F.col("r.left")), agreeing(F.col("right"), F.col("r.right")))
    return later.select("id", "th", F.explode(run).alias("p")).groupBy("id", "th").agg(F.collect_set("p").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later repeated runs deleted from its text, n_lines and n_removed (lines with a word)."""
    gone = repeated_lines(docs, min_words, id_col, text_col).withColumnsRenamed({"id": "__id", "th": "__th", "gone": "__gone"})
    rows = docs.drop("n_lines", "n_removed").withColumn("__h", F.xxhash64(F.col(text_col)))
    rows = rows.join(gone, rows[id_col].eqNullSafe(gone["__id"]) & (rows["__h"] == gone["__th"]), "left")
    parts = F.split(text_col, "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone")), lambda j: parts[j])
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    n = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    rows = rows.withColumns({"n_lines": n, "n_removed": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"), "__kept": kept})
    return rows.withColumn(text_col, F.col("__kept")).drop("__h", "__id", "__th", "__gone", "__kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of 50 words and more that repeat earlier ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)
