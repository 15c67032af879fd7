"""Quoted multi-line CSV read in as many tasks as the file has splits.

A line feed ends a record only where the quotes before it are even in number
(an escaped quote counts two), so whether a split starts inside a record is the
parity of all quotes before it in its file:

1. quotes are counted per split, in the JVM; only one number a split is moved;
2. the counts are summed along each file, which gives every split its start;
3. each split is read again and cut into records with that start.  A record
   that crosses splits leaves a fragment in each of them; the fragments (two a
   split at most) are put together by a shuffle of their own;
4. the records are parsed by ``from_csv`` with the reader's own options, so
   values, nulls and FAILFAST are those of Spark's CSV reader.

Defined results: records end with LF or CRLF; a CRLF inside quotes stays as it is
(Spark's reader makes it LF in files whose records end with CRLF); an empty
field is null, quoted or not; empty lines are skipped; the first record of every file is its header and is not compared with the schema;
a quote inside an unquoted field is not CSV and fails or shifts the columns,
which is an error as well; a file that ends inside quotes is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splits whose starts travel in one broadcast (about 100 bytes each); more files are read in several unions.
MOST_SPLITS = 200_000
WHOLE, HEAD, TAIL, MIDDLE = range(4)
_OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}


def lines(spark: SparkSession, path) -> DataFrame:
    """file, block, value: the lines of every split, in order."""
    text = spark.read.format("text").option("lineSep", "\n").load(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def split_starts(text: DataFrame) -> DataFrame:
    """file, block, inside (the split starts within quotes), ends_inside, open_file (the file ends within quotes)."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    per_split = text.groupBy("file", "block").agg(F.sum(quotes.cast("long")).alias("n"))
    file = Window.partitionBy("file")               # one row a split
    upto = F.sum("n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per_split.select("file", "block", ((upto - F.col("n")) % 2 == 1).alias("inside"), (upto % 2 == 1).alias("ends_inside"),
                            (F.sum("n").over(file) % 2 == 1).alias("open_file"))


def cut_records(batches):
    """(file, block, part, first, value): whole records and fragments of the splits' lines.  Holds one unfinished record."""
    split, held, part, first = None, [], TAIL, False

    def rest(out):
        if held:                                    # the split ends within a record
            out.append((*split, MIDDLE if part == HEAD else TAIL, first, "\n".join(held)))

    for batch in batches:
        out = []
        file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        code, inside = file.indices.to_numpy(), batch.column("inside")
        cut = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1), len(batch)]
        for a, b in zip(cut, cut[1:]):
            if a == b:
                continue
            now = (file.dictionary[int(code[a])].as_py(), int(block[a]))
            if now != split:
                rest(out)
                split, held, first = now, [], now[1] == 0
                part, parity = (HEAD, 1) if inside[a].as_py() else (TAIL, 0)
            run = batch.column("value").slice(a, b - a)
            odd = (parity + np.cumsum(pc.count_substring(run, '"').to_numpy())) % 2
            parity = int(odd[-1])
            texts, at = run.to_pylist(), 0
            for end in np.flatnonzero(odd == 0).tolist():
                value = texts[end] if end == at and not held else "\n".join([*held, *texts[at:end + 1]])
                out.append((*split, HEAD if part == HEAD else WHOLE, first, value))
                held, at, part, first = [], end + 1, TAIL, False
            held += texts[at:]
        yield _rows(out)
    out = []
    if split:
        rest(out)
    yield _rows(out)


def _rows(out: list) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [()] * 5
    kinds = {"file": pa.string(), "block": pa.int64(), "part": pa.int32(), "first": pa.bool_(), "value": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values())], names=list(kinds))


def records(spark: SparkSession, path) -> DataFrame:
    """value, first: the CSV records of all files; ``first`` marks a file's first record."""
    from sparkpanel.session import cut_lineage, ship
    ship(spark)
    starts = cut_lineage(split_starts(lines(spark, path)))
    if bad := starts.filter("open_file").select("file").distinct().limit(3).collect():
        raise ValueError("a quoted field does not end in " + ", ".join(r["file"] for r in bad))
    files = starts.groupBy("file").count().collect()          # the driver lists the files anyway
    groups, room = [[]], MOST_SPLITS
    for r in files:
        if groups[-1] and r["count"] > room:
            groups.append([])
            room = MOST_SPLITS
        groups[-1].append(r["file"])
        room -= r["count"]
    kind = "file string, block long, part int, first boolean, value string"
    out = None
    for group in groups:
        mine = starts if len(groups) == 1 else starts.filter(F.col("file").isin(group))

        def cut(which: DataFrame) -> DataFrame:
            return lines(spark, path).join(F.broadcast(which.select("file", "block", "inside")), ["file", "block"]).mapInArrow(cut_records, kind)

        whole = cut(mine).filter(F.col("part") == WHOLE).select("value", "first")
        pieces = cut(mine.filter("inside or ends_inside")).filter(F.col("part") != WHOLE)
        number = F.sum((F.col("part") == TAIL).cast("long")).over(Window.partitionBy("file").orderBy("block", "part"))
        together = pieces.withColumn("n", number).groupBy("file", "n").agg(
            F.sort_array(F.collect_list(F.struct("block", "part", "value"))).alias("x"), F.bool_or("first").alias("first"))
        part = whole.unionByName(together.select(F.array_join(F.transform("x", lambda x: x["value"]), "\n").alias("value"), "first"))
        out = part if out is None else out.unionByName(part)
    return out


def read_split_csv(spark: SparkSession, path, schema: T.StructType | str) -> DataFrame:
    """The rows of quoted CSV files with a header, as Spark's multi-line reader gives them, in any number of tasks a file."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    value = F.regexp_replace("value", r"\r\z", "")
    rows = records(spark, path).filter(~F.col("first")).select(value.alias("value")).filter("value <> ''")
    return rows.select(F.from_csv("value", ddl, _OPTIONS).alias("r")).select("r.*")
