"""WARC archives: writing with deduplicated payloads, reading by boundary chains (operator 13).

Writing.  A page's payload is its text in UTF-8.  Of pages with equal payloads
of at least ``min_bytes``, the one with the largest id becomes a ``response``
record and the others ``revisit`` records that refer to it and have no payload.
A record is written as one "line" of a text sink, its last line feed being the
sink's separator, so the files hold nothing but records.

Reading.  The files are read in splits, cut at the magic ``WARC/1.``.  Each piece
begins with a candidate record; the magic may as well stand inside a payload.

* A task adds up the piece lengths of each split and emits, for each candidate,
  its offset and that of its successor (from the header's Content-Length).
  Within the split it follows the successors already: a candidate gets the first
  offset of its chain beyond the split, and its place (an interval) in the
  forest of chains.
* The splits' lengths, summed along each file, turn places in a split into
  offsets in the file.
* Pointer jumping from offset 0 over the candidates that chains of other splits
  lead to: in each round the reached offsets jump and the jumps double, so a
  file of n splits takes log2(n) rounds, whatever the number of its records.
* A candidate is a record if its interval contains that of its split's reached
  one, that is, if it lies on the chain.  All others are magic inside payloads.
* Payload lengths and SHA-1 come out of the first pass for records of one piece.
  Only records whose payload holds the magic are put together from their pieces,
  by a second pass.

Defined results: a null text is an empty payload; a null id has no record id,
is smaller than all others and comes back as null; rows that repeat an id and a
payload are records of their own, of one type; line breaks in a URL are percent
encoded; a file whose chain does not end at its end (cut off, or not a WARC
file) is an error, or with ``strict=False`` gives the records up to there; an
empty table or folder gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkpanel.llm.common import _names, table, written
from sparkpanel.session import checkpoint_dir

MAGIC = "WARC/1."
MIN_BYTES = 1_000
#: Rows of revisits (under 100 bytes each) up to which they travel by broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Groups that the rows of one payload are dealt into.
SALTS = 32
#: Files to which a second pass is confined by name, if they are no more than that.
NAMED_FILES = 1_000
_CRLF = "\r\n"


# ---------------------------------------------------------------------------
# writing


def verdicts(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, digest, top: the pages that revisit another one, ``top``, with an equal payload."""
    light = written(pages.filter(F.col("size") >= min_bytes).select("page_id", "digest", "size", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt")))
    part = light.groupBy("digest", "size", "salt").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    full = part.groupBy("digest", "size").agg(F.max("top").alias("top"), F.sum("n").alias("n")).filter("n > 1 and top is not null").drop("n")
    tops = part.drop("top", "n").join(full, ["digest", "size"])
    return light.join(tops, ["digest", "size", "salt"]).filter("page_id is null or page_id < top").select("page_id", "digest", "top").distinct()


def header(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit(""))


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archives(df: DataFrame, path: str, min_bytes: int = MIN_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html",
                   date: str = "1970-01-01T00:00:00Z") -> None:
    """One WARC/1.1 record a row, in a file a task under ``path``."""
    text = F.coalesce(df[html], F.lit(""))
    pages = df.select(df[page_id].cast("long").alias("page_id"), df[url].alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("digest"),
                      F.octet_length(text).cast("long").alias("size"))
    again = written(verdicts(pages, min_bytes))
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    revisit = again.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "top")
    rows = pages.join(revisit, pages["page_id"].eqNullSafe(F.col("__id")) & (pages["digest"] == F.col("__digest")), "left")
    is_revisit = F.col("top").isNotNull()
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF + "Content-Length: "), F.col("size").cast("string"), F.lit(_CRLF * 2))
    length = F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(MAGIC + "1" + _CRLF), header("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")), header("WARC-Record-ID", urn(F.col("page_id"))),
        header("WARC-Date", F.lit(date)), header("WARC-Target-URI", uri), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        header("WARC-Refers-To", urn(F.col("top"))),
        header("WARC-Profile", F.when(is_revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        header("Content-Type", F.lit("application/http; msgtype=response")), header("Content-Length", length.cast("string")), F.lit(_CRLF))
    record = F.concat(head, http, F.when(is_revisit, "").otherwise(F.col("html")), F.lit(_CRLF + "\r"))      # the sink adds the last \n
    rows.select(record.alias("value")).write.option("lineSep", "\n").text(path)


# ---------------------------------------------------------------------------
# reading


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, value: what stands between two magics, in the order of each split."""
    text = spark.read.format("text").option("lineSep", MAGIC).load(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def field(head: Column, name: str) -> Column:
    """The first value of a header; null where it is missing."""
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(found != "", found)


def parsed(df: DataFrame) -> DataFrame:
    """A piece's header fields, the bytes to its successor, and its payload if it holds the whole record.

    All in bytes: strings are cut at ASCII marks and binaries at byte counts.
    """
    end = F.lit(_CRLF * 2)
    df = df.withColumn("bytes", F.octet_length("value").cast("long"))
    df = df.withColumn("head", F.when(F.col("value").startswith("1\r\n") | F.col("value").startswith("0\r\n"), F.substring_index("value", _CRLF * 2, 1)))
    head_bytes = (F.octet_length("head") + F.octet_length(end)).cast("long")
    length = F.when(head_bytes <= F.col("bytes"), field(F.col("head"), "Content-Length").try_cast("long"))
    df = df.withColumn("length", F.when(length >= 0, length)).withColumn("from", head_bytes)
    df = df.withColumn("step", F.lit(len(MAGIC)) + F.col("from") + F.col("length") + 4)
    whole = (F.col("from") + F.col("length") + 4 == F.col("bytes")) & F.endswith(F.col("value").cast("binary"), F.lit(end).cast("binary"))
    df = df.withColumn("whole", F.coalesce(whole, F.lit(False)))
    block = F.when(F.col("whole"), F.substring(F.col("value").cast("binary"), F.col("from") + 1, F.col("length"))).cast("string")
    is_http = F.coalesce(field(F.col("head"), "Content-Type"), F.lit("")).startswith("application/http")
    df = df.withColumn("block_", block).withColumn("http", F.when(is_http, F.substring_index("block_", _CRLF * 2, 1)))
    skip = F.coalesce(F.octet_length("http") + 4, F.lit(0))
    df = df.withColumn("payload", F.substring(F.col("block_").cast("binary"), skip + 1, F.greatest(F.col("length") - skip, F.lit(0))))
    head = F.col("head")
    return df.select(
        "file", "block", "bytes", "step", "whole", "payload", field(head, "WARC-Type").alias("record_type"), field(head, "WARC-Record-ID").alias("record_id"),
        field(head, "WARC-Target-URI").alias("uri"), field(head, "WARC-Refers-To").alias("refers_to"), field(head, "WARC-Payload-Digest").alias("stated_digest"),
        field(F.col("http"), "Content-Length").try_cast("long").alias("http_length"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))


FIELDS = "record_type string, record_id string, uri string, refers_to string, stated_digest string, http_length long, payload_bytes long, sha1 string"
LINKS = "file string, block long, place long, bytes long, step long, whole boolean, leave long, low long, high long, " + FIELDS


def links(place: np.ndarray, step: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the candidates of a split, by place: where their chains leave it, and their intervals in the forest of chains.

    ``step`` is -1 for a piece that is no candidate.  A chain's next member lies within the interval's owner:
    b is on the chain that starts at a exactly if low[b] <= low[a] <= high[b].
    """
    n = len(place)
    to = place + step
    at = np.searchsorted(place, to)
    inside = (step >= 0) & (to < end) & (at < n)
    inside[inside] &= (place[at[inside]] == to[inside]) & (step[at[inside]] >= 0)
    at, to = np.where(inside, at, -1).tolist(), to.tolist()
    size = [1] * n
    for i in range(n):                              # successors come later
        if at[i] >= 0:
            size[at[i]] += size[i]
    leave, low, free, roots = [0] * n, [0] * n, [0] * n, 0
    for i in range(n - 1, -1, -1):
        if at[i] >= 0:
            leave[i], low[i] = leave[at[i]], free[at[i]]
            free[at[i]] += size[i]
        else:
            leave[i], low[i] = to[i], roots
            roots += size[i]
        free[i] = low[i] + 1
    low = np.array(low, np.int64)
    return np.array(leave, np.int64), low, low + np.array(size, np.int64) - 1


def linked(batches):
    """Adds place (of the magic, counted from the split's first piece), leave, low and high; holds one split's header fields."""
    held: list[pa.RecordBatch] = []
    split = None

    def out():
        rows = pa.Table.from_batches(held).combine_chunks()
        size = rows["bytes"].to_numpy() + len(MAGIC)
        place = np.cumsum(size) - size - len(MAGIC)
        step = rows["step"].fill_null(-1).to_numpy()
        leave, low, high = links(place, step, int(size.sum()) - len(MAGIC))
        for name, at, x in (("place", 2, place), ("leave", 6, leave), ("low", 7, low), ("high", 8, high)):
            rows = rows.add_column(at, name, pa.array(x, pa.int64()))
        return rows.to_batches()

    for batch in batches:
        file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        code = file.indices.to_numpy()
        cut = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1), len(batch)]
        for a, b in zip(cut, cut[1:]):
            if a == b:
                continue
            now = (file.dictionary[int(code[a])].as_py(), int(block[a]))
            if held and now != split:
                yield from out()
                held = []
            split = now
            held.append(batch.slice(a, b - a))
    if held:
        yield from out()


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """All pieces with their places, links and header fields, written once."""
    light = parsed(pieces(spark, path)).drop("payload")
    return written(light.mapInArrow(linked, LINKS))


def bases(found: DataFrame) -> DataFrame:
    """file, block, base, last: offset of each split's first piece in its file, and the file's length."""
    splits = found.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("n"))
    file = Window.partitionBy("file")                # one row a split
    before = F.sum("n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return splits.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"), (F.sum("n").over(file) - len(MAGIC)).alias("last"))


def reached(found: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, block, low) of the first record of each split, and (file, ends, last): whether a file's chain ends at its end."""
    cand = found.filter("step is not null").join(base, ["file", "block"]).select("file", "block", "low", (F.col("base") + F.col("place")).alias("at"), (F.col("base") + F.col("leave")).alias("to"))
    entered = cand.select("file", F.col("to").alias("at")).unionByName(base.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    heads = written(cand.join(entered, ["file", "at"]))
    seen = written(base.select("file", F.lit(0).cast("long").alias("at")).distinct())
    jump = heads.select("file", "at", "to")
    n = seen.count()
    while True:
        far = jump.select("file", "at", "to")
        seen = written(seen.unionByName(seen.join(far, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct())
        m = seen.count()
        if m == n:
            break
        n = m
        jump = written(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("then")), ["file", "to"]).select("file", "at", F.col("then").alias("to")))
    ends = seen.groupBy("file").agg(F.max("at").alias("end")).join(base.groupBy("file").agg(F.max("last").alias("last")), "file")
    return heads.join(seen, ["file", "at"]).select("file", "block", "low"), ends


def placed(batches):
    """(file, block, place, value) of the pieces of a second pass, in the same order as the first."""
    split, at = None, 0
    for batch in batches:
        size = batch.column("bytes").to_pylist()
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        place = np.zeros(len(keys), np.int64)
        for i, key in enumerate(keys):
            if key != split:
                split, at = key, -len(MAGIC)
            place[i] = at
            at += size[i] + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(place), batch.column("value")], names=["file", "block", "place", "value"])


def assembled(spark: SparkSession, path: str, found: DataFrame, base: DataFrame, records: DataFrame, which: Column) -> DataFrame:
    """file, offset, value of the records of which ``which`` holds, put together from their pieces."""
    # a piece belongs to the last record at or before it: in its split, else in an earlier one
    records = records.select("file", "block", "place", "offset", "end", which.alias("wanted"))
    marks = found.select("file", "block", "place").join(records, ["file", "block", "place"], "left")
    mine = F.struct("offset", "end", "wanted")
    inside = Window.partitionBy("file", "block").orderBy("place")                  # bounded by a split
    last = records.groupBy("file", "block").agg(F.max_by(mine, "offset").alias("own"))
    carry = base.join(last, ["file", "block"], "left").select(
        "file", "block", "base", F.last("own", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    owner = marks.withColumn("own", F.last(F.when(F.col("offset").isNotNull(), mine), True).over(inside)).join(carry, ["file", "block"])
    owner = owner.withColumn("own", F.coalesce("own", "carry")).filter(F.col("own.wanted") & (F.col("base") + F.col("place") < F.col("own.end")))
    keys = written(owner.select("file", "block", "place", "base", F.col("own.offset").alias("offset")))
    again = pieces(spark, path)
    files = [r["file"] for r in keys.select("file").distinct().limit(NAMED_FILES + 1).collect()]
    if len(files) <= NAMED_FILES:
        again = again.filter(F.col("file").isin(files))
    again = again.select("file", "block", F.octet_length("value").cast("long").alias("bytes"), F.col("value").cast("binary").alias("value"))
    texts = again.mapInArrow(placed, "file string, block long, place long, value binary").join(keys, ["file", "block", "place"])
    parts = F.sort_array(F.collect_list(F.struct((F.col("base") + F.col("place")).alias("at"), F.col("value").cast("string").alias("value"))))
    return texts.groupBy("file", "offset").agg(F.array_join(F.transform(parts, lambda x: x["value"]), MAGIC).alias("value"))


def read_archives(spark: SparkSession, path: str, payloads: bool = False, strict: bool = True) -> DataFrame:
    """file, offset, the header fields, payload_bytes and sha1 of every record; with ``payloads`` also the payload."""
    found = candidates(spark, path)
    base = written(bases(found))
    first, ends = reached(found, base)
    if strict and (bad := ends.filter("end <> last").limit(3).collect()):
        raise ValueError("no whole WARC file: " + ", ".join(f"{r['file']} (chain ends at {r['end']} of {r['last']})" for r in bad))
    chain = found.filter("step is not null").join(first.withColumnRenamed("low", "entry"), ["file", "block"]).filter("low <= entry and entry <= high")
    offset = F.col("base") + F.col("place")
    records = written(chain.join(base, ["file", "block"]).withColumn("offset", offset).withColumn("end", offset + F.col("step")).filter("end <= last").drop("low", "high", "entry", "leave", "base", "last"))
    names = [c.split()[0] for c in FIELDS.split(", ")]
    out = ["file", "offset", *names]
    which = F.lit(True) if payloads else ~F.col("whole")
    simple = records.filter(~which).select(*out)
    if not payloads and not records.filter(which).limit(1).count():
        return simple
    values = assembled(spark, path, found, base, records, which)
    rest = parsed(values.withColumn("block", F.col("offset"))).withColumn("offset", F.col("block"))
    if payloads:
        return rest.select(*out, "payload")
    return simple.unionByName(rest.select(*out))


def pages_of(records: DataFrame) -> DataFrame:
    """One row a page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        number("record_id").alias("page_id"), F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.replace("stated_digest", F.lit("sha1:"), F.lit(""))).otherwise(F.col("sha1")).alias("payload_digest"),
        "record_type", F.when(revisit, number("refers_to")).alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive in the checkpoint folder and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{spark.sparkContext.applicationId}-{next(_names)}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return pages_of(read_archives(spark, path))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
t AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t
"""
