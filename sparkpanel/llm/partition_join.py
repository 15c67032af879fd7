"""Jaccard self-join on word n-grams by universe partitioning (operator 7).

Two texts link when ``100 * |intersection| >= percent * |union|`` of their sets
of word n-grams.  Sets of size n and at most n then differ in at most
``H(n) = 2n (100 - p) / (100 + p)`` tokens.

* Size bands.  Bands of sizes grow by ``GROWTH`` (more than 100 / p, so partners
  are in one band or in neighbouring ones).  A band hashes the universe of tokens
  into segments; a difference of H tokens leaves at least one of H + 1 segments
  equal.  A set indexes the subset of tokens it has in each of the first
  ``reach`` segments, enough for any larger partner, in its own band and, if its
  partners can be there, in the next.
* Cost-based allocation.  A set needs only H + 1 of its segments to probe, and has
  about a fifth more.  It leaves out its most frequent ones (boilerplate that
  many texts share), so that hot segments are not joined.
* One-deletion neighbourhoods.  Small sets (bands below ``SMALL``) have half as
  many segments, each of which may differ by one token: they index the subset and
  the subset without any one token.
* Candidates are found in two steps, so that no group is expanded into all its
  pairs.  First every probe meets one anchor of its segment's group, the set that
  shares most with others; verified pairs give components.  Then the sets that
  share a segment with another component are partitioned once more, a token to a
  segment, and again probe with their rarest ones (see ``cross_candidates``);
  only pairs of different components are joined and verified.  Members of a
  component need no further links, as the result is the component; no link
  between components is lost.
* Verification counts the intersection of the two whole sets, from the texts.

Identical sets are one node.  Rows of segments travel as packed blocks to
buckets whose number follows the data; a segment that is frequent within one task
is dealt over all buckets and leaves one marker in its own, so a group of copies
of any size is spread.

Defined results: a null text, or one without words, has the empty set and is
linked with nothing; a text of fewer words than n has one token, the whole
sequence; repeated rows (and repeated ids) are joined like others; a null doc_id
is never a component's id, unless all its ids are null; an empty table gives no
rows; further columns are carried along by ``near_duplicates`` callers' joins
only.  Tokens and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkpanel.llm.common import mix, table, text_slices, word_hashes, written

GROWTH, SMALL = 1.6, 128
#: Segment rows of a bucket, rows a task holds before it sends them, and members from which a segment counts as frequent in a task.
BUCKET_ROWS, BUFFER_ROWS, LOCAL_HOT = 1_500_000, 1_000_000, 16
#: A segment is left out only if more sets than this have it.
CHEAP = 8
#: Growth of the size classes by which the last candidates are joined.
CLASS = 1.02
_K = np.uint64(0xD6E8FEB86659FD93)
ROW = np.dtype([("sig", "<u8"), ("node", "<u8"), ("slack", "u1")])      # slack 255: indexed, does not probe


def differences(n, percent: int):
    """H(n): most tokens in which a set of n tokens and a partner of at most n can differ."""
    return 2 * n * (100 - percent) // (100 + percent)


def reach(n, percent: int):
    """Segments that a set of n tokens uses to probe (exact bands)."""
    need = differences(n, percent) + 1
    return need + need // 5 + 6


@lru_cache(8)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each band (and one more), its segments, and whether it uses one-deletion neighbourhoods.

    The first band holds the sets that have larger partners only.
    """
    least = 1
    while not differences(least, percent):
        least += 1
    first = [*range(-(-least * percent // 100), least)][:1] + [least]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, int(np.ceil(first[-1] * GROWTH))))
    first = np.array(first, np.int64)
    small = first[1:] <= SMALL
    most = first[1:] - 1
    return first, np.where(small, (differences(most, percent) + 2) // 2, reach(most, percent)), small


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text (sorted within it), as 64-bit hashes, and n + 1 offsets."""
    w, off, _ = word_hashes(texts, lower=True)
    size = np.diff(off)
    many = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    out_off = np.append(0, np.cumsum(many))
    place = np.repeat(off[:-1], many) + np.arange(out_off[-1]) - np.repeat(out_off[:-1], many)
    padded = np.append(w, np.zeros(width, np.uint64))
    end = np.repeat(off[1:], many)
    h = np.zeros(len(place), np.uint64)
    for k in range(width):
        inside = place + k < end
        h = np.where(inside, (h + padded[place + k]) * _K, h)
    h = mix(h + np.repeat(np.minimum(size, width), many).astype(np.uint64))
    for a, b in zip(out_off[:-1].tolist(), out_off[1:].tolist()):
        h[a:b].sort()
    text = np.repeat(np.arange(len(size)), many)
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[:len(h)]
    return h[new], np.append(0, np.cumsum(np.bincount(text[new], minlength=len(size))))


def node_of(tok: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit hash of each set, whatever its order."""
    n = np.diff(off)
    sums = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        sums[some] = np.add.reduceat(mix(tok ^ _K), off[:-1][some])
    return mix(sums ^ n.astype(np.uint64) * _K)


def segment_rows(tok: np.ndarray, off: np.ndarray, node: np.ndarray, percent: int, empties: frozenset = frozenset()) -> np.ndarray:
    """The rows (ROW) of all sets.  Empty segments are rows only in the bands of ``empties``."""
    first, segments, small = bands(percent)
    n = np.diff(off)
    own = np.searchsorted(first, n, side="right") - 1
    out = []
    for shift in (0, 1):
        band = own + shift
        # a partner of n * 100 / percent tokens at most may be in the next band
        use = (own >= 0) if not shift else (own >= 0) & (n * 100 // percent >= first[np.minimum(own + 1, len(first) - 1)])
        which = np.flatnonzero(use)
        if not len(which):
            continue
        b, size = band[which], n[which]
        m = segments[b]
        text = np.repeat(np.arange(len(which)), size)
        at = np.repeat(off[which], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        x = mix(tok[at] + (b[text] + 1).astype(np.uint64) * _K)
        seg = ((x >> np.uint64(32)) % m[text].astype(np.uint64)).astype(np.int64)
        base = np.cumsum(m) - m
        total = np.zeros(int(m.sum()), np.uint64)
        np.add.at(total, base[text] + seg, x)
        count = np.bincount(base[text] + seg, minlength=len(total))
        owner = np.repeat(np.arange(len(which)), m)
        number = np.arange(len(total)) - np.repeat(base, m)
        exact = ~small[b]
        probes = np.where(exact, reach(size, percent), m)
        indexed = np.where(exact, np.minimum(m, reach(size * 100 // percent, percent)), m)
        slack = np.where(exact, np.minimum(probes - differences(size, percent) - 1, 254), 0)
        salt = mix((b[owner] + 1).astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))
        full = (count > 0) | ~exact[owner]
        if empties:
            full |= np.isin(b[owner], list(empties))
        # empty segments that are not sent are left out by allocation: they use up slack
        empty = np.bincount(owner[(count == 0) & exact[owner] & (number < probes[owner])], minlength=len(which))
        if not empties:
            slack = np.where(exact, slack - empty, slack)
        else:
            slack = np.where(exact & ~np.isin(b, list(empties)), slack - empty, slack)
        keep = np.flatnonzero(full & (number < indexed[owner]))
        rows = np.zeros(len(keep), ROW)
        rows["sig"] = mix(total[keep] ^ salt[keep])
        rows["node"] = node[which][owner[keep]]
        rows["slack"] = np.where((number[keep] < probes[owner[keep]]) & (shift == 0), np.maximum(slack, 0)[owner[keep]], 255)
        out.append(rows)
        gone = np.flatnonzero(small[b][text])
        if len(gone):
            rows = np.zeros(len(gone), ROW)
            rows["sig"] = mix((total[(base[text] + seg)[gone]] - x[gone]) ^ salt[(base[text] + seg)[gone]])
            rows["node"] = node[which][text[gone]]
            rows["slack"] = 0 if not shift else 255
            out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, ROW)


def short_of(tok: np.ndarray, off: np.ndarray, percent: int) -> np.ndarray:
    """Band of each set that has too few non-empty segments to probe, else -1."""
    first, segments, small = bands(percent)
    n = np.diff(off)
    own = np.searchsorted(first, n, side="right") - 1
    out = np.full(len(n), -1)
    which = np.flatnonzero((own >= 0) & ~small[np.maximum(own, 0)])
    if len(which):
        b, size = own[which], n[which]
        m = segments[b]
        text = np.repeat(np.arange(len(which)), size)
        at = np.repeat(off[which], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        x = mix(tok[at] + (b[text] + 1).astype(np.uint64) * _K)
        seg = ((x >> np.uint64(32)) % m[text].astype(np.uint64)).astype(np.int64)
        base = np.cumsum(m) - m
        owner, number = np.repeat(np.arange(len(which)), m), np.arange(int(m.sum())) - np.repeat(base, m)
        count = np.bincount(base[text] + seg, minlength=len(number))
        full = np.bincount(owner[(count > 0) & (number < reach(size, percent)[owner])], minlength=len(which))
        out[which] = np.where(full <= differences(size, percent), b, -1)
    return out


def set_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), node, short (band, or -1) of every row."""

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch.column("text")):
                tok, off = shingles(batch.column("text").slice(a, b - a), width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a), pa.array(np.diff(off)),
                                                  pa.array(node_of(tok, off).view(np.int64)), pa.array(short_of(tok, off, percent).astype(np.int32))],
                                                 names=["doc_id", "th", "n", "node", "short"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return rows.mapInArrow(run, "doc_id long, th long, n long, node long, short int")


def token_rows(tok: np.ndarray, off: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The finest partition: every token is a segment."""
    rows = np.zeros(len(tok), ROW)
    rows["sig"], rows["node"] = tok, np.repeat(node, np.diff(off))
    return rows


def shared(docs: DataFrame, width: int, rows_of, buckets: int) -> DataFrame:
    """sig, node, slack, freq: the segments that two nodes or more have (a row may be repeated).

    ``rows_of`` makes the rows (ROW) of sets, tokens and offsets and nodes.
    """

    def run(batches):
        held, rows_held, seen = [], 0, set()

        def flush():
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["slack"], rows["node"], rows["sig"]))]
            new = np.append(True, (rows["sig"][1:] != rows["sig"][:-1]) | (rows["node"][1:] != rows["node"][:-1]))[:len(rows)]
            rows = rows[new]            # of a node's equal rows, one that probes
            begin = np.flatnonzero(np.append(True, rows["sig"][1:] != rows["sig"][:-1])[:len(rows)])
            size = np.diff(np.append(begin, len(rows)))
            hot = np.repeat(size >= LOCAL_HOT, size)
            lead = np.zeros(len(rows), bool)
            lead[begin] = True
            at, blobs, kinds = [], [], []
            for direct in (False, True):
                part = rows[hot] if direct else rows[~hot | lead]
                key = mix(part["node"] ^ part["sig"]) if direct else part["sig"]
                to = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                part, to = part[order], to[order]
                cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])[:len(part)]).tolist()
                for a, b in zip(cut, [*cut[1:], len(part)]):
                    at.append(int(to[a])), blobs.append(part[a:b].tobytes()), kinds.append(direct)
            for i in range(0, len(at), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 1000], pa.int32()), pa.array(kinds[i:i + 1000], pa.bool_()), pa.array(blobs[i:i + 1000], pa.binary())],
                                                 names=["bucket", "direct", "rows"])

        for batch in batches:
            for a, b in text_slices(batch.column("text")):
                tok, off = shingles(batch.column("text").slice(a, b - a), width)
                node = node_of(tok, off)
                fresh = np.fromiter((x not in seen for x in node.tolist()), bool, len(node))
                if len(seen) > 200_000:
                    seen.clear()
                seen.update(node.tolist())
                n = np.where(fresh, np.diff(off), 0)                      # copies within the task send nothing
                keep = np.repeat(fresh, np.diff(off))
                held.append(rows_of(tok[keep], np.append(0, np.cumsum(n)), node))
                rows_held += len(held[-1])
                if rows_held > BUFFER_ROWS:
                    yield from flush()
                    held, rows_held = [], 0
        if rows_held:
            yield from flush()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.zeros(0, ROW), *(np.frombuffer(x, ROW) for x in pdf["rows"][~pdf["direct"]])])
        rows = rows[np.lexsort((rows["slack"], rows["node"], rows["sig"]))]
        rows = rows[np.append(True, (rows["sig"][1:] != rows["sig"][:-1]) | (rows["node"][1:] != rows["node"][:-1]))[:len(rows)]]
        begin = np.flatnonzero(np.append(True, rows["sig"][1:] != rows["sig"][:-1])[:len(rows)])
        freq = np.repeat(np.diff(np.append(begin, len(rows))), np.diff(np.append(begin, len(rows))))
        some = freq > 1
        direct = [np.frombuffer(x, ROW) for x in pdf["rows"][pdf["direct"]]]
        far = sum(map(len, direct))
        rows = np.concatenate([rows[some], *direct])
        return pd.DataFrame({"sig": rows["sig"].view(np.int64), "node": rows["node"].view(np.int64), "slack": rows["slack"].astype(np.int32),
                             "freq": np.append(freq[some], np.full(far, 1 << 20)).astype(np.int64)})

    packed = docs.select("text").mapInArrow(run, "bucket int, direct boolean, rows binary")
    return packed.groupBy("bucket").applyInPandas(group, "sig long, node long, slack int, freq long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, by the intersection of their whole sets."""

    def run(batches):
        for batch in batches:
            a_text, b_text = batch.column("a_text"), batch.column("b_text")
            keep = np.zeros(len(batch), bool)
            for a, b in text_slices(a_text, 1 << 20):
                x, xo = shingles(a_text.slice(a, b - a), width)
                for c, d in text_slices(b_text.slice(a, b - a), 1 << 20):
                    y, yo = shingles(b_text.slice(a + c, d - c), width)
                    for i in range(c, d):
                        p, q = x[xo[i]:xo[i + 1]], y[yo[i - c]:yo[i - c + 1]]
                        both = len(np.intersect1d(p, q, assume_unique=True))
                        keep[a + i] = 100 * both >= percent * (len(p) + len(q) - both) > 0
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    t = texts.select("node", "text")
    with_a = pairs.join(t.withColumnsRenamed({"node": "a", "text": "a_text"}), "a")
    with_b = with_a.join(t.withColumnsRenamed({"node": "b", "text": "b_text"}), "b")
    return with_b.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def cross_candidates(left: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a < b) of nodes of different components that can link.  ``left`` has node, comp, n, text.

    The finest universe partition, one token a segment, with the same allocation:
    tokens are put in order of frequency, and sets of sizes n >= m that share o
    tokens, o = ceil(p (n + m) / (100 + p)) being required, share one that is among
    the first n - o + 1 of the one and the first m - o + 1 of the other.  In a group
    of edited copies these are the edits, not the text they have in common, so the
    candidates do not grow with the square of the group.
    """
    total = left.agg(F.sum("n")).first()[0] or 0
    tokens = shared(left, width, token_rows, max(12, int(total) // BUCKET_ROWS + 1)).select("sig", "node", "freq").distinct()
    freq = tokens.groupBy("sig").agg(F.max("freq").alias("f"), F.count("*").alias("c"))
    of = tokens.select("sig", "node").distinct().join(freq, "sig").join(left.select("node", "comp", "n"), "node")
    by_node = Window.partitionBy("node")
    rank = F.row_number().over(by_node.orderBy("f", "c", "sig"))
    # tokens that no other set has come first
    of = of.withColumn("pos", (F.col("n") - F.count("*").over(by_node) + rank - 1).cast("long"))
    need = lambda a, b: F.ceil(percent * (a + b) / (100 + percent) - 1e-9)
    size_class = lambda n: F.floor(F.log(n.cast("double")) / math.log(CLASS) + 1e-9).cast("int")
    n = F.col("n")
    least = F.ceil(n * percent / 100.0 - 1e-9).cast("long")
    of = written(of.filter(F.col("pos") <= n - need(n, least)).select("sig", "node", "comp", "n", "pos"))
    small = of.filter(F.col("pos") <= n - need(n, n)).select("sig", size_class(n).alias("cls"), F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("m"), F.col("pos").alias("pb"))
    large = of.withColumns({"cls": F.explode(F.sequence(size_class(least), size_class(n))), "least": least})
    smallest = F.greatest(F.col("least"), F.floor(F.pow(F.lit(CLASS), F.col("cls")) - 1e-6).cast("long"))
    large = large.filter(F.col("pos") <= n - need(n, smallest)).select("sig", "cls", F.col("node").alias("a"), F.col("comp").alias("ca"), "n", F.col("pos").alias("pa"))
    o = need(F.col("n"), F.col("m"))
    fits = (F.col("ca") != F.col("cb")) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("a")))) \
        & (F.col("m") * 100 >= F.col("n") * percent) & (F.col("pa") <= F.col("n") - o) & (F.col("pb") <= F.col("m") - o)
    pairs = large.join(small, ["sig", "cls"]).filter(fits)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of all nodes with links: labels spread, then labels of labels, until nothing changes."""
    ends = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    label = written(ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        near = ends.join(label.withColumnsRenamed({"node": "b", "comp": "c"}), "b").groupBy("a").agg(F.min("c").alias("c"))
        new = label.join(near, label["node"] == near["a"]).select("node", F.least("comp", "c").alias("comp"), F.col("comp").alias("old"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = written(new.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "old"))
        if new.filter("comp <> old").isEmpty():
            return new.select("node", "comp")
        label = new.select("node", "comp")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, n_shingles, component_id, comp of every row; see the module's text.

    th is xxhash64 of the text.  comp tells components apart, whatever their ids
    (null: no words); component_id is the smallest id in the component.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sets = written(set_table(docs, width, percent))
    stats = sets.agg(F.sum("n"), F.collect_set(F.when(F.col("short") >= 0, F.col("short")))).first()     # bands: a few dozen
    buckets = max(12, int((stats[0] or 0) * 0.35) // BUCKET_ROWS + 1)
    found = shared(docs, width, partial(segment_rows, percent=percent, empties=frozenset(stats[1] or [])), buckets)
    nodes = sets.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.min("n").alias("n"), F.min("doc_id").alias("rep"))

    # cost-based allocation: each node leaves out its most frequent segments, within its slack
    rows = found.repartition("node").groupBy("node", "sig").agg(F.min("slack").alias("slack"), F.max("freq").alias("freq"))
    by_cost = Window.partitionBy("node").orderBy(F.desc(F.when(F.col("slack") < 255, F.col("freq")).otherwise(-1)), "sig")
    rows = rows.withColumns({"rank": F.row_number().over(by_cost), "weight": F.sum("freq").over(Window.partitionBy("node")),
                             "spare": F.min("slack").over(Window.partitionBy("node"))})
    left_out = (F.col("rank") <= F.col("spare")) & (F.col("freq") > CHEAP) & (F.col("slack") < 255)
    rows = rows.withColumns({"own": F.col("slack") < 255, "probe": (F.col("slack") < 255) & ~left_out})
    # of all segments that a set can probe with, spare + 1 must agree with a partner's: other sets only answer
    rows = rows.withColumn("owned", F.sum(F.col("own").cast("int")).over(Window.partitionBy("node")))
    rows = rows.withColumn("able", F.col("owned") > F.col("spare"))
    rows = written(rows.select("sig", "node", "own", "probe", "spare", "owned", "able", "weight"))
    # segments that no able set probes go, but a partner may agree in them: they still count below
    rows = written(rows.join(rows.filter("able AND probe").select("sig").distinct(), "sig", "left_semi"))

    involved = nodes.join(rows.select("node").distinct(), "node", "left_semi")
    once = docs.filter(F.col("text").isNotNull()).withColumn("th", F.xxhash64("text"))
    wanted = involved.select(F.col("node"), F.col("first.doc_id").alias("i"), F.col("first.th").alias("h"), "n")
    texts = once.join(wanted, once["doc_id"].eqNullSafe(wanted["i"]) & (once["th"] == wanted["h"])).groupBy("node").agg(F.first("n").alias("n"), F.min("text").alias("text"))
    texts = written(texts)

    # every probe meets its group's anchor
    anchors = rows.groupBy("sig").agg(F.max(F.struct("weight", "node", "able")).alias("x")).select("sig", F.col("x.node").alias("b"), F.col("x.able").alias("able_b"))
    stars = rows.filter("probe").select("sig", F.col("node").alias("a"), "able").join(anchors, "sig")
    stars = written(stars.filter("a <> b AND (able OR able_b)").select("a", "b").distinct())
    links = written(verified(stars, texts, width, percent))
    comp = components(links)

    # pairs of different components: the sets whose segments other components have too, by their tokens
    own = rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = own.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("sig")
    own = written(own.join(mixed, "sig", "left_semi"))
    # own segments in which a set of another component may agree: those met here, and those that went because nobody probes them
    stay = rows.filter("own").groupBy("node").agg(F.count("*").alias("stay"))
    met = own.filter("own").groupBy("node").agg(F.count("*").alias("k"), F.first("spare").alias("spare"), F.first("owned").alias("owned"))
    able = met.join(stay, "node").filter("k + owned - stay > spare").select("node")
    asked = own.filter("probe").join(able, "node", "left_semi").select("sig").distinct()
    open_ = written(own.join(asked, "sig", "left_semi").select("node", "comp").distinct())
    left = written(texts.join(open_, "node").select("node", "comp", "n", "text"))
    cross = cross_candidates(left, width, percent)
    # a pair that failed already is not verified again
    cross = cross.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    more = verified(cross, texts, width, percent)
    comp = components(links.union(more))

    named = nodes.join(comp, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp").select("node", "comp", "component_id")
    out = sets.join(named, (sets["node"] == named["node"]) & (sets["n"] > 0), "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "comp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 4-grams of words, 85 in 100."""
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")
