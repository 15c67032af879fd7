"""URL filter by a character language-model ratio (operator 1).

Prefix rules decide the URLs they fit; the longest fitting rule wins.  The
other URLs are judged by two variable-order Markov models of characters, one
trained on the URLs that rules allow and one on those that rules block:

* counts of (context, character) for contexts of 0 to ``ORDER`` characters,
  pre-aggregated inside each task before one shuffle;
* all counted contexts stay in a written table.  Per class the ``MAX_CONTEXTS``
  most frequent ones (ties by order and context) go to all tasks; the others
  meet the slices of 2,048 URLs that ask for them in a shuffle join, so
  a frequent context is never a hot key, and the score does not depend on the
  bound;
* Witten-Bell interpolation: a context seen ``n`` times with ``t`` different
  characters gives its shorter context the weight ``t / (n + t)``; the
  shortest one falls back on a uniform character.

A URL's raw score is (log P accepted - log P rejected) / length over what
follows ``://``, lower-cased.  Every fifth URL that a rule decides (by a hash
of the URL) is held out of training; a logistic curve with equal class weights
is fitted to their raw scores, which are aggregated to a histogram of fixed
bins.  The calibrated score is the probability that a URL is acceptable, and
URLs below ``accept`` are blocked.

Defined results: a null URL or one without ``://`` has empty host and path, no
rule, raw score 0 and the verdict ``allow``; so has every URL without a rule
where one of the classes has no URL to learn from.  Repeated rows are judged
alike (and counted each in training); further columns pass through, those named
like an output are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.llm.common import largest, table, text_bytes, text_slices, written

#: (verdict, rule) of the registered query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

ORDER = 5              # longest context
MAX_CONTEXTS = 20_000  # contexts a class that are broadcast
SLICE_ROWS_LOG2 = 11   # URLs that ask for the other contexts together: 2,048
BINS = 400             # of the calibration histogram
RAW_LIMIT = 4.0        # raw scores beyond +-4 nats a character fall in the outer bins
#: Symbols of the models: letters, digits and frequent marks have their own, every other byte shares one.
SYMBOLS = b"abcdefghijklmnopqrstuvwxyz0123456789./-_?=&#%:~+,;@!"
WIDTH = 64             # symbols fit in 6 bits
START = 63             # stands before the first character


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _codes() -> np.ndarray:
    lut = np.full(256, len(SYMBOLS), np.uint64)
    for i, c in enumerate(SYMBOLS):
        lut[c] = i
    lut[65:91] = lut[97:123]
    return lut


def _contexts(urls: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Symbols of all URLs one after the other, for each order the context key of each symbol, and the offsets.

    A key packs the context's symbols, 6 bits each, under a leading 1 bit.
    """
    data, off = text_bytes(urls)
    sym = _codes()[data]
    place = np.arange(len(sym)) - np.repeat(off[:-1], np.diff(off))
    keys, key = [], np.zeros(len(sym), np.uint64)
    for k in range(order + 1):
        keys.append(key | np.uint64(1 << 6 * k))
        before = np.full(len(sym), START, np.uint64)
        if len(sym) > k + 1:
            before[k + 1:] = sym[:-(k + 1)]
        before[place <= k] = START
        key = key | before << np.uint64(6 * k)
    return sym, keys, off


@dataclass
class Model:
    """Per class: sorted context keys with n and t, and sorted (context, symbol) keys with their counts."""

    contexts: list[np.ndarray]
    seen: list[np.ndarray]
    kinds: list[np.ndarray]
    pairs: list[np.ndarray]
    counts: list[np.ndarray]
    order: int
    a: float = 1.0   # calibration: logit = a * raw + b
    b: float = 0.0

    def log_prob(self, cls: int, sym: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """log P of each symbol given what precedes it."""
        p = np.full(len(sym), 1 / (len(SYMBOLS) + 1))
        ctx, pairs = self.contexts[cls], self.pairs[cls]
        for key in keys:
            if not len(ctx):
                break
            i = np.minimum(np.searchsorted(ctx, key), len(ctx) - 1)
            known = ctx[i] == key
            pair = key << np.uint64(6) | sym
            j = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            c = np.where(pairs[j] == pair, self.counts[cls][j], 0)
            n, t = self.seen[cls][i], self.kinds[cls][i]
            p = np.where(known, (c + t * p) / (n + t), p)
        return np.log(p)

    def raw(self, urls: pa.Array) -> np.ndarray:
        """Length-normalised log-likelihood difference; 0 for an empty string."""
        sym, keys, off = _contexts(urls, self.order)
        if not len(self.contexts[0]) or not len(self.contexts[1]):
            return np.zeros(len(urls))
        diff = np.append(0, np.cumsum(self.log_prob(0, sym, keys) - self.log_prob(1, sym, keys)))
        return (diff[off[1:]] - diff[off[:-1]]) / np.maximum(np.diff(off), 1)

    def lacks(self, key: np.ndarray) -> np.ndarray:
        """Contexts that one of the classes does not have here."""
        return ~(np.isin(key, self.contexts[0]) & np.isin(key, self.contexts[1]))

    def extended(self, rest: pa.Table) -> Model:
        """This model and the contexts of ``rest`` (ctx, sym, and for each class the context's n and t and the pair's count c)."""
        ctx, sym = (rest.column(c).to_numpy().astype(np.uint64) for c in ("ctx", "sym"))
        out = Model([], [], [], [], [], self.order)
        for cls in (0, 1):
            n, t, c = (rest.column(f"{x}{cls}").to_numpy().astype(float) for x in "ntc")
            new = (n > 0) & ~np.isin(ctx, self.contexts[cls])
            key, at = np.unique(ctx[new], return_index=True)
            contexts = np.concatenate((self.contexts[cls], key))
            by = np.argsort(contexts)
            out.contexts.append(contexts[by])
            out.seen.append(np.concatenate((self.seen[cls], n[new][at]))[by])
            out.kinds.append(np.concatenate((self.kinds[cls], t[new][at]))[by])
            both = new & (c > 0)
            pairs = np.concatenate((self.pairs[cls], ctx[both] << np.uint64(6) | sym[both]))
            by = np.argsort(pairs)
            out.pairs.append(pairs[by])
            out.counts.append(np.concatenate((self.counts[cls], c[both]))[by])
        return out


def count_contexts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """cls, ctx, sym, n over (cls int, body string): summed in each task, then by key."""

    def run(batches):
        for batch in batches:
            cls = np.asarray(batch.column("cls"))
            for a, b in text_slices(batch.column("body")):
                sym, keys, off = _contexts(batch.column("body").slice(a, b - a), order)
                row = np.repeat(cls[a:b], np.diff(off)).astype(np.uint64)
                for key in keys:
                    # 1 + 30 + 6 bits of key, one of class
                    packed, n = np.unique((key << np.uint64(6) | sym) << np.uint64(1) | row, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((packed & np.uint64(1)).astype(np.int32)), pa.array((packed >> np.uint64(7)).astype(np.int64)),
                                                      pa.array((packed >> np.uint64(1) & np.uint64(63)).astype(np.int32)), pa.array(n.astype(np.int64))],
                                                     names=["cls", "ctx", "sym", "n"])

    parts_ = labelled.select("cls", "body").mapInArrow(run, "cls int, ctx long, sym int, n long")
    return parts_.groupBy("cls", "ctx", "sym").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, order: int = ORDER, max_contexts: int = MAX_CONTEXTS) -> Model:
    """Models of the classes 0 (accepted) and 1 (rejected), with their most frequent contexts."""
    return most_frequent(written(count_contexts(labelled, order)), order, max_contexts)


def most_frequent(counts: DataFrame, order: int, max_contexts: int) -> Model:
    by_context = counts.groupBy("cls", "ctx").agg(F.sum("n").alias("seen"), F.count("*").alias("kinds"))
    out = Model([], [], [], [], [], order)
    for cls in (0, 1):
        top = largest(by_context.filter(F.col("cls") == cls), "seen", max_contexts, "ctx")
        kept = top.toPandas().sort_values("ctx")            # at most max_contexts rows
        pairs = counts.filter(F.col("cls") == cls).join(F.broadcast(top.select("ctx")), "ctx").toPandas()
        key = pairs["ctx"].to_numpy(np.uint64) << np.uint64(6) | pairs["sym"].to_numpy(np.uint64)
        at = np.argsort(key)
        out.contexts.append(kept["ctx"].to_numpy(np.uint64))
        out.seen.append(kept["seen"].to_numpy(float))
        out.kinds.append(kept["kinds"].to_numpy(float))
        out.pairs.append(key[at])
        out.counts.append(pairs["n"].to_numpy(float)[at])
    return out


def raw_scores(df: DataFrame, model: Model, counts: DataFrame, body: str = "body", name: str = "raw") -> DataFrame:
    """``df`` with the raw score of a string column; ``counts`` has all contexts, ``model`` the most frequent ones."""
    shared = df.sparkSession.sparkContext.broadcast(model)   # at most 2 * MAX_CONTEXTS contexts
    urls = written(df.withColumn("__slice", F.shiftright(F.monotonically_increasing_id(), SLICE_ROWS_LOG2)))

    def ask(batches):
        m = shared.value
        for batch in batches:
            of = np.asarray(batch.column("__slice"))
            for a, b in text_slices(batch.column("body")):
                sym, keys, off = _contexts(batch.column("body").slice(a, b - a), m.order)
                row = np.repeat(of[a:b], np.diff(off))
                for key in keys:
                    lacks = m.lacks(key)
                    for k in np.unique(row[lacks]):
                        pair = np.unique((key << np.uint64(6) | sym)[lacks & (row == k)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), k)), pa.array((pair >> np.uint64(6)).astype(np.int64)),
                                                          pa.array((pair & np.uint64(63)).astype(np.int32))], names=["__slice", "ctx", "sym"])

    asked = urls.select("__slice", F.col(body).alias("body")).mapInArrow(ask, "__slice long, ctx long, sym int").distinct()
    sums = [x for c in (0, 1) for x in (F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)).alias(f"n{c}"), F.count_if(F.col("cls") == c).alias(f"t{c}"))]
    table_ = counts.groupBy("ctx").agg(*sums, F.collect_list(F.struct("cls", F.col("sym").alias("s"), "n")).alias("pairs"))   # at most 2 * WIDTH pairs
    count = lambda c: F.coalesce(F.get(F.filter("pairs", lambda x: (x["cls"] == c) & (x["s"] == F.col("sym"))), F.lit(0))["n"], F.lit(0))
    rest = asked.join(table_, "ctx").select("__slice", "ctx", "sym", "n0", "t0", "n1", "t1", count(0).alias("c0"), count(1).alias("c1"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value.extended(right)
        arr = left.column(body).combine_chunks()
        raw = [m.raw(arr.slice(a, b - a)) for a, b in text_slices(arr)]
        return left.drop_columns(["__slice"]).append_column(name, pa.array(np.concatenate(raw) if raw else np.zeros(0)))

    schema = type(df.schema)(list(df.schema.fields)).add(name, "double")
    return urls.groupBy("__slice").cogroup(rest.groupBy("__slice")).applyInArrow(run, schema)


def calibrate(model: Model, held: DataFrame) -> Model:
    """Fit the logistic curve to held-out (cls, raw) rows through a histogram of fixed bins."""
    bin_ = F.floor((F.least(F.greatest(F.col("raw"), F.lit(-RAW_LIMIT)), F.lit(RAW_LIMIT)) + RAW_LIMIT) / (2 * RAW_LIMIT) * (BINS - 1) + 0.5)
    rows = held.groupBy("cls", bin_.cast("int").alias("bin")).count().collect()   # 2 * BINS at most
    hist = np.zeros((2, BINS))
    for r in rows:
        hist[r["cls"], r["bin"]] = r["count"]
    if (hist.sum(1) == 0).any():
        return model
    weight = (hist / hist.sum(1, keepdims=True) + 1e-4 / BINS).ravel()
    x = np.tile((np.arange(BINS) / (BINS - 1) * 2 - 1) * RAW_LIMIT, 2)
    y = np.repeat([1.0, 0.0], BINS)
    a, b = 1.0, 0.0
    for _ in range(100):                                     # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        grad = np.array([(weight * (p - y) * x).sum() + 1e-6 * a, (weight * (p - y)).sum()])
        s = weight * p * (1 - p)
        hess = np.array([[(s * x * x).sum() + 1e-6, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, np.abs(step).max() / 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.a, model.b = float(a), float(b)
    return model


def filter_urls(df: DataFrame, url_col: str = "url", rules=RULES, accept: float = 0.5, order: int = ORDER, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``df`` with host, path, rule, raw, p_accept and verdict."""
    new = ["host", "path", "rule", "raw", "p_accept", "verdict"]
    keep = [c for c in df.columns if c.lower() not in new]
    url = df[url_col].cast("string")
    host, path = parts(url)
    rule, kind = rule_of(F.col("host"), F.col("path"), rules)
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    body = F.when(has, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    judged = df.select(*(df[c] for c in keep), host.alias("host"), path.alias("path"), body.alias("__body"))
    judged = judged.withColumns({"rule": rule, "__kind": kind})
    fold = F.pmod(F.crc32("__body"), F.lit(5))
    labelled = judged.filter("__kind is not null").withColumn("cls", F.when(F.col("__kind") == "allow", 0).otherwise(1))
    counts = written(count_contexts(labelled.filter(fold != 0).select("cls", F.col("__body").alias("body")), order))
    model = most_frequent(counts, order, max_contexts)
    both = len(model.contexts[0]) and len(model.contexts[1])
    scored = written(raw_scores(judged, model, counts, "__body"))
    held = scored.filter(F.col("__kind").isNotNull() & (fold == 0)).select(F.when(F.col("__kind") == "allow", 0).otherwise(1).alias("cls"), "raw")
    model = calibrate(model, held)
    p = 1 / (1 + F.exp(-(F.lit(model.a) * F.col("raw") + F.lit(model.b)))) if both else F.lit(1.0)
    p = F.when(F.col("__body") == "", F.lit(1.0)).otherwise(p)
    verdict = F.coalesce("__kind", F.when(F.col("p_accept") < accept, "block").otherwise("allow"))
    return scored.withColumn("p_accept", p).withColumn("verdict", verdict).select(*keep, *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
