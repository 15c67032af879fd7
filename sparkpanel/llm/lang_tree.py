"""Language identification by hierarchical discrimination (operator 10).

A text is first given a language family (one-versus-rest linear support vector
machines), then the languages of that family are told apart by one-versus-one
linear support vector machines whose votes are counted (ties go to the larger
sum of margins, then to the smaller name).

Features are counts of 1 to 3 successive bytes and of whole words of the
lower-cased text, where everything but letters is a gap, hashed to ``DIMS``
places, square-rooted and scaled to unit length.  They cover the whole text and
are computed in numpy inside ``mapInArrow``.  The machines (squared hinge loss)
are trained in Spark tasks, one a decision, on at most ``PER_LANG`` texts a
language, those of smallest hash (``FAMILY_ROWS`` over all languages for a
family's machine): the documented bound of the training sample.
Prediction reads no column but the text.

``score`` is the product of logistic confidences: the family's margin over the
next family, and the weakest of the language's pairwise margins.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text when nothing can be learned; with one language only it is
predicted with score 1; rows with a null language, text or id are not learned from;
repeated rows get the same answer; an empty table gives no rows; further
columns pass through, and those named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkpanel.llm.common import mix, table, text_bytes, text_slices, written

DIMS = 4_096
PER_LANG = 600
FAMILY_ROWS = 6_000    # rows of a family's decision, over all languages
DIGITS, FEW = 3, 5_000  # hexadecimal digits by which the sample's rows are counted; rows that are ranked beyond it
SLICE_BYTES = 1 << 19  # text whose features are made at once
STEPS = 200
RIDGE = 1e-4

#: Families of language codes; a code that is missing here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy".split(),
    "romance": "fr es pt it ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indo-aryan": "hi ur bn mr gu pa ne si".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh yue wuu".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"only:{lang}")


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-cased letters as they are, bytes over 127 as they are, all else 0."""
    lut = np.zeros(256, np.uint8)
    lut[97:123] = lut[65:91] = np.arange(97, 123)
    lut[128:] = np.arange(128, 256)
    return lut


def features(texts: pa.Array) -> np.ndarray:
    """One unit row of DIMS values for each text (zeros without letters)."""
    data, off = text_bytes(texts, " ")
    x = _letters()[data]
    if len(x) > 1:      # capitals of the Latin-1 block: C3 80-9E
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        x[1:][capital] += 0x20
    n, rows = len(x), len(texts)
    counts = np.zeros(rows * DIMS)
    if n:
        row = np.repeat(np.arange(rows) * DIMS, np.diff(off))
        wide = np.concatenate((x, np.zeros(2, np.uint8))).astype(np.uint64)
        one, two = wide[:n], wide[:n] | wide[1:n + 1] << np.uint64(8)
        three = two | wide[2:] << np.uint64(16)
        for key in (one, two | np.uint64(1 << 30), three | np.uint64(1 << 31)):
            keep = key & np.uint64(0xFFFFFF) != 0
            counts += np.bincount(row[keep] + (mix(key[keep]) & np.uint64(DIMS - 1)).astype(np.int64), minlength=rows * DIMS)
        inside = x != 0
        start = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        if len(start):
            at = np.flatnonzero(inside)
            first = np.searchsorted(at, start)
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
            word = np.add.reduceat(mix(one[at]) * power[place], first)
            counts += 2 * np.bincount(row[start] + (mix(word) & np.uint64(DIMS - 1)).astype(np.int64), minlength=rows * DIMS)
    out = np.sqrt(counts.reshape(rows, DIMS), dtype=np.float64).astype(np.float32)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights and bias of a linear machine (squared hinge, both classes weigh alike), by accelerated gradient."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1 / (2 * (weight * (x * x).sum(1)).sum() + ridge)
    w = before = np.zeros(x.shape[1])
    for t in range(steps):
        look = w + t / (t + 3) * (w - before)
        gap = np.maximum(0, 1 - y * (x @ look))
        before, w = w, look - rate * (ridge * look - 2 * x.T @ (weight * gap * y))
    return w


@dataclass
class Tree:
    """families: (name, weights); pairs: family -> [(language a, language b, weights)], a wins where the margin is positive."""

    langs: list[str]
    families: list[tuple[str, np.ndarray]] = field(default_factory=list)
    pairs: dict[str, list[tuple[str, str, np.ndarray]]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        sure = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -60, 60)))
        names = sorted({family_of(c) for c in self.langs})
        n = len(x)
        if len(names) > 1:
            by = dict(self.families)
            margin = np.stack([x @ by[f][:-1] + by[f][-1] for f in names], 1)
            best = margin.argmax(1)
            two = np.partition(margin, len(names) - 2, axis=1)[:, -2:]
            score = sure((two[:, 1] - two[:, 0]) / 2)
        else:
            best, score = np.zeros(n, int), np.ones(n)
        out = np.empty(n, object)
        for k, f in enumerate(names):
            at = np.flatnonzero(best == k)
            codes = sorted(c for c in self.langs if family_of(c) == f)
            if not len(at):
                continue
            votes, total = np.zeros((len(at), len(codes))), np.zeros((len(at), len(codes)))
            weakest = np.full((len(at), len(codes)), np.inf)
            for a, b, w in self.pairs.get(f, []):
                m = x[at] @ w[:-1] + w[-1]
                for c, s in ((codes.index(a), m), (codes.index(b), -m)):
                    votes[:, c] += s >= 0 if c == codes.index(a) else s > 0
                    total[:, c] += s
                    weakest[:, c] = np.minimum(weakest[:, c], s)
            top = votes == votes.max(1, keepdims=True)
            win = np.where(top, total, -np.inf).argmax(1)
            out[at] = np.array(codes, object)[win]
            if len(codes) > 1:
                score[at] *= sure(weakest[np.arange(len(at)), win])
        return out.tolist(), score


def order_key(*hashes: Column) -> Column:
    """Hexadecimal digits that sort like the 64-bit numbers, one after the other."""
    return F.concat(*[F.lpad(F.hex(h.bitwiseXOR(F.lit(-1 << 63))), 16, "0") for h in hashes])


def cut_off(known: DataFrame, per_lang: int, few: int = FEW) -> DataFrame:
    """The rows that hold a language's first ``per_lang`` ones in the order of the digits ``h``, and at most ``few`` more.

    Rows are counted by language and the first digits; the range in which the number is reached is counted by its next
    digits, until it is small.  So a language, or an id, of a third of all rows sends few rows to its ranking.
    """
    upto = Window.partitionBy("lang").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)       # 16 ** DIGITS ranges a language
    digits, last = 0, None
    while True:
        digits += DIGITS
        rows = known if last is None else known.join(last.withColumnRenamed("p", "of"), "lang").filter(F.col("h").startswith(F.col("of")))
        start = F.lit(0).cast("long") if last is None else F.first("before")
        bins = rows.groupBy("lang", F.substring("h", 1, digits).alias("p")).agg(F.count("*").alias("n"), start.alias("start"))
        bins = bins.withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
        last = written(bins.filter(F.col("before") < per_lang).groupBy("lang").agg(F.max(F.struct("p", "before", "n")).alias("x")).select("lang", "x.*"))
        if digits >= 30 or not last.filter(F.col("n") > few).limit(1).count():
            return known.join(last.select("lang", "p"), "lang").filter(F.substring("h", 1, digits) <= F.col("p")).drop("p")


def train(labelled: DataFrame, per_lang: int = PER_LANG) -> Tree:
    """A tree learned from (lang, text) rows with a ``key`` column that orders them for the sample."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("key").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    # the sample is drawn by key, language and a hash of the text; only then are its texts read.  Equal rows count once
    known = written(rows.select("lang", "key", F.xxhash64("text").alias("th")).distinct().withColumn("h", order_key(F.xxhash64("key"), F.col("th"))))
    picked = cut_off(known, per_lang).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "key"))).filter(F.col("n") <= per_lang)
    ids = picked.select("lang", "key", "th", "n")                       # at most per_lang a language
    sample = rows.withColumn("th", F.xxhash64("text")).join(F.broadcast(ids), ["lang", "key", "th"]).dropDuplicates(["lang", "n"]).select("lang", "text", "n")

    def vectors(batches):
        for batch in batches:
            for a, b in text_slices(batch.column("text"), SLICE_BYTES):
                x = features(batch.column("text").slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), batch.column("n").slice(a, b - a),
                                                  pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "n", "x"])

    made = written(sample.mapInArrow(vectors, "lang string, n int, x binary"))
    langs = sorted(r["lang"] for r in made.select("lang").distinct().collect())
    families = sorted({family_of(c) for c in langs})
    tasks = []          # (family, positive, negative): a language against another, or a family (negative null) against the rest
    if len(families) > 1:
        tasks += [(f, None, None) for f in families]
    tasks += [(family_of(a), a, b) for a in langs for b in langs if a < b and family_of(a) == family_of(b)]
    tree = Tree(langs, pairs={f: [] for f in families})
    if not tasks:
        return tree
    # each row goes to the decisions that its language takes part in
    share = max(1, FAMILY_ROWS // len(langs))
    job = lambda i, c: F.struct(F.lit(i).alias("task"), F.lit(c).alias("y"))
    of_lang = [F.lit(v) if isinstance(v, str) else v for c in langs for v in (c, F.array(
        *[job(i, 1.0 if (family_of(c) == f if a is None else c == a) else -1.0)
          for i, (f, a, b) in enumerate(tasks) if a is None or c in (a, b)]))]
    jobs = made.select("x", "n", F.explode(F.create_map(*of_lang)[F.col("lang")]).alias("job")).select("x", "n", "job.*")
    wide = [i for i, t in enumerate(tasks) if t[1] is None]
    jobs = jobs.filter(~F.col("task").isin(wide) | (F.col("n") <= share)) if wide else jobs

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        x = np.stack([np.frombuffer(v, np.float32) for v in pdf["x"]])
        return pd.DataFrame({"task": pdf["task"].iloc[:1], "w": [fit_svm(x, pdf["y"].to_numpy()).tobytes()]})

    found = jobs.groupBy("task").applyInPandas(fit, "task int, w binary").collect()     # DIMS + 1 numbers a decision
    for r in sorted(found, key=lambda r: r["task"]):
        f, a, b = tasks[r["task"]]
        w = np.frombuffer(r["w"], np.float64)
        if a is None:
            tree.families.append((f, w))
        else:
            tree.pairs[f].append((a, b, w))
    return tree


def predict(df: DataFrame, tree: Tree, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score."""
    keep = [f for f in df.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    names = [f.name for f in keep]
    shared = df.sparkSession.sparkContext.broadcast(tree)      # DIMS + 1 numbers a decision

    def run(batches):
        for batch in batches:
            texts, known = batch.column("__text"), np.asarray(batch.column("__known"))
            for a, b in text_slices(texts, SLICE_BYTES):
                lang, score = ["und"] * (b - a), np.zeros(b - a)
                at = np.flatnonzero(known[a:b])
                if len(at) and shared.value.langs:
                    got, score[at] = shared.value.predict(features(texts.slice(a, b - a).take(pa.array(at))))
                    for i, c in zip(at.tolist(), got):
                        lang[i] = c
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), pa.array(lang), pa.array(np.round(score, 6))], names=[*names, "lang_pred", "score"])

    text = df[text_col].cast("string")
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    schema = type(df.schema)(keep).add("lang_pred", "string").add("score", "double")
    return df.select(*(df[c] for c in names), text.alias("__text"), known.alias("__known")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is not learned from: crc32 of the id's text modulo 3 is 1.  A null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def tree_of(docs: DataFrame, per_lang: int = PER_LANG) -> Tree:
    """The tree learned from the fold of ``docs`` that is not held out."""
    known = docs.select("lang", "text", F.col("doc_id").alias("key"), held_out(docs["doc_id"]).alias("held"))
    return train(known.filter("not held").drop("held"), per_lang)


def least_score(docs: DataFrame, tree: Tree, keep: float) -> float | None:
    """The score that a share ``keep`` of the held-out texts reach whose language is predicted right.  None without such texts."""
    held = docs.filter(held_out(docs["doc_id"]) & F.col("lang").isNotNull()).select("lang", "text")
    right = predict(held, tree).filter(F.col("lang") == F.col("lang_pred"))
    return right.agg(F.percentile_approx("score", 1 - keep, 100_000)).first()[0]


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with held_out, lang_pred and score."""
    return predict(docs.withColumn("held_out", held_out(docs["doc_id"])), tree_of(docs, per_lang))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
