import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkpanel.llm import risk_rules as R


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_counts(spark, docs_of):
    random.seed(2)
    texts = ["".join(random.choice("ab \n#|é\t") for _ in range(random.randint(0, 400))) for _ in range(150)]
    texts += [None, "", " ", "a b c", "a b c a", "a b c a b c", "x " * 60_000, "é" * 70, "a\nb\na\n\n\nb\x0b\nb", "a b c \x1c d"]
    df = docs_of([(i, t, "z") for i, t in enumerate(texts)], ", base_failed string")
    for r in R.base_counts(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_binomial_tail(spark):
    cases = [(0, 1, .01), (0, 400, .01), (3, 400, .01), (10, 4000, .01), (1, 5, .05), (5, 5, .5), (400, 50_000, .01), (900, 100_000, .01)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for p in {c[2] for c in cases}:
        got = {(r.k, r.n): r.c for r in df.select("k", "n", R.binomial_cdf(F.col("k"), F.col("n"), p).alias("c")).collect()}
        for k, n, q in cases:
            if q == p and k <= n * p and k < n:
                exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
                assert got[k, n] == pytest.approx(exact, rel=1e-8)


def corpus(n=5000):
    random.seed(9)
    vocab = [f"w{i}" for i in range(3000)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        ws = [random.choice(vocab) + ("***" if bad and random.random() < .6 else "") for _ in range(60)]
        docs.append((i, " ".join(ws), "en" if i % 3 else None))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_risk_is_controlled_and_bad_texts_go(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels + [(None, 1), (1, None), (5, 1)], "doc_id long, quality int")
    rows = R.judge(d, lab).collect()
    assert len(rows) == len(docs)
    for lang in ("en", None):
        good = [r.kept for r in rows if r.lang == lang and r.doc_id % 4]
        bad = [r.kept for r in rows if r.lang == lang and r.doc_id % 4 == 0]
        assert sum(good) >= (1 - R.ALPHA) * len(good) and sum(bad) < .1 * len(bad)
    # too few labels, no labels, no documents: only the base rule decides
    for few in (lab.filter("doc_id < 40"), lab.limit(0)):
        assert all(r.kept == (not r.base_failed) for r in R.judge(d, few).collect())
    assert R.judge(d.limit(0), lab).count() == 0


def test_edges(spark):
    d = spark.createDataFrame([(1, None, None, 1), (None, "a " * 60, "en", 1), (2, " ".join(map(str, range(60))), "en", 1), (2, " ".join(map(str, range(60))), "en", 1)],
                              "doc_id long, text string, lang string, kept int")
    rows = R.judge(d, spark.createDataFrame([(2, 1)], "doc_id long, quality int")).collect()
    assert sorted((str(r.doc_id), r.base_failed, r.kept) for r in rows) == [("1", True, False), ("2", False, True), ("2", False, True), ("None", True, False)]
