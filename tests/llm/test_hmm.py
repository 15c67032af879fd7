import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkpanel.llm import hmm as H
from sparkpanel.llm.common import written

SF = "/root/testdata/sf0.01"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def base(rows):
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for t in train for w in words(t))
    count[None] = len(train)
    n, v = sum(count.values()), sum(c > 0 for c in count.values())
    out = []
    for i, t in rows:
        toks = [*words(t), None]
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(toks), sum(count[w] > 0 for w in toks), n,
                    sum(math.log10((count[w] + .1) / (n + .1 * (v + 1))) for w in toks)))
    return out


def test_base_score_and_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {r[0]: r for r in base([tuple(r) for r in docs.collect()])}
    rows = H.query(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:5]
        assert r.base_score == pytest.approx(want[r.doc_id][5], rel=1e-9)
    held = [r for r in rows if r.held_out]
    per = lambda x: sum(getattr(r, x) for r in held) / sum(r.n_tokens for r in held)
    assert per("score") > per("base_score") + 0.05          # log10 a token, on texts never seen


@pytest.mark.parametrize("heavy", [1000, 5])
def test_score_equals_plain_forward(spark, docs_of, heavy):
    rows = [(i, " ".join(f"{'ab'[(i + j) % 2]}{(i * j) % 11}" for j in range(i % 17))) for i in range(60)] + [(70, "Never-seen A1 b2"), (71, None), (None, "a1 b2"), (5, "")]
    df = docs_of([(i, t, 1.0) for i, t in rows], ", score double")
    train = df.filter(~H.held_out(df["doc_id"])).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = written(H.count_tokens(train))
    vocab = H.vocabulary(counts, 4, heavy)
    shared = spark.sparkContext.broadcast(vocab)
    t = H.first_tables(vocab, 3)
    for _ in range(2):
        t = H.train_round(train, shared, t)
    got = H.score_texts(df.withColumn("text", F.coalesce("text", F.lit(""))), counts, shared, t).collect()
    assert len(got) == len(rows)
    # the same by explicit sums over words and classes
    table = {r.tok: (r.shape, r.c) for r in counts.collect()}
    own = vocab.classes - H.SHAPES - 1
    shape_of = lambda tok, shape: own + shape
    in_class = Counter()
    frequent = {int(k): int(c) for k, c in zip(vocab.tok, vocab.cls) if c >= 0}
    for tok, (shape, c) in table.items():
        if tok not in frequent and tok != int(H.END):
            in_class[shape, "c"] += c
            in_class[shape, "n"] += 1
    for r in got:
        toks, shapes, _ = H.tokens_of(pa.array([r_text(rows, r)]))
        alpha, total = t.start, 0.0
        for j, (tok, shape) in enumerate(zip(toks.tolist(), shapes.tolist())):
            cls = own + H.SHAPES if tok == int(H.END) else frequent.get(tok, shape_of(tok, shape))
            alpha = (alpha if j == 0 else alpha @ t.move) * t.emit[cls]
            if tok != int(H.END) and tok not in frequent:
                total += math.log10((table.get(tok, (0, 0))[1] + .1) / (in_class[shape, "c"] + .1 * (in_class[shape, "n"] + 1)))
        assert r.score == pytest.approx(total + math.log10(alpha.sum()), rel=1e-9)
    assert np.allclose(t.emit.sum(0), 1) and np.allclose(t.move.sum(1), 1)


def r_text(rows, r):
    # rows with one id have texts of different lengths in the fixture
    return next(t or "" for i, t in rows if i == r.doc_id and len(words(t)) + 1 == r.n_tokens)


def test_baum_welch_counts_equal_plain_sums_and_raise_the_likelihood():
    rng = np.random.default_rng(1)
    vocab = H.Vocab(np.arange(6), np.ones(6, np.int64), np.arange(6), 6, 6, np.zeros(H.SHAPES), np.full(6, 1 / 6))
    t = H.first_tables(vocab, 2)
    seqs = [rng.integers(0, 6, n) for n in (1, 2, 5, 9, 0)]
    seq, off = np.concatenate(seqs), np.append(0, np.cumsum([len(s) for s in seqs]))
    start, move, emit, ll = H.expected_counts(seq, off, t, segment=100)
    s2, m2, e2, l2 = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 6)), 0.0
    for s in seqs:
        if not len(s):
            continue
        a = [t.start * t.emit[s[0]]]
        for x in s[1:]:
            a.append((a[-1] @ t.move) * t.emit[x])
        b = [np.ones(2)]
        for x in s[:0:-1]:
            b.insert(0, t.move @ (t.emit[x] * b[0]))
        p = a[-1].sum()
        l2 += math.log(p)
        for j, x in enumerate(s):
            g = a[j] * b[j] / p
            e2[:, x] += g
            s2 += g if j == 0 else 0
            if j:
                m2 += np.outer(a[j - 1], t.emit[x] * b[j]) * t.move / p
    for x, y in ((start, s2), (move, m2), (emit, e2), (ll, l2)):
        assert np.allclose(x, y, rtol=1e-4, atol=1e-5)
    last = -np.inf
    for _ in range(6):
        s, m, e, ll = H.expected_counts(seq, off, t, 100)
        assert ll >= last - 0.2
        last, t = ll, H.next_tables(s, m, e, vocab)


def test_edges(spark, docs_of):
    rows = [(1, "a b a"), (2, None), (3, ""), (None, "a"), (1, "a b a"), (4, "x " * 50_000)]
    df = docs_of([(i, t, 1) for i, t in rows], ", train_tokens int")
    got = H.score_documents(df).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.train_tokens) for r in got) == sorted((str(i), len(words(t)) + 1, base(rows)[0][4]) for i, t in rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert H.score_documents(df.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (alone,) = H.score_documents(docs_of([(held, "a b")])).collect()
    assert alone.held_out and alone.train_tokens == 0 and alone.base_score == 0 and alone.n_known == 0


def test_training_reads_all_texts_until_the_likelihood_stops_rising(spark, docs_of, monkeypatch):
    """Every round covers each training text, and a further round gains next to nothing."""
    rows = [(i, " ".join(f"{'ab'[(i + j) % 2]}{(i * j) % 7}" for j in range(3 + i % 9))) for i in range(900)]
    df = docs_of(rows)
    rounds, one = [], H.train_round

    def watched(texts, vocab, t):
        rounds.append((texts.count(), one(texts, vocab, t)))
        return rounds[-1][1]

    monkeypatch.setattr(H, "train_round", watched)
    scored = H.score_documents(df)
    train = [r for r in scored.select("held_out").collect() if not r.held_out]
    assert len(train) > 600 and {n for n, _ in rounds} == {len(train)}
    gains = [(b.log_like - a.log_like) / abs(b.log_like) for (_, a), (_, b) in zip(rounds, rounds[1:])]
    assert gains[-1] <= H.RISE and all(g > H.RISE for g in gains[:-1])


def test_cut_texts_give_the_counts_of_whole_ones():
    """Pieces with what enters and leaves them against one uncut run, in training and scoring."""
    rng = np.random.default_rng(7)
    vocab = H.Vocab(np.arange(9), np.ones(9, np.int64), np.arange(9), 9, 9, np.zeros(H.SHAPES), np.full(9, 1 / 9))
    t = H.first_tables(vocab, 3)
    sizes = [1, 7, 8, 9, 16, 17, 250, 0, 3]
    seq, off = rng.integers(0, 9, sum(sizes)), np.append(0, np.cumsum(sizes))
    whole = H.expected_counts(seq, off, t, segment=1000)
    for n in (1, 3, 8):
        for x, y in zip(H.expected_counts(seq, off, t, segment=n), whole):
            assert np.allclose(x, y, rtol=2e-4, atol=2e-4)
        assert np.allclose(H.forward_log10(seq, off, t, whole=n, segment=n), H.forward_log10(seq, off, t, whole=1000), rtol=1e-12)
    assert whole[0].sum() == pytest.approx(8, rel=1e-5) and whole[1].sum() == pytest.approx(sum(sizes) - 8, rel=1e-5) and whole[2].sum() == pytest.approx(sum(sizes), rel=1e-5)


def test_leaps_reach_a_likelihood_that_plain_rounds_take_longer_for():
    rng = np.random.default_rng(2)
    seq = np.concatenate([np.repeat(rng.integers(0, 3, 40), 5) * 3 + rng.integers(0, 3, 200) for _ in range(20)])
    off = np.arange(0, 4001, 200)
    vocab = H.Vocab(np.arange(9), np.ones(9, np.int64), np.arange(9), 9, 9, np.zeros(H.SHAPES), np.full(9, 1 / 9))

    def one(t):
        s, m, e, ll = H.expected_counts(seq, off, t)
        new = H.next_tables(s, m, e, vocab)
        new.log_like = ll
        return new

    t = H.first_tables(vocab, 3)
    plain = [t]
    for _ in range(6):
        plain.append(one(plain[-1]))
    jumped = H.leap(*plain[1:4])
    assert np.allclose(jumped.emit.sum(0), 1) and np.allclose(jumped.move.sum(1), 1) and (jumped.emit > 0).all()
    assert one(jumped).log_like > plain[4].log_like          # ahead of the round that it replaces


def test_clashing_names(docs_of):
    df = docs_of([(1, "a b", 1, 2, 3, 4), (2, None, 1, 2, 3, 4)], ", model int, base int, toks int, Score int")
    got = H.score_documents(df)
    assert sorted(got.columns) == sorted(["doc_id", "model", "base", "toks", "held_out", "n_tokens", "n_known", "base_score", "score", "train_tokens"])
    assert {(r.model, r.base, r.toks) for r in got.collect()} == {(1, 2, 3)}
