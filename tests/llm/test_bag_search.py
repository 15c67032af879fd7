import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from sparkpanel.llm import bag_search as B

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    once = {}
    for i, t in items:
        if i is not None:
            once[i] = min((x for x in (once.get(i), t) if x is not None), default=None)
    out = []
    for item, text in once.items():
        found = []
        for i, b in bags:
            size = sum(b.values())
            m = size and 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r + 1, x[2], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 1, "h") for r in docs], "doc_id long, text string, n int, h string").repartition(5)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in B.rank(d, i, **more).collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["Ab", "b7", "ç", "über", "ÀB", "x", "the", "日本", "z9", "q", "w", "ee"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "\x00", "_", ", "]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 30))) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(60)]                      # a third are copies
    docs += [(300, None), (301, ""), (302, "-- ,"), (None, docs[3][1]), (None, docs[3][1]), (5, docs[5][1]), (303, text(20_000)), (304, "x " * 300), (305, "nothing of it")]
    items = [(i, text(rng.randint(1, 8))) for i in range(12)]
    items += [(50, docs[3][1]), (51, None), (52, "absent"), (None, "the"), (3, "the"), (53, "x x x"), (54, docs[3][1].upper())]
    want = brute(docs, items, 4)
    assert len({r[0] for r in want}) > 10
    assert run(spark, docs, items, k=4) == want
    assert run(spark, docs, items, k=4, block_terms=9) == want
    assert run(spark, docs, items, k=100) == brute(docs, items, 100)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None)], [(1, "a")]) == []
    assert run(spark, [(1, "a"), (2, "b b"), (3, "c")], [(1, "A"), (2, None)]) == brute([(1, "a"), (2, "b b"), (3, "c")], [(1, "A"), (2, None)], 10)


def test_vectors_round_trip():
    rng = np.random.default_rng(1)
    for most in (50, 300, 100_000):
        t = np.unique(rng.integers(0, most, 40))
        tf = rng.integers(1, most, len(t))
        assert all((a == b).all() for a, b in zip(B.decode(B.encode(t, tf)), (t, tf)))


def test_terms_are_those_of_the_pattern():
    texts = ["Aa-bB_9", "", None, "é\x7fé", " x" * 50, "a" * 9000 + "\n" + "A" * 9000]
    h, off = B.term_hashes(pa.array(texts))
    assert np.diff(off).tolist() == [len(terms(t)) for t in texts]
    assert h[-1] == h[-2] and len(set(h[:3].tolist())) == 3
