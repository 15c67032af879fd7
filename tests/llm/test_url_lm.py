import math
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkpanel.llm import url_lm as U


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host):]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = (None, None)
    for kind, text in U.RULES:
        domain, start = text[:text.index("/")], text[text.index("/"):]
        if (host == domain or host.endswith("." + domain)) and path.startswith(start) and len(text) > len(best[0] or ""):
            best = (text, kind)
    return best


URLS = ["http://a.Example.ORG/es/1", "https://example.org/en/12?x", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/9#a",
        "http://x.com/de/", "http://x.com/frx", "http://org/", "http://org", "http://q.net/fr/?y=/de/", "nothing", None, "", "://", "a://b://c/d",
        "http://exÄmple.com/fr/", "http://x.com:80/fr/", "http://x.org?/es/", "http://" + "y" * 5000 + ".net/z", "http://x.com/fr/9#a"]


def test_host_path_rule(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, Host string, rule string")
    rows = {r.page_id: r for r in U.filter_urls(df).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split(u)
        assert (rows[i].host, rows[i].path) == (host, path)
        text, kind = rule(host, path)
        assert rows[i].rule == text and (kind is None or rows[i].verdict == kind)
        if not host and not path and (u is None or "://" not in u):
            assert rows[i].verdict == "allow"
    assert U.filter_urls(df.limit(0)).count() == 0


def plain_raw(train, url, order):
    """The models written with dictionaries (no context is pruned)."""
    total = 0.0
    for cls, sign in ((0, 1), (1, -1)):
        seen = defaultdict(Counter)
        for c, u in train:
            if c == cls:
                for i, ch in enumerate(u):
                    for k in range(order + 1):
                        seen[(k, ("^" * k + u[:i])[-k:] if k else "")][ch] += 1
        for i, ch in enumerate(url):
            p = 1 / (len(U.SYMBOLS) + 1)
            for k in range(order + 1):
                ctx = seen.get((k, ("^" * k + url[:i])[-k:] if k else ""))
                if ctx:
                    n, t = sum(ctx.values()), len(ctx)
                    p = (ctx[ch] + t * p) / (n + t)
            total += sign * math.log(p)
    return total / max(1, len(url))


def test_scores_equal_brute_force(spark):
    train = [(0, "abc.org/x"), (0, "abd.org/yy"), (1, "zz.com/de/1"), (1, "zq.com/de/22"), (0, "abc.org/x")]
    model = U.train(spark.createDataFrame(train, "cls int, body string"), order=3)
    for url in ["abc.org/z", "zz.com/de/9", "", "q"]:
        assert model.raw(pa.array([url]))[0] == pytest.approx(plain_raw(train, url, 3), abs=1e-12)


def test_bound_on_contexts_and_learning(spark):
    rows = [(i, f"http://h{i % 50}.{'org' if i % 2 else 'com/de'}/{'good' if i % 2 else 'bad'}/{i}") for i in range(600)]
    rows += [(1000 + i, f"http://k{i}.net/{'good' if i % 2 else 'bad'}/{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for most in (U.MAX_CONTEXTS, 60):
        got = {r.page_id: r.verdict for r in U.filter_urls(df, max_contexts=most).filter("page_id >= 1000").collect()}
        assert sum(v == ("allow" if i % 2 else "block") for i, v in got.items()) >= 97
    assert len(U.train(df.select(F.lit(0).alias("cls"), F.col("url").alias("body")), max_contexts=60).contexts[0]) == 60


def test_contexts_beyond_the_bound_count(spark):
    """Scores are those of all counted contexts, however few are broadcast."""
    rows = [(i, f"http://h{i % 50}.{'org' if i % 2 else 'com/de'}/{'good' if i % 2 else 'bad'}/{i}") for i in range(300)]
    rows += [(1000, "http://k.net/good/7"), (1001, "http://k.net/bad/8"), (1002, None), (1003, "http://h1.com/de/x/never")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    body = lambda u: u.split("://", 1)[1]
    train = [(0 if i % 2 else 1, body(u)) for i, u in rows[:300] if zlib.crc32(body(u).encode()) % 5]
    train += [(1, body(rows[-1][1]))] * (zlib.crc32(body(rows[-1][1]).encode()) % 5 > 0)
    got = {r.page_id: r.raw for r in U.filter_urls(df, max_contexts=40).collect()}
    assert len(got) == len(rows)
    for i, u in [*rows[:4], *rows[300:]]:
        assert got[i] == pytest.approx(plain_raw(train, body(u) if u else "", U.ORDER), abs=1e-9)
