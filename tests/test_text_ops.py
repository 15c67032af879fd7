"""Label parsing, flags, frequencies, evaluation and sampling edge rows (FIXTURES §3.1, §5)."""

import pytest
from pyspark.sql import functions as F

from sparkpanel.functions import labels as L
from sparkpanel.functions import numeric as N
from sparkpanel.functions import text as X
from sparkpanel.operators import evaluate as V
from sparkpanel.operators import frequency, labelling, reshape, sampling
from sparkpanel.plans import text_queries as TQ
from tests.conftest import SF001, SF01


def test_topic_frequency_golden(spark):
    got = {sf: [r["n"] for r in TQ.q_topic_frequency(spark, sf).orderBy("position").collect()]
           for sf in (SF001, SF01)}
    assert got[SF001] == [87, 89, 74, 109, 3, 40, 59, 105, 77, 22, 142, 87, 82, 68, 87, 93, 71, 75, 84, 8]
    assert got[SF01] == [446, 436, 367, 529, 39, 246, 333, 531, 429, 115, 744, 405, 390, 383, 436, 424, 363,
                         402, 423, 19]


def test_entry_matches_flagship(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["position", "topic", "n"]
    assert df.count() == 20
    assert set(E.oracle_sql()) <= set(E.queries())


def test_parse_list_cases(spark):
    rows = ["['a', 'b']", "[\"women's\", 'x']", "nan", None, "[]", "'a'", "['a'"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = [r[0] for r in df.select(L.parse_list(F.col("s"))).collect()]
    assert got == [["a", "b"], ["women's", "x"], [], [], [], [], []]


def test_decode_reply_cases(spark):
    rows = ['{"topics":["a"]}', '{"topics":"x"}', "{bad", '{"t":1}', None]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    out = df.select(L.decode_reply(F.col("r")).alias("d")).select("d.status", "d.topics_json").collect()
    assert [o[0] for o in out] == ["ok", "not_list", "bad_json", "no_topics_key", "no_call"]
    parsed = df.select(L.parse_list(L.decode_reply(F.col("r"))["topics_json"])).collect()
    assert parsed[0][0] == ["a"] and parsed[1][0] == [] and parsed[4][0] == ["No topic"]


def test_clean_topics_sentinel(spark):
    rows = [(["no topic", "taxation"],), (["no topic"],), (["No topic", "taxation"],), (["no topic", "no topic"],)]
    df = spark.createDataFrame(rows, "a array<string>")
    got = [r[0] for r in df.select(L.clean_topics(F.col("a"))).collect()]
    assert got == [["taxation"], ["no topic"], ["No topic", "taxation"], []]


def test_invalid_topics_and_int_vector(spark):
    df = spark.createDataFrame([(["taxation", "made up", "No topic"], "[0, 1,0 ]")], "a array<string>, v string")
    r = df.select(L.invalid_topics(F.col("a")), L.parse_int_array(F.col("v"))).first()
    assert r[0] == ["made up", "No topic"] and r[1] == [0, 1, 0]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([([0.5, 0.5000001, 0.2],)], "p array<double>")
    assert df.select(N.binarize(F.col("p"))).first()[0] == [0, 1, 0]


def test_one_class_confusion(spark):
    long = spark.createDataFrame([(i, "t", 0, 0) for i in range(5)], "id int, topic string, actual int, predicted int")
    cells = {(r.actual, r.predicted): r.n for r in V.confusion(V.counts(long)).collect()}
    assert cells == {(0, 0): 5, (0, 1): 0, (1, 0): 0, (1, 1): 0}
    m = V.topic_metrics(V.counts(long)).first()
    assert (m.precision, m.recall, m.f1, m.accuracy, m.support) == (0.0, 0.0, 0.0, 1.0, 0)


def test_micro_f1_identity(spark):
    m = V.micro_metrics(V.counts(TQ.gold_long(spark, SF01))).first()
    assert m == V.micro_metrics(TQ.gold_counts(spark, SF01)).first()
    assert m.f1 == pytest.approx(2 * m.precision * m.recall / (m.precision + m.recall))


def test_find_pairs_missing_partner():
    with pytest.raises(ValueError):
        reshape.find_pairs(["a_human", "b_human", "a_bert"])


def test_unpack_length_check(spark):
    df = spark.createDataFrame([([1, 0],)], "a array<int>")
    with pytest.raises(Exception):
        reshape.unpack(df, "a", ["x", "y", "z"]).collect()


def test_sample_errors_and_split_sizes(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        sampling.sample_n(df, 11, 42, "k")
    assert sampling.sample_n(df, 4, 42, "k").count() == 4
    for n, expect in ((10, 2), (11, 3)):
        s = sampling.split(spark.range(n).withColumnRenamed("id", "k"), 0.2, 42, "k")
        counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
        assert counts["test"] == expect and counts["train"] == n - expect


def test_sample_per_topic_bounds(spark):
    flags = TQ.document_flags(spark, SF01)
    s = sampling.sample_per_topic(flags, "doc_id", L.TOPIC_COLUMNS, 15, 42)
    per = {r.topic: r["count"] for r in s.groupBy("topic").count().collect()}
    assert set(per) == set(L.TOPIC_COLUMNS) and max(per.values()) == 15


def test_encode_pads_and_truncates(spark):
    df = spark.createDataFrame([("Hello, World 42",), ("a " * 200,)], "t string")
    rows = df.select(X.encode(F.col("t"), 5).alias("e")).collect()
    assert rows[0].e.tokens == ["hello", "world", "42", "[PAD]", "[PAD]"] and rows[0].e.mask == [1, 1, 1, 0, 0]
    assert rows[1].e.n_tokens == 200 and rows[1].e.truncated


def test_label_texts_custom_labeller_and_errors(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "id long, text string").coalesce(1)

    def labeller(texts):
        if any(t.endswith("7") for t in texts):
            raise RuntimeError("remote failure")
        return [{"reply": '{"topics": ["taxation", "no topic"]}', "prompt_tokens": 10, "completion_tokens": 2}
                for _ in texts]

    out = labelling.label_texts(df, "text", labeller, batch_size=4)
    cleaned = labelling.clean_labels(out)
    ok, bad = labelling.split_rejects(cleaned)
    assert ok.count() == 9 and [r.text for r in bad.collect()] == ["text 7"]     # the rest of its batch is kept
    assert {tuple(r.topics) for r in ok.select("topics").collect()} == {("taxation",)}
    tot = labelling.usage_totals(ok).first()
    assert (tot.n_rows, tot.prompt_tokens, tot.completion_tokens, tot.total_tokens) == (9, 90, 18, 108)


def test_dummies_string_and_array_agree(spark):
    df = spark.createDataFrame([(["taxation", "civil rights"], '["taxation", "civil rights"]')],
                               "a array<string>, s string")
    a = labelling.to_dummies(df, "a").first()
    s = labelling.to_dummies(df, "s", as_string=True).first()
    assert [a[c] for c in L.TOPIC_COLUMNS] == [s[c] for c in L.TOPIC_COLUMNS]
    assert a["taxation"] == 1 and a["civil_rights"] == 1 and sum(a[c] for c in L.TOPIC_COLUMNS) == 2


def test_topic_share_sums(spark):
    flags = TQ.document_flags(spark, SF001).withColumn("g", F.lit("all"))
    s = frequency.topic_share_by_group(flags, ["g"], L.TOPIC_COLUMNS)
    n = {r.topic: r.n_topic for r in s.collect()}
    assert n["immigration"] == 87


def test_label_texts_needs_a_labeller(spark):
    with pytest.raises(ValueError):
        labelling.label_texts(spark.createDataFrame([("x",)], "text string"), "text")


def test_reply_shapes(spark):
    replies = [('{"topics": null}', "not_list", []), ('{"topics": "[\\"economics\\"]"}', "not_list", []), ('{"topics": [true, 1]}', "ok", []),
               ('{"topics": ["a", null]}', "ok", []), ('{"topics": [1, 2]}', "ok", ["1", "2"]), ('{"other": 1}', "no_topics_key", None), ('{"topics": ["a"', "bad_json", None),
               (None, "no_call", ["No topic"]), ('{"topics": []}', "ok", [])]
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(replies)], "i int, reply string")
    got = {r.i: (r.status, r.topics) for r in labelling.clean_labels(df).collect()}
    assert got == {i: (s, t) for i, (_, s, t) in enumerate(replies)}


def test_summary_from_wide_equals_long(spark):
    wide, pairs = TQ.gold_pairs(spark, SF01)
    got = {r.metric: r.value for r in V.metrics_summary(wide, pairs).collect()}
    c = V.counts(TQ.gold_long(spark, SF01))
    mi, ma = V.micro_metrics(c).first(), V.macro_metrics(c).first()
    for n in ("precision", "recall", "f1"):
        assert got[f"micro_{n}"] == pytest.approx(mi[n]) and got[f"macro_{n}"] == pytest.approx(ma[n])
    assert got["subset_accuracy"] == pytest.approx(V.subset_accuracy(wide, pairs).first()[0])


def test_split_and_sample_are_prefixes_of_the_hash_order(spark):
    import hashlib
    df = spark.range(3000).withColumnRenamed("id", "k")
    order = sorted(range(3000), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
    assert {r.k for r in sampling.sample_n(df, 777, 7, "k").collect()} == set(order[:777])
    test = {r.k for r in sampling.split(df, 0.33, 7, "k").filter("split = 'test'").collect()}
    assert test == set(order[:990])
    assert sampling.sample_n(df, 0, 7, "k").count() == 0 and sampling.sample_n(df, 3000, 7, "k").count() == 3000


def test_ledger_sends_each_text_once(spark, tmp_path):
    """Equal texts, a second run, a run that was cut off, a failing text, and null texts."""
    seen = tmp_path / "seen"
    seen.mkdir()
    folder = str(seen)

    def labeller(texts):
        import os
        import uuid
        for t in texts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(t)
        if "bad" in texts:
            raise ValueError("no")
        return [{"reply": f"<{t}>", "prompt_tokens": len(t), "completion_tokens": 1} for t in texts]

    sent = lambda: sorted(p.read_text() for p in seen.iterdir())
    rows = [(i, f"text {i % 20}", "x") for i in range(60)] + [(100, None, "x")]
    df = spark.createDataFrame(rows, "id long, text string, reply_to string")
    ledger = str(tmp_path / "ledger")
    run = lambda d: {r.id: r for r in labelling.label_with_ledger(d, "text", labeller, ledger, batch_size=3, batches_a_round=2).collect()}
    first = run(df.filter("id < 10"))
    assert len(first) == 10 and len(sent()) == 10 and first[4].reply == "<text 4>" and first[4].usage.total_tokens == 7
    got = run(df)
    assert len(got) == 61 and sent() == sorted(f"text {i}" for i in range(20))              # each once, over both runs
    assert got[59].reply == "<text 19>" and got[100].reply is None and got[100].error is None
    # a round that was not committed is not in the ledger
    (tmp_path / "ledger" / "part=dead").mkdir()
    (tmp_path / "ledger" / "part=dead" / "part-0.parquet").write_bytes(b"half")
    assert run(df)[3].reply == "<text 3>" and len(sent()) == 20
    worse = df.unionByName(spark.createDataFrame([(200, "bad", "x"), (201, "good", "x")], df.schema))
    a = run(worse)
    assert a[201].reply == "<good>" and "ValueError" in a[200].error and a[200].reply is None
    n = len(sent())
    b = run(worse)
    assert "ValueError" in b[200].error and sent().count("good") <= 2 and len(sent()) == n + 1     # only the failed text again


def test_share_change_adds_up(spark):
    import random
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([1, 2, 5]), rng.randint(0, 1), rng.randint(0, 1), rng.random()) for _ in range(300)]
    rows = [r for r in rows if (r[0], r[1]) != ("c", 2)] + [("d", 5, 1, 0, 2.0), ("e", 2, 0, 0, 1.0)]      # groups that come and go
    df = spark.createDataFrame(rows, "g string, t int, k1 int, k2 int, y double")
    got = frequency.share_change(df, "g", "t", ["k1", "k2"], "y").collect()
    mean = lambda t: sum(r[4] * (r[2] + r[3]) for r in rows if r[1] == t) / sum(r[2] + r[3] for r in rows if r[1] == t)
    for a, b in ((1, 2), (2, 5)):
        parts = [r.within + r.mix + r.grouping for r in got if (r.from_period, r.to_period) == (a, b)]
        assert abs(sum(parts) - (mean(b) - mean(a))) < 1e-12
    assert {(r.from_period, r.to_period) for r in got} == {(1, 2), (2, 5)}
    assert frequency.share_change(df.filter("t = 1"), "g", "t", ["k1", "k2"], "y").count() == 0
