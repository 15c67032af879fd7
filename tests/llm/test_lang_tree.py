import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkpanel.llm import lang_tree as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.query(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "es", "fr", "und"} for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_prediction_reads_the_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    tree = L.train(docs.select("lang", "text", F.col("doc_id").alias("key")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, tree).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}), tree).collect()}
    assert a == b


def test_edges(spark):
    rows = [(i, f"the {w} of and this", "en", 1) for i, w in enumerate("ab cd ef gh".split() * 5)]
    rows += [(50 + i, f"der {w} und die das", "de", 1) for i, w in enumerate("ab cd ef gh".split() * 5)]
    rows += [(90, None, "en", 1), (91, "", "de", 1), (92, "12 ... 34", "en", 1), (93, "und die das", None, 1), (None, "the of and", "en", 1),
             (94, "the of and " * 30_000, None, 1), (94, "the of and " * 30_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = L.identify(df)
    assert out.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in out.collect()]
    by = {i: (p, s) for i, p, s in got}
    assert len(got) == len(rows) and by[90] == by[91] == by[92] == ("und", 0.0)
    assert by[93][0] == "de" and by[94][0] == "en" and by[None][0] == "en"
    assert got.count((94, *by[94])) == 2
    assert L.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    one = {r.lang_pred: r.score for r in L.identify(df.withColumn("lang", F.lit("en"))).collect()}
    assert one == {"en": 1.0, "und": 0.0}


def test_machine_separates_and_features_cover_the_whole_text():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 20)).astype(np.float32)
    y = np.where(x[:, 3] > 0.1, 1.0, -1.0)
    w = L.fit_svm(x, y, 500, 1e-6)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97
    a, b, c = L.features(pa.array(["x " * 5000 + "zebra", "x " * 5000, "ÉÀ ÉÀ"]))
    assert np.abs(a - b).max() > 0.005
    assert np.allclose(c, L.features(pa.array(["éà éà"]))[0])


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    """20,000 rows of one id, equal and different ones, among others: no decision sees more than the bound."""
    rows = [(1, f"the word {i % 2000} of this", "en") for i in range(20_000)] + [(2, "der Hund und die Katze", "de")] * 5000
    rows += [(i, f"the and {chr(97 + i % 26)} of it", "en") for i in range(10, 400)] + [(i, f"und die {chr(97 + i % 26)} das", "de") for i in range(1000, 1040)]
    df = spark.createDataFrame(rows, "key long, text string, lang string")
    sizes, write = [], L.written

    def watched(made):
        out = write(made)
        if "x" in out.columns:
            sizes.extend(r["count"] for r in out.groupBy("lang").count().collect())
        return out

    monkeypatch.setattr(L, "written", watched)
    assert L.train(df, per_lang=50).langs == ["de", "en"] and sorted(sizes) == [41, 50]
    known = df.select("lang", "key", F.xxhash64("text").alias("th")).distinct().withColumn("h", L.order_key(F.xxhash64("key"), F.col("th"))).cache()
    order = sorted(known.collect(), key=lambda r: r.h)
    assert [r.key for r in order if r.key != 1] == [r.key for r in known.filter("key <> 1").orderBy(F.xxhash64("key"), "th").collect()]
    for n, few in ((1, 5000), (50, 10), (600, 3), (5000, 3)):
        got = [(r.lang, r.key, r.th) for r in L.cut_off(known, n, few).collect()]
        for lang in ("en", "de"):
            first = [(r.lang, r.key, r.th) for r in order if r.lang == lang][:n]
            assert set(first) <= set(got)
        assert len(got) <= 2 * (n + few)
