import hashlib
import random
import struct

import public_tokenizers as P
import tiktoken
import base64

import corpus_pipeline as C
from sparkpanel.llm import byte_bpe, mix_tree
from tests.llm.test_mix_tree import check
from tests.llm.test_partition_join import brute as brute_groups
from tests.llm.test_winnow import brute as brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "ngram_join", "mix_sources", "bpe_encode"]
    spoken = C.language_id(spark, docs, SF).cache()
    assert spoken.columns == docs.columns and spoken.count() >= 0.98 * docs.count()

    lines = C.line_dedup(spark, spoken, SF).cache()
    want = {i: t for i, t, _ in brute_lines([(r.doc_id, r.text) for r in spoken.collect()], 50)}
    rows = lines.collect()
    assert lines.columns == docs.columns and {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)

    single = C.ngram_join(spark, lines, SF).cache()
    groups = brute_groups([(r.doc_id, r.text) for r in rows], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, n, c in groups if n == 0 or d == c)

    mixed = C.mix_sources(spark, single, SF).cache()
    plan = mix_tree.mix(single)
    check(plan.collect())
    copies = {r.doc_id: len(r.shards) for r in plan.collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(d for d, k in copies.items() for _ in range(k))

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.default_path(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in mixed.collect()}
    out = C.bpe_encode(spark, mixed, SF).collect()
    assert len(out) == mixed.count()
    for r in out:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert sorted(tuple(r) for r in C.run(spark, SF).collect()) == sorted(tuple(r) for r in out)


def test_edges(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "123 !!", "en", "a", 6), (None, "the cat of the house and the dog", None, None, 30),
            (4, "der Hund und die Katze", "de", "b", 22), (5, "the cat and the dog of this house", "en", "a", 33), (5, "the cat and the dog of this house", "en", "a", 33)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in C.language_id(spark, docs, SF).collect()} <= {None, 4, 5}
    single = C.ngram_join(spark, docs, SF)
    assert single.columns == docs.columns and sorted(str(r.doc_id) for r in single.collect()) == ["1", "2", "3", "4", "5", "None"]
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_null_and_shared_ids_are_no_group(spark):
    """Unlinked documents stay, whatever their ids; linked ones go, whatever their ids."""
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (None, texts[0]), (8, texts[5]), (9, texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = C.ngram_join(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in dict.fromkeys(rows) if i != 9)


def test_survivor_of_repeated_rows_is_stated(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "en", s, 1) for s in "hgfedcba"] + [(5, text, "en", None, 1), (6, text, "de", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in (1, 3, 8):
        assert [tuple(r) for r in C.ngram_join(spark, docs.repartition(n), SF).collect()] == [(5, text, "en", None, 1)]


def test_lettered_gibberish_goes(spark):
    """Texts in no learned language are rejected; the clean ones stay, short ones too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (3, 10, 40, 200) for _ in range(20)]
    short = [r.text for r in docs.filter("length(text) between 8 and 100 and lang is not null").orderBy("doc_id").collect() if any(map(str.isalpha, r.text))]
    more = spark.createDataFrame([(10_000_000 + i, t, None, "a", len(t)) for i, t in enumerate([*junk, *short])], docs.schema)
    kept = [r.doc_id for r in C.language_id(spark, docs.unionByName(more), SF).collect()]
    extra = [i - 10_000_000 for i in kept if i >= 10_000_000]
    assert sum(i < len(junk) for i in extra) <= 0.15 * len(junk)
    assert sum(i >= len(junk) for i in extra) >= 0.97 * len(short) > 10
    assert len(kept) - len(extra) >= 0.98 * docs.count()
