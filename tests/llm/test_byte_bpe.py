import base64
import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from sparkpanel.llm import byte_bpe as B

EDGES = [None, "", " ", "a's", "a's's 're''s ' 's \n's \n  's", "  a  b\n\nc  ", " x  y　", "it's they'll we've I'm'd'D'S",
         "12ab３é日本語 ¼", "'", "''", "'re", "'r", "'l l", "a'", "\n", "\n\n a", " 'll", "x" * 3000, "ab" * 700, "\x00 \x1c a"]


@pytest.fixture(scope="module")
def path():
    return B.default_path()


@pytest.fixture(scope="module")
def tiktok(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(path, texts, most=B.SLICE_BYTES):
    bpe = B.codec(path)
    for a, b, ids, ends, tokens in B.encode_texts(bpe, pa.array(texts, pa.string()), most):
        i = 0
        for k in range(a, b):
            yield texts[k] or "", ids[i:i + tokens[k - a]], ends[i:i + tokens[k - a]]
            i += tokens[k - a]


def test_ids_and_offsets_equal_tiktoken(path, tiktok):
    random.seed(7)
    letters = " '\n\tabstmdrevl12!é　日٣­."
    texts = EDGES + ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    bpe = B.codec(path)
    for text, ids, ends in encoded(path, texts):
        assert ids.tolist() == tiktok.encode_ordinary(text)
        raw, begin = text.encode(), np.append(0, ends)
        assert all(bpe.decode(ids[j:j + 1]).tobytes() == raw[begin[j]:begin[j + 1]] for j in range(len(ids)))


def test_every_code_point(path, tiktok):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" a".join(points[i:i + 600]) + " " for i in range(0, len(points), 600)]
    assert all(ids.tolist() == tiktok.encode_ordinary(text) for text, ids, _ in encoded(path, texts))


def test_long_text_in_parts(path, tiktok):
    text = "so it's a word  and\nlines, 12 of 'em " * 4000
    (got,) = encoded(path, [text], 5000)
    assert got[1].tolist() == tiktok.encode_ordinary(text) and got[2][-1] == len(text.encode())


def test_query_digests(spark, tiktok):
    dir_ = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{dir_}/documents.parquet").collect()}
    rows = B.query(spark, dir_).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tiktok.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_spark_edges(spark, docs_of, path):
    df = docs_of([(1, None, 5), (None, "it's", 6), (2, "", 7), (2, "", 7)], ", ids int")
    out = B.encode(df, path)
    assert out.columns == ["doc_id", "text", "ids", "ends"]
    back = B.decode(out, path).select("text", F.col("decoded").cast("string").alias("d")).collect()
    assert len(back) == 4 and all((r.text or "") == r.d for r in back)
    assert B.round_trip(df.limit(0), path).count() == 0
    empty = B.round_trip(df, path).filter("doc_id = 2").collect()
    assert len(empty) == 2 and empty[0].n_tokens == 0 and empty[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
