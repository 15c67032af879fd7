import hashlib
import re

import numpy as np
import pytest

from sparkpanel.llm import warc as W


def plain_read(data: bytes):
    """(offset, headers, payload) of a WARC file, record after record."""
    at, out = 0, []
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start = at + len(head) + 4
        end = start + int(fields["Content-Length"])
        assert data[end:end + 4] == b"\r\n\r\n"
        out.append((at, fields, data[start:end].split(b"\r\n\r\n", 1)[1]))
        at = end + 4
    return out


def expected(rows, least=W.MIN_BYTES):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        again = len(data) >= least and ids and i != max(ids)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=repr)


def nested(text: str) -> str:
    """A whole record as text, to stand in a payload."""
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: {len(text.encode())}\r\n\r\n{text}\r\n\r\n"


PAGES = [(1, "http://a/", "<p>ä</p>" * 200), (2, "http://b/\r\nWARC-Type: x", "<p>ä</p>" * 200), (3, None, None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999),
         (7, "u", "WARC/1.1\r\n" * 5), (8, "u", nested("inner") * 3), (9, "u", nested(nested("deep") + "WARC/1.0\r\nContent-Length: 99999\r\n\r\nno")), (10, "u", "WARC/1."),
         (11, "u", "y" * 5000), (12, "u", "y" * 5000), (13, "u", "y" * 5000), (None, "u", "y" * 5000), (None, None, "z" * 2000), (13, "v", "y" * 5000), (14, "u", "a\r\n\r\nb\r\n\r\n"),
         (15, "u", "line\n" * 3000 + nested("z" * 3000)), (-4, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40)]


@pytest.fixture
def small_splits(spark):
    """Splits of so many bytes at most."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]

    def use(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield use
    for n, b in zip(names, before):
        spark.conf.set(n, b)


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, offset int")


@pytest.mark.parametrize("files, split", [(1, 200), (3, 1 << 20), (1, 3001)])
def test_archives_come_back(spark, tmp_path, small_splits, files, split):
    path = str(tmp_path / "warc")
    W.write_archives(make(spark, PAGES).repartition(files), path)
    plain = {f"file://{f}": plain_read(f.read_bytes()) for f in sorted((tmp_path / "warc").glob("part-*"))}
    assert sum(map(len, plain.values())) == len(PAGES)
    small_splits(split)
    records = W.read_archives(spark, path)
    got = sorted(((re.sub("^file:/+", "file:///", r.file), r.offset) for r in records.collect()))
    assert got == sorted((f, x[0]) for f, xs in plain.items() for x in xs)
    assert sorted((tuple(r) for r in W.pages_of(records).collect()), key=repr) == expected(PAGES)
    full = W.read_archives(spark, path, payloads=True).collect()
    assert sorted((r.offset, bytes(r.payload)) for r in full) == sorted((x[0], x[2]) for xs in plain.values() for x in xs)
    by_type = [r for r in full if r.record_type == "response"]
    assert all(r.stated_digest == "sha1:" + hashlib.sha1(r.payload).hexdigest() == "sha1:" + r.sha1 for r in by_type)


def test_random_payloads_in_many_splits(spark, tmp_path, small_splits):
    rng = np.random.default_rng(3)
    parts = ["WARC/1.", "1\r\n", "0\r\n", "\r\n\r\n", "Content-Length: 5\r\n", "WA", "RC/1.1\r\n", "é" * 30, nested("q"), "x" * 100]
    rows = [(i, "u", "".join(rng.choice(parts, rng.integers(0, 25)))) for i in range(300)]
    path = str(tmp_path / "w")
    W.write_archives(make(spark, rows).repartition(2), path, min_bytes=100)
    small_splits(4096)
    assert sorted((tuple(r) for r in W.pages_of(W.read_archives(spark, path)).collect()), key=repr) == expected(rows, 100)


def test_broken_files_and_empty_tables(spark, tmp_path):
    path = tmp_path / "w"
    W.write_archives(make(spark, PAGES[:6]).coalesce(1), str(path))
    (file,) = path.glob("part-*")
    whole = file.read_bytes()
    n = len(plain_read(whole))
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a.warc").write_bytes(whole[:-30])
    with pytest.raises(ValueError, match="no whole WARC file"):
        W.read_archives(spark, str(cut))
    assert W.read_archives(spark, str(cut), strict=False).count() == n - 1
    (cut / "a.warc").write_bytes(b"x" + whole)
    with pytest.raises(ValueError, match="no whole WARC file"):
        W.read_archives(spark, str(cut))
    empty = tmp_path / "none"
    W.write_archives(make(spark, []), str(empty))
    assert W.pages_of(W.read_archives(spark, str(empty))).collect() == []


def test_links_follow_chains():
    # chains 0 -> 20 -> 50 -> 90 and 10 -> 20, 30 -> nowhere; 40 is no candidate
    place, step = np.array([0, 10, 20, 30, 40, 50]), np.array([20, 10, 30, 10, -1, 40])
    leave, low, high = W.links(place, step, 60)
    assert leave.tolist()[:4] == [90, 90, 90, 40] and leave[5] == 90
    on = lambda b, a: low[b] <= low[a] <= high[b]
    assert [b for b in range(6) if on(b, 0)] == [0, 2, 5] and [b for b in range(6) if on(b, 1)] == [1, 2, 5] and [b for b in range(6) if on(b, 3)] == [3]
