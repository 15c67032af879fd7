"""The splittable CSV reader against Spark's own multi-line reader."""

import numpy as np
import pytest

from sparkpanel.sources import read_table
from sparkpanel.sources.split_csv import read_split_csv

SCHEMA = "id long, a string, b string, n double"


def field(s):
    return "" if s is None else '"' + s.replace('"', '""') + '"'


def write(path, rows, end="\n", last=True):
    body = end.join(["id,a,b,n"] + [",".join([str(i), field(a), field(b), str(n)]) for i, a, b, n in rows])
    path.write_bytes((body + (end if last else "")).encode())


def plain(spark, path):
    return (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
            .option("mode", "FAILFAST").schema(SCHEMA).csv(str(path)))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]

    def use(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield use
    for n, b in zip(names, before):
        spark.conf.set(n, b)


def make(rng, n, longest=12):
    parts = ["x", "\n", '"', ",", "ä", "\r\n", "\n\n", " ", '""', "1,2\n3", '","', "\\", "日"]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(parts, rng.integers(0, longest)))
    return [(i, text(), text(), round(float(rng.normal()), 3)) for i in range(n)]


@pytest.mark.parametrize("split, end, last", [(37, "\n", True), (150, "\r\n", True), (1 << 20, "\n", False)])
def test_equals_the_multi_line_reader(spark, tmp_path, splits, split, end, last):
    rng = np.random.default_rng(split)
    folder = tmp_path / "t"
    folder.mkdir()
    for k in range(2):
        write(folder / f"{k}.csv", make(rng, 60), end, last)
    want = rows_of(plain(spark, folder))
    assert len(want) == 120
    splits(split)
    got = read_split_csv(spark, str(folder), SCHEMA)
    lf = lambda rows: sorted((tuple(x.replace("\r\n", "\n") if isinstance(x, str) else x for x in r) for r in rows), key=repr)
    assert rows_of(got) == want if end == "\n" else lf(rows_of(got)) == lf(want)
    assert split > 1000 or got.rdd.getNumPartitions() > 4


def test_a_record_over_many_splits_and_empty_files(spark, tmp_path, splits):
    rows = [(1, "line\n" * 400, "b", 1.0), (2, "q\"" * 300 + "\n", None, 2.0), (3, "", "end", 3.0)]                # empty: null
    folder = tmp_path / "t"
    folder.mkdir()
    write(folder / "a.csv", rows)
    (folder / "b.csv").write_text("")
    write(folder / "c.csv", [])
    splits(64)
    assert rows_of(read_table(spark, str(folder), SCHEMA, "csv")) == sorted([*rows[:2], (3, None, "end", 3.0)], key=repr)


def test_bad_rows_stop_the_job(spark, tmp_path, splits):
    splits(40)
    for name, body in (("type", 'id,a,b,n\n1,"x\ny",z,2.5\nnot,"q",r,1\n'), ("short", 'id,a,b,n\n1,"x"\n')):
        path = tmp_path / f"{name}.csv"
        path.write_text(body)
        with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
            read_split_csv(spark, str(path), SCHEMA).collect()
    path = tmp_path / "open.csv"
    path.write_text('id,a,b,n\n1,"x\ny,z,2.5\n')
    with pytest.raises(ValueError, match="does not end"):
        read_split_csv(spark, str(path), SCHEMA)
