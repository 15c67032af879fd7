import hashlib

import numpy as np
import pytest

from sparkpanel.llm import perm_shards as S


def plain_fill(names, m):
    """The turns written out with explicit preference lists."""
    lists = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        start, step = int.from_bytes(d[:8], "big") % m, 1 + int.from_bytes(d[8:16], "big") % (m - 1)
        lists.append([(start + j * step) % m for j in range(m)])
    owner = {}
    while len(owner) < m:
        for i, order in enumerate(lists):
            if len(owner) < m:
                owner[next(s for s in order if s not in owner)] = i
    return [owner[s] for s in range(m)]


def test_table_equals_brute_force_and_is_even():
    names = S.shard_names(7)
    assert S.fill_table(names, 101).tolist() == plain_fill(names, 101)
    loads = np.bincount(S.fill_table(S.shard_names(64)))
    assert loads.max() - loads.min() <= 1
    weighted = np.bincount(S.fill_table(["a", "b"], 1009, [3, 1]))
    assert abs(weighted[0] - 3 * weighted[1]) <= 4


def test_removing_a_shard_moves_few_rows():
    names = S.shard_names(20)
    a, b = S.fill_table(names), S.fill_table(names[:-1])
    moved = (a != b).mean()
    assert 0.05 <= moved < 0.15


@pytest.mark.parametrize("bad", [dict(shards=[], slots=7), dict(shards=["a"], slots=8), dict(shards=["a", "a"], slots=7),
                                 dict(shards=["a"], slots=7, weights=[0])])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        S.fill_table(**bad)


def test_edges(docs_of):
    df = docs_of([(1, "x", 9), (1, "x", 9), (None, None, 9), (None, "y", 9)], ", slot int")
    rows = S.assign_shards(df, ["doc_id"], S.shard_names(5), 101).collect()
    assert len(rows) == 4 and all(0 <= r.slot < 101 and 0 <= r.shard < 5 for r in rows)
    assert rows[0].slot == rows[1].slot and rows[2].slot == rows[3].slot
    assert S.assign_shards(df.limit(0), ["doc_id"], S.shard_names(5), 101).count() == 0
    spread = S.assign_shards(df, ["doc_id"], S.shard_names(5), 101, spread=["text"]).collect()
    assert spread[2].slot != spread[3].slot
