import random

import numpy as np
import pyarrow as pa
import pytest

from sparkpanel.llm import partition_join as J

SF = "/root/testdata/sf0.01"


def plain_set(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    """Set sizes and components by comparing all pairs that share a token."""
    sets = [plain_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_token = {}
    for i, s in enumerate(sets):
        for tok in s:
            by_token.setdefault(tok, []).append(i)
    near = {(i, j) for ids in by_token.values() for i in ids for j in ids if i < j}
    for i, j in near:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(df, width, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df, width, percent).collect()), key=repr)


def corpus(n, sizes, seed, edits=0.03):
    """Texts, copies of them with a few words changed, and copies of those."""
    rng = random.Random(seed)
    rows, texts = [], []
    common = [f"c{i}" for i in range(40)]
    for i in range(n):
        if texts and rng.random() < 0.6:
            words = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, int(edits * len(words))))):
                k = rng.randrange(len(words))
                words[k:k + rng.randint(0, 1)] = [f"e{rng.random()}"] * rng.randint(0, 1)
        else:
            words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice(sizes))]
            if rng.random() < 0.5:
                words[1:1] = common
        if words:
            texts.append(words)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("width,percent,sizes,seed", [(4, 85, [3, 8, 12, 20, 40], 1), (4, 85, [60, 90, 150, 300], 2), (5, 80, [10, 30, 100, 200], 3)])
def test_equals_brute_force(docs_of, width, percent, sizes, seed):
    rows = corpus(260, sizes, seed)
    assert run(docs_of(rows), width, percent) == brute(rows, width, percent)


def test_chain_hot_copies_and_edges(docs_of, monkeypatch):
    monkeypatch.setattr(J, "LOCAL_HOT", 3)
    base = [f"x{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + [f"y{i}"] + base[i + 1:])) for i in range(60)]             # one word differs from the base, two from each other
    rows += [(100 + i, " ".join(base)) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE\ttwo"), (205, "two one"), (None, "one two"), (206, "long " * 30_000), (203, "one two")]
    df = docs_of([(i, t, 5) for i, t in rows], ", n_shingles int")
    assert run(df, 4, 85) == brute(rows, 4, 85)
    assert J.near_duplicates(df.limit(0), 4, 85).count() == 0


def test_edited_copies_make_few_candidates(docs_of, spark):
    """Copies with several edits each, too far from one another to link: the candidates stay near linear."""
    rng = random.Random(4)
    base = [f"x{i}" for i in range(150)]

    def edited(i, k):
        words = list(base)
        for p in rng.sample(range(150), k):
            words[p] = f"y{i}_{p}"
        return " ".join(words)

    rows = [(i, edited(i, rng.choice([0, 1, 2, 4, 5, 6]))) for i in range(400)]
    df = docs_of(rows)
    assert run(df, 4, 85) == brute(rows, 4, 85)
    texts = [t for _, t in rows]
    tok, off = J.shingles(pa.array(texts), 4)
    node = J.node_of(tok, off).view(np.int64)
    left = spark.createDataFrame([(int(k), int(k), int(n), t) for k, n, t in {int(k): (k, n, t) for k, n, t in zip(node, np.diff(off), texts)}.values()],
                                 "node long, comp long, n long, text string")
    far = left.filter("n > 0")
    assert J.cross_candidates(far.join(spark.createDataFrame([(int(node[i]),) for i, t in rows if t.count("y") >= 4], "node long").distinct(), "node"), 4, 85).count() < 400


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.query(spark, SF).collect()), key=repr)
    assert got == brute(rows, 4, 85)


def test_pigeonhole_on_random_pairs():
    """A linked pair always agrees in as many probed segments as the allocation requires."""
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        for _ in range(300):
            n = int(rng.integers(5, 700))
            s = rng.integers(0, 1 << 62, n).astype(np.uint64)
            out = int(rng.integers(0, J.differences(n, percent) + 1))
            r = np.concatenate((s[out:], rng.integers(0, 1 << 62, int(rng.integers(0, out + 1))).astype(np.uint64)))
            s, r = np.unique(s), np.unique(r)
            both = len(np.intersect1d(s, r))
            if 100 * both < percent * (len(s) + len(r) - both) or len(s) == both == len(r):
                continue
            big, small = (s, r) if len(s) >= len(r) else (r, s)
            tok, off = np.concatenate((big, small)), np.array([0, len(big), len(big) + len(small)])
            short = frozenset(J.short_of(tok, off, percent).tolist()) - {-1}
            rows = J.segment_rows(tok, off, np.array([1, 2], np.uint64), percent, short)
            probes = rows[(rows["node"] == 1) & (rows["slack"] < 255)]
            assert len(probes)
            agree = np.isin(probes["sig"], rows["sig"][rows["node"] == 2]).sum()
            assert agree >= int(probes["slack"][0]) + 1       # whichever the set leaves out, one is left


def test_shingles_hash_equal_words_equally():
    tok, off = J.shingles(pa.array(["a b c d e", "A  B\tC\nD e", "a b c", None, "a b c d a b c d"]), 4)
    parts = [tok[a:b] for a, b in zip(off[:-1], off[1:])]
    assert [len(p) for p in parts] == [2, 2, 1, 0, 4] and (parts[0] == parts[1]).all()


def test_links_over_segments_that_all_leave_out(docs_of):
    """a and b agree in twelve segments that every holder leaves out, and in eleven whose anchor is a third set."""
    first, segments, _ = J.bands(85)
    band = int(np.searchsorted(first, 181, side="right")) - 1
    names = [f"w{i}" for i in range(12_000)]
    tok, _ = J.shingles(pa.array(names), 1)
    m = int(segments[band])
    seg = (J.mix(tok + np.array([band + 1], np.uint64) * J._K) >> np.uint64(32)) % np.uint64(m)
    pool = {k: [names[i] for i in np.flatnonzero(seg == k)] for k in range(m)}
    take = lambda ks: {k: [pool[k].pop() for _ in range(4)] for k in ks}
    common, linked, other, rest = take(range(12)), take(range(12, 23)), take(range(23, 35)), take(range(23, m))
    a = common | linked | {k: w[1:] if 23 <= k < 34 else w for k, w in rest.items()}
    b = common | linked | {k: w[1:] if 34 <= k < 45 else w for k, w in rest.items()}
    sets = [a, b, take(range(12)) | linked | other | take(range(35, m))]
    sets += [common | take(range(12, m)) for _ in range(10)]
    sets += [take(range(23)) | other | take(range(35, m)) for _ in range(15)]
    rows = [(i, " ".join(w for k in sorted(s) for w in s[k])) for i, s in enumerate(sets)]
    want = brute(rows, 1, 85)
    assert (1, 181, 0) in want
    assert run(docs_of(rows), 1, 85) == want


@pytest.mark.parametrize("percent", [80, 85])
def test_every_small_pair_of_sizes_meets(percent):
    """All sizes up to 30 with the least intersection that links: the larger set meets the smaller one in a probed segment."""
    rng = np.random.default_rng(3)
    for n in range(1, 31):
        for m in range(1, n + 1):
            both = -(-percent * (n + m) // (100 + percent))
            if both > m or n == m == both:
                continue
            for _ in range(3):
                pick = np.unique(rng.integers(0, 1 << 62, n + m - both).astype(np.uint64))
                rng.shuffle(pick)
                big, small = np.sort(pick[:n]), np.sort(pick[n - both:])
                rows = J.segment_rows(np.concatenate((big, small)), np.array([0, n, n + m]), np.array([1, 2], np.uint64), percent)
                probes = rows[(rows["node"] == 1) & (rows["slack"] < 255)]
                assert np.isin(probes["sig"], rows["sig"][rows["node"] == 2]).any(), (n, m)


def test_smallest_texts_link(docs_of):
    nine = [f"x{i}" for i in range(9)]
    rows = [(1, " ".join(nine)), (2, " ".join([*nine, "y"])), (3, " ".join(nine[:8])), (4, " ".join(["z", *nine]))]
    assert run(docs_of(rows), 4, 85) == brute(rows, 4, 85)
    assert run(docs_of(rows), 5, 80) == brute(rows, 5, 80)
