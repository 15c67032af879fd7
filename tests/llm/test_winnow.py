import random
from collections import defaultdict

from sparkpanel.llm import winnow as W

SPACE = " \t\n\x0b\x0c\r"


def words(line):
    for c in SPACE:
        line = line.replace(c, " ")
    return line.split(" ") and [w for w in line.split(" ") if w]


def brute(rows, least):
    """All windows of all texts, without fingerprints; the same extension."""
    texts = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None})
    seqs = {k: [(p, ln.strip(SPACE), len(words(ln))) for p, ln in enumerate(k[2].split("\n")) if words(ln)] for k in texts}
    spots = defaultdict(list)
    for key, seq in seqs.items():
        for i in range(len(seq)):
            n = 0
            for j in range(i, len(seq)):
                n += seq[j][2]
                if n >= least:
                    spots[tuple(x[1] for x in seq[i:j + 1])].append((key, i, j))
                    break

    def around(seq, part):
        n, out = 0, []
        for k in part:
            if not 0 <= k < len(seq) or n + seq[k][2] >= least:
                break
            n += seq[k][2]
            out.append(seq[k])
        return out

    gone = defaultdict(set)
    for places in spots.values():
        # texts of one id are ordered by a hash in the operator; the tests give such texts nothing in common
        places.sort(key=lambda s: (s[0], s[1]))
        ref, i0, j0 = places[0]
        for key, i, j in places[1:]:
            run = seqs[key][i:j + 1]
            for mine, other in ((around(seqs[key], range(i - 1, -1, -1)), around(seqs[ref], range(i0 - 1, -1, -1))),
                                (around(seqs[key], range(j + 1, len(seqs[key]))), around(seqs[ref], range(j0 + 1, len(seqs[ref]))))):
                for m, o in zip(mine, other):
                    if m[1] != o[1]:
                        break
                    run = [*run, m]
            gone[key] |= {x[0] for x in run}
    out = []
    for i, t in rows:
        key = (i is not None, i or 0, t)
        cut = gone.get(key, set()) if t is not None else set()
        out.append((i, None if t is None else "\n".join(ln for p, ln in enumerate(t.split("\n")) if p not in cut), len(cut)))
    return sorted(out, key=repr)


def run(df, least):
    return sorted(((r.doc_id, r.text, r.n_removed) for r in W.dedup_lines(df, least).collect()), key=repr)


def test_equals_brute_force(docs_of):
    random.seed(5)
    pool = [" ".join(random.choice("abcdefghij") for _ in range(random.randint(1, 6))) for _ in range(12)]
    rows = []
    for i in range(120):
        lines = [random.choice(pool + ["", "  ", f"own {i} {random.random()}"]) for _ in range(random.randint(0, 14))]
        rows.append((i, "\n".join(lines)))
    for least in (5, 12):
        assert run(docs_of(rows), least) == brute(rows, least)


def test_passages_copies_and_edges(docs_of):
    long = " ".join(f"w{i}" for i in range(60))
    pair = " ".join(f"u{i}" for i in range(30)) + "\n" + " ".join(f"v{i}" for i in range(25))
    rows = [(1, f"alone one\n{long}\nend"), (2, f"other\n  {long}\t\nlast"), (3, f"x\n{pair}\ny"), (4, f"z\n{pair}\ny\nq"), (5, "short line\nshort line"),
            (6, None), (7, ""), (8, "\n\n"), (2, f"other\n  {long}\t\nlast"), (None, "null id"), (9, "\n".join(["same ten words in a line a b c d"] * 30)), (10, "f " * 40_000)]
    df = docs_of([(i, t, 1) for i, t in rows], ", n_removed int")
    got = W.dedup_lines(df).collect()
    assert len(got) == len(rows) and W.dedup_lines(df).columns == ["doc_id", "text", "n_lines", "n_removed"]
    by = {r.doc_id: r for r in got}
    assert by[1].text == rows[0][1] and by[2].text == "other\nlast" and by[3].text == rows[2][1] and by[4].text == "z\nq"
    assert by[5].n_removed == 0 and by[6].text is None and by[7].text == "" and by[8].text == "\n\n" and by[None].text == "null id"
    assert by[9].text.count("same") == 1 and by[10].n_removed == 0
    assert run(docs_of(rows), 50) == brute(rows, 50)
    assert W.dedup_lines(df.limit(0)).count() == 0
