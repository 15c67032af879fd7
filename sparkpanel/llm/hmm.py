"""Hidden Markov language model (operator 9).

Words are emitted in two steps: a hidden state emits a class, the class emits
the word.  The ``TOP`` most frequent tokens are classes of their own; every other
word belongs to one of ``SHAPES`` classes by its last two bytes, within which its
probability is its smoothed training count.  So the states' tables have a fixed
size, any word has a probability, and the likelihood of a text is exactly

    P(classes; forward recursion over the states) * product of P(word | class).

Training:

* token counts over all training texts, pre-aggregated in each task, then by
  token: the table grows with the corpus and never leaves the executors;
* the ``HEAVY`` most frequent tokens (a fixed bound) go to all tasks; the other
  words of a text meet their counts in a shuffle join, so a frequent word is
  never a hot key;
* Baum-Welch: every round covers all training texts, whose classes are written
  once.  Each task sums the expected counts of its whole texts; one aggregate
  per round adds the tasks' tables.  Texts are worked in pieces of ``SEGMENT``
  tokens, all abreast; products of the pieces' matrices give what enters and
  leaves each piece, so the counts are those of the uncut texts.
* After every two rounds the tables leap ahead (squared extrapolation), undone
  if the likelihood falls.  Rounds end when the summed log likelihood rises by
  less than ``RISE`` of itself.

Scoring runs the scaled forward recursion over whole texts, many texts abreast;
very long ones in pieces whose matrices are chained.

Defined results: null and empty texts are the end token alone; a null doc_id is
not held out; with no training text every token has probability 1 in its class
and the base score is 0; repeated rows are scored alike (and counted each in
training); an empty table gives no rows; further columns pass through, those
named like an output (in any case) are replaced.  Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpanel.llm.common import largest, mix, table, text_slices, word_hashes, written

STATES, TOP, SHAPES, HEAVY = 8, 2_000, 128, 100_000
#: Tokens of a piece that is worked abreast with others in training; tokens of a text that scoring takes without cutting it.
SEGMENT, WHOLE = 256, 1_024
#: Rise of the log likelihood, as a share of it, below which training ends; factor of the longest leap.
RISE, LEAP = 1e-4, 16.0
SMOOTH = 0.1
END = np.int64(-1)          # the end token's number; no word has it
SEED = 20240607


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of all texts (each followed by END), their shapes (-1 for END) and n + 1 offsets."""
    h, off, (data, starts, ends) = word_hashes(texts, lower=True)
    word = h.view(np.int64)
    word = np.where(word == END, np.int64(0), word)
    fold = lambda b: np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint64)
    last = fold(data[ends - 1]) if len(ends) else np.zeros(0, np.uint64)
    prev = fold(np.where(ends - starts > 1, data[ends - 2], 0)) if len(ends) else last
    shape = (mix(last << np.uint64(8) | prev) % np.uint64(SHAPES)).astype(np.int64)
    n = len(off) - 1
    at = off[1:] + np.arange(n)                      # place of each end token
    out, kind = np.full(len(word) + n, END), np.full(len(word) + n, -1)
    real = np.ones(len(out), bool)
    real[at] = False
    out[real], kind[real] = word, shape
    return out, kind, off + np.arange(n + 1)


def count_tokens(texts: DataFrame) -> DataFrame:
    """tok, shape, c over a ``text`` column."""

    def packed(parts):
        tok = np.concatenate([p[0] for p in parts])
        u, first, of = np.unique(tok, return_index=True, return_inverse=True)
        return u, np.concatenate([p[1] for p in parts])[first], np.bincount(of, np.concatenate([p[2] for p in parts]), len(u)).astype(np.int64)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for a, b in text_slices(batch.column("text")):
                tok, shape, _ = tokens_of(batch.column("text").slice(a, b - a))
                parts.append(packed([(tok, shape, np.ones(len(tok)))]))
                held += len(parts[-1][0])
                if held > 1_000_000:
                    parts = [packed(parts)]
                    held = len(parts[0][0])
                    if held > 500_000:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, parts[0])], names=["tok", "shape", "c"])
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([*map(pa.array, packed(parts))], names=["tok", "shape", "c"])

    rows = texts.select("text").mapInArrow(run, "tok long, shape long, c long")
    return rows.groupBy("tok").agg(F.max("shape").alias("shape"), F.sum("c").alias("c"))


@dataclass
class Vocab:
    """The frequent tokens (sorted) with counts and classes, and the totals of the shape classes."""

    tok: np.ndarray
    count: np.ndarray
    cls: np.ndarray
    n: int                      # training tokens
    v: int                      # distinct ones
    shape_log: np.ndarray       # log10 of each shape class's denominator
    prior: np.ndarray           # share of each class in training

    @property
    def classes(self) -> int:
        return len(self.prior)

    def look_up(self, tok: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and its count, or -1 where it is not frequent."""
        if len(self.tok):
            i = np.minimum(np.searchsorted(self.tok, tok), len(self.tok) - 1)
            known = self.tok[i] == tok
            count, own = np.where(known, self.count[i], -1), np.where(known, self.cls[i], -1)
        else:
            count = own = np.full(len(tok), -1)
        own_classes = self.classes - SHAPES - 1
        return np.where(tok == END, own_classes + SHAPES, np.where(own >= 0, own, own_classes + shape)), count


def vocabulary(counts: DataFrame, top: int = TOP, heavy: int = HEAVY) -> Vocab:
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    most = largest(counts, "c", heavy, "tok").toPandas()            # at most ``heavy`` rows
    word = (most["tok"] != END).to_numpy()
    cls = np.where(word, np.cumsum(word) - 1, -1)
    cls[cls >= top] = -1
    own = int(cls.max(initial=-1)) + 1
    totals, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in counts.filter(F.col("tok") != int(END)).groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():   # SHAPES rows
        totals[r["shape"]], kinds[r["shape"]] = r["c"], r["n"]
    mine = most[cls >= 0]
    np.subtract.at(totals, mine["shape"].to_numpy(int), mine["c"].to_numpy(float))
    np.subtract.at(kinds, mine["shape"].to_numpy(int), 1)
    prior = np.concatenate((mine["c"].to_numpy(float)[np.argsort(cls[cls >= 0])], totals, [float(most["c"][~word].sum())])) + SMOOTH
    order = np.argsort(most["tok"].to_numpy(np.int64))
    return Vocab(most["tok"].to_numpy(np.int64)[order], most["c"].to_numpy(np.int64)[order], cls[order], int(n or 0), int(v),
                 np.log10(totals + SMOOTH * (kinds + 1)), prior / prior.sum()) if own or len(most) else \
        Vocab(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, np.log10(np.full(SHAPES, SMOOTH)), np.full(SHAPES + 1, 1 / (SHAPES + 1)))


@dataclass
class Tables:
    start: np.ndarray       # state probabilities of the first token
    move: np.ndarray        # from state to state
    emit: np.ndarray        # class by state: emit[class, state]
    log_like: float = -np.inf   # of the training texts, under the tables that these were made from


def first_tables(vocab: Vocab, states: int, seed: int = SEED) -> Tables:
    rng = np.random.default_rng(seed)
    emit = vocab.prior[:, None] * rng.gamma(2.0, size=(vocab.classes, states))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
    return Tables(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def segments(off: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length, text and place in the text of pieces of at most ``segment`` tokens, texts in order."""
    size = np.diff(off)
    parts = -(-size // segment)
    text = np.repeat(np.arange(len(size)), parts)
    k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = off[:-1][text] + segment * k
    return begin, np.minimum(segment, off[1:][text] - begin), text, k


def products(seq: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray, t: Tables, kind=np.float32) -> tuple[np.ndarray, np.ndarray]:
    """The matrix that carries the state distribution before each piece to the one at its end, and the log10 factor taken out.

    A text's first piece begins with the start distribution, whatever comes in.  Arrays are (states, pieces), so that every
    operation runs over all pieces at once.
    """
    states, b = len(t.start), len(begin)
    order = np.argsort(-length, kind="stable")
    begin, length, first = begin[order], length[order], first[order]
    out, logs = np.empty((states, states, b), kind), np.zeros(b)
    steps = int(length[0]) if b else 0
    live = np.searchsorted(-length, -np.arange(1, steps + 1), side="right").tolist()
    step = np.ascontiguousarray(t.move.T, kind)
    # a class's emissions, over the largest of them
    top = t.emit.max(1)
    table, fall = np.ascontiguousarray((t.emit / top[:, None]).T, kind), np.log10(top)
    p = np.where(first[None, None, :], t.start[None, :, None], t.move[:, :, None]).astype(kind)
    for j, m in enumerate(live):
        if j:
            p = np.matmul(step, p[:, :, :m])
        cls = seq[begin[:m] + j]
        p *= table.take(cls, axis=1)
        logs[:m] += fall[cls]
        if j % 8 == 7:
            most = p.max((0, 1))
            p /= most
            logs[:m] += np.log10(most)
        gone = live[j + 1] if j + 1 < steps else 0
        out[:, :, gone:m] = p[:, :, gone:]
    back = np.empty(b, np.int64)
    back[order] = np.arange(b)
    return np.ascontiguousarray(out.transpose(2, 0, 1)[back], np.float64), logs[back]


def borders(seq: np.ndarray, begin: np.ndarray, length: np.ndarray, text: np.ndarray, k: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """State distribution before each piece, and the likelihood of what follows it by its last state (to a factor).

    Only pieces of cut texts need their matrices; these are chained along each text, all texts abreast.
    """
    states = len(t.start)
    enter, leave = np.full((len(begin), states), 1 / states), np.ones((len(begin), states))
    many = np.bincount(text, minlength=int(text.max(initial=-1)) + 1)
    cut = np.flatnonzero(many[text] > 1)
    if not len(cut):
        return enter, leave
    p = products(seq, begin[cut], length[cut], k[cut] == 0, t)[0]
    head = np.flatnonzero(k[cut] == 0)
    n = np.diff(np.append(head, len(cut)))
    head, n = head[np.argsort(-n, kind="stable")], -np.sort(-n)
    a = np.full((len(head), states), 1 / states)
    for i in range(int(n[0])):
        m = int(np.searchsorted(-n, -i, side="left"))   # texts with more than i pieces
        at = head[:m] + i
        enter[cut[at]] = a[:m]
        a = np.einsum("bi,bij->bj", a[:m], p[at])
        a /= a.sum(1, keepdims=True)
    b = np.ones((len(head), states))
    for i in range(int(n[0]) - 1, 0, -1):
        m = int(np.searchsorted(-n, -i, side="left"))
        at = head[:m] + i
        leave[cut[at]] = b[:m]
        b[:m] = np.einsum("bij,bj->bi", p[at], b[:m])
        b[:m] /= b[:m].sum(1, keepdims=True)
    leave[cut[head]] = b
    return enter, leave


def expected_counts(seq: np.ndarray, off: np.ndarray, t: Tables, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected first states, moves and emissions of whole texts (classes ``seq``), and their log likelihood.

    Texts are cut into pieces that are worked abreast; what enters and leaves each piece is known from ``borders``, so the
    sums are those of the uncut texts.
    """
    begin, length, text, k = segments(off, segment)
    enter, leave = borders(seq, begin, length, text, k, t)
    order = np.argsort(-length, kind="stable")
    begin, length, first, enter, leave = begin[order], length[order], k[order] == 0, enter[order], leave[order]
    states, b = len(t.start), len(begin)
    start, move, emit = np.zeros(states), np.zeros_like(t.move), np.zeros((states, len(t.emit)))
    if not b:
        return start, move, emit, 0.0
    steps = int(length[0])
    live = np.searchsorted(-length, -np.arange(1, steps + 1), side="right").tolist()
    onward, back_ = np.ascontiguousarray(t.move.T, np.float32), t.move.astype(np.float32)
    table = np.ascontiguousarray(t.emit.T, np.float32)
    classes = [seq[begin[:m] + j] for j, m in enumerate(live)]
    out, alpha, scale = [], [], []
    a = np.where(first, t.start[:, None], t.move.T @ enter.T).astype(np.float32)
    for j, cls in enumerate(classes):       # arrays are (states, pieces)
        e = table.take(cls, axis=1)
        a = (onward @ a[:, :len(cls)] if j else a) * e
        s = a.sum(0)
        a /= s
        out.append(e), alpha.append(a), scale.append(s)
    beta = np.ascontiguousarray(leave.T, np.float32)
    for j, m in enumerate(live):            # pieces that end here
        gone = live[j + 1] if j + 1 < steps else 0
        beta[:, gone:m] /= (alpha[j][:, gone:] * beta[:, gone:m]).sum(0)
    for j in range(steps - 1, -1, -1):
        m = live[j]
        e = out[j]
        e *= beta[:, :m]
        e /= scale[j]
        alpha[j] *= beta[:, :m]             # from here on the expected states
        if j:
            move += t.move * (alpha[j - 1][:, :m] @ e.T)
            beta[:, :m] = back_ @ e
    start += alpha[0][:, first].sum(1)
    move += t.move * (enter[~first].T @ out[0][:, ~first].T)
    cls, gammas = np.concatenate(classes), np.concatenate(alpha, axis=1)
    for s in range(states):
        emit[s] = np.bincount(cls, gammas[s], len(t.emit))
    return start, move, emit, float(sum(np.log(s).sum(dtype=np.float64) for s in scale))


def next_tables(start: np.ndarray, move: np.ndarray, emit: np.ndarray, vocab: Vocab) -> Tables:
    """The M step; a little of the corpus-wide distribution keeps every probability above 0."""
    start, move = start + SMOOTH, move + SMOOTH
    emit = emit.T + vocab.prior[:, None]
    return Tables(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def classes_of(texts: DataFrame, vocab) -> DataFrame:
    """seq: the classes of each text's tokens, 16 bits each; ``vocab`` is a broadcast Vocab."""

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch.column("text")):
                tok, shape, off = tokens_of(batch.column("text").slice(a, b - a))
                seq = vocab.value.look_up(tok, shape)[0].astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([seq[i:j].tobytes() for i, j in zip(off[:-1], off[1:])], pa.binary())], names=["seq"])

    return texts.select("text").mapInArrow(run, "seq binary")


def sequences(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts in one array, and their n + 1 offsets."""
    size = pc.binary_length(seqs).to_numpy().astype(np.int64) // 2
    _, off, data = seqs.buffers()
    if data is None:
        return np.zeros(0, np.int64), np.zeros(len(seqs) + 1, np.int64)
    first = np.frombuffer(off, np.int32, 1, seqs.offset * 4)[0]
    ends = np.append(0, np.cumsum(size))
    return np.frombuffer(data, np.uint16, int(ends[-1]), int(first)).astype(np.int64), ends


def train_round(texts: DataFrame, vocab, t: Tables) -> Tables:
    """One Baum-Welch round over all texts, or their ``classes_of``; ``vocab`` is a broadcast Vocab."""
    rows = texts if "seq" in texts.columns else classes_of(texts, vocab)
    states, classes = len(t.start), len(t.emit)
    size = states + states * states + states * classes
    shared = texts.sparkSession.sparkContext.broadcast(t)

    def run(batches):
        total = np.zeros(size + 1)
        for batch in batches:
            for a, b in text_slices(batch.column("seq")):
                seq, off = sequences(batch.column("seq").slice(a, b - a))
                s, m, e, log_like = expected_counts(seq, off, shared.value)
                total += np.concatenate((s, m.ravel(), e.ravel(), [log_like]))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["k", "x"])

    sums = rows.select("seq").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas()   # the tables' size
    total = np.zeros(size + 1)
    total[sums["k"].to_numpy(int)] = sums["x"].to_numpy(float)
    new = next_tables(total[:states], total[states:states + states * states].reshape(states, states), total[states + states * states:size].reshape(states, classes), vocab.value)
    new.log_like = float(total[size])
    return new


def leap(t0: Tables, t1: Tables, t2: Tables) -> Tables:
    """Squared extrapolation of two rounds, on square roots of probabilities; columns and rows are made to sum to 1 again."""
    parts = [[np.sqrt(x) for x in (t.start, t.move, t.emit)] for t in (t0, t1, t2)]
    r = [b - a for a, b in zip(parts[0], parts[1])]
    v = [c - b - d for b, c, d in zip(parts[1], parts[2], r)]
    norm = lambda xs: np.sqrt(sum((x * x).sum() for x in xs))
    far = min(max(norm(r) / max(norm(v), 1e-300), 1.0), LEAP)
    start, move, emit = (np.maximum(a + 2 * far * d + far * far * w, 1e-3 * c) ** 2 for a, d, w, c in zip(parts[0], r, v, parts[2]))
    return Tables(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train_all(texts: DataFrame, vocab, states: int, rise: float = RISE) -> Tables:
    """Rounds over all texts until their log likelihood stops rising; ``vocab`` is a broadcast Vocab.

    After every two rounds the tables leap ahead; if the next round finds the likelihood lower than before, the leap is undone.
    """
    rows = written(classes_of(texts, vocab))
    t = first_tables(vocab.value, states)
    path, before, last = [t], None, -np.inf
    while True:
        new = train_round(rows, vocab, t)
        if before is not None and new.log_like < last:
            t, path, before = before, [before], None
            continue
        if new.log_like - last <= rise * abs(new.log_like):
            return new
        last, before = new.log_like, None
        path.append(new)
        t = new
        if len(path) == 3:
            before, t = new, leap(*path)
            path = [t]


def forward_log10(seq: np.ndarray, off: np.ndarray, t: Tables, whole: int = WHOLE, segment: int = SEGMENT) -> np.ndarray:
    """log10 likelihood of each whole sequence by the scaled forward recursion, in double precision.

    Texts of more than ``whole`` tokens are cut into pieces whose matrices are chained.
    """
    size = np.diff(off)
    total = np.zeros(len(size))
    short = np.flatnonzero((size > 0) & (size <= whole))
    order = short[np.argsort(-size[short], kind="stable")]
    begin, length = off[:-1][order], size[order]
    if len(order):
        live = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")    # texts with more than j tokens
        a, logs = None, np.zeros(len(order))
        onward, table = np.ascontiguousarray(t.move.T), np.ascontiguousarray(t.emit.T)
        for j, m in enumerate(live.tolist()):               # arrays are (states, texts)
            a = (onward @ a[:, :m] if j else t.start[:, None]) * table.take(seq[begin[:m] + j], axis=1)
            s = a.sum(0)
            a /= s
            logs[:m] += np.log10(s)
        total[order] = logs
    begin, length, text, k = segments(off, segment)
    mine = np.flatnonzero(size[text] > whole)
    if len(mine):
        p, logs = products(seq, begin[mine], length[mine], k[mine] == 0, t, np.float64)
        total += np.bincount(text[mine], logs, len(size))
        head = np.flatnonzero(k[mine] == 0)
        n = np.diff(np.append(head, len(mine)))
        by = np.argsort(-n, kind="stable")
        head, n, of = head[by], n[by], text[mine][head[by]]
        a = np.full((len(head), len(t.start)), 1 / len(t.start))
        for i in range(int(n[0])):
            m = int(np.searchsorted(-n, -i, side="left"))
            a = np.einsum("bi,bij->bj", a[:m], p[head[:m] + i])
            s = a.sum(1)
            a /= s[:, None]
            total[of[:m]] += np.log10(s)
    return total


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 10 is 0.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def score_texts(df: DataFrame, counts: DataFrame, vocab, t: Tables) -> DataFrame:
    """``df`` (with a ``text``) without the text, with n_tokens, n_known, base_score and score."""
    given = [c for c in df.columns if c.lower() not in ("text", "n_tokens", "n_known", "base_score", "score")]
    keep = [f"__{i}" for i in range(len(given))]            # further columns travel under names of their own
    df = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(given, keep)], "text")
    shared = df.sparkSession.sparkContext.broadcast(t)

    def run(batches):
        v = vocab.value
        own = v.classes - SHAPES - 1
        for batch in batches:
            for a, b in text_slices(batch.column("text"), 4 << 20):
                tok, shape, off = tokens_of(batch.column("text").slice(a, b - a))
                cls, count = v.look_up(tok, shape)
                model = forward_log10(cls, off, shared.value)
                row = np.repeat(np.arange(b - a), np.diff(off))
                frequent, shaped = count >= 0, (cls >= own) & (cls < own + SHAPES)
                logs = np.where(frequent, np.log10(np.maximum(count, 0) + SMOOTH), 0.0)
                sums = lambda x: np.bincount(row, x, b - a)
                rare = ~frequent & (tok != END)
                # the end token may be missing from the frequent ones where nothing was trained
                logs[~frequent & (tok == END)] = np.log10(SMOOTH)
                model += sums(np.where(shaped, logs - v.shape_log[np.clip(cls - own, 0, SHAPES - 1)], 0.0))
                r, w = row[rare], tok[rare]
                by = np.lexsort((w, r))
                r, w = r[by], w[by]
                new = np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1]))[:len(r)]
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(r)))
                many = pa.array(np.append(0, np.cumsum(np.bincount(r[first], minlength=b - a))), pa.int32())
                lists = [pa.ListArray.from_arrays(many, pa.array(x, pa.int64())) for x in (w[first], times)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in keep), pa.array(np.diff(off)), pa.array(sums(frequent & (count > 0)).astype(np.int64)),
                     pa.array(sums(logs)), pa.array(model), *lists], names=[*keep, "n_tokens", "known", "base", "model", "toks", "times"])

    schema = type(df.schema)([df.schema[c] for c in keep])
    for name, kind in (("n_tokens", "long"), ("known", "long"), ("base", "double"), ("model", "double"), ("toks", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)
    rows = df.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id())
    rows = written(rows)
    rare = rows.select("__row", F.explode(F.arrays_zip("toks", "times")).alias("x")).select("__row", F.col("x.toks").alias("tok"), F.col("x.times").alias("times"))
    more = rare.join(counts.select("tok", "c"), "tok", "left").groupBy("__row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"))
    v = vocab.value
    each = float(np.log10(v.n + SMOOTH * (v.v + 1)))
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.join(more, "__row", "left").select(
        *[F.col(k).alias(c) for c, k in zip(given, keep)], "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + logs - F.col("n_tokens") * each).alias("base_score"), (F.col("model") + logs).alias("score"))


def score_documents(docs: DataFrame, states: int = STATES, top: int = TOP, heavy: int = HEAVY, rise: float = RISE) -> DataFrame:
    """``docs`` (doc_id, text, ...) without text, with held_out, the counts and both scores."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    train = docs.filter(~held_out(docs["doc_id"])).select("doc_id", text.alias("text"))
    counts = written(count_tokens(train))
    vocab = vocabulary(counts, top, heavy)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)        # ``heavy`` tokens
    t = train_all(train, shared, states, rise)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("held_out", "train_tokens")]).withColumns({"held_out": held_out(docs["doc_id"]), "text": text})
    return score_texts(rows, counts, shared, t).withColumn("train_tokens", F.lit(vocab.n).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
