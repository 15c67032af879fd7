"""Byte-level BPE encoding and decoding (operator 3).

Pre-tokenisation works on byte arrays, without regular expressions.  Every byte
gets the class of its code point (letter, number, other, white space, ...; a
class also says what an apostrophe or a white space is followed by).  The
splitting pattern is then an automaton of eight states, and every byte is a
transition function on them.  Function composition is associative, so the text
is cut into equal chunks: the composed function of each chunk is found for all
chunks at once, a short scan over the chunks gives the state each one starts
in, and a second sweep marks the token boundaries.  Bytes that continue a code
point are the identity function.

The slices between boundaries go to a cache of merged pieces: a direct-mapped
table compares the bytes of pieces of up to 16 bytes, a dictionary holds the
rest, and a piece seen for the first time is merged pair by pair, lowest rank
first.  The end offset of every token is kept, so that any range of tokens can
be decoded or aligned with its text.

Everything runs inside ``mapInArrow``, partition by partition, without any
shuffle.  Texts are taken in slices of bounded bytes; a longer text is cut at
places where the pattern always starts a new token.

Defined results: null and empty texts have no tokens (digests of zero bytes);
repeated rows are each encoded; an empty table gives no rows; further columns
are carried along, and the operators' own output names replace columns of the
same name.  Bytes that are not UTF-8 count as "other" characters.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpanel.llm.common import mix, table, text_bytes, text_slices

#: Bytes of text encoded at once.
SLICE_BYTES = 1 << 20

# Classes of code points; the order of the transition table below.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_LAST, WHITE_LAST, WHITE_MORE, INSIDE, END = range(10)
# States of the automaton.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)

#: White space of Unicode (property White_Space); fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token starts here", by class * 8 + state."""
    to, cut = np.zeros((10, 8), np.uint8), np.ones((10, 8), bool)
    for kind, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        to[kind] = run
        cut[kind, [run, AFTER_SPACE]] = False
    # An apostrophe with s t m d (one letter) or re ve ll (two) starts a contraction,
    # unless it continues a run of other characters or follows a space.
    for kind, state in ((QUOTE1, ONE_MORE), (QUOTE2, TWO_MORE)):
        to[kind] = state
        to[kind, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        cut[kind, [IN_OTHER, AFTER_SPACE]] = False
    to[SPACE_LAST] = AFTER_SPACE          # it belongs to what follows
    to[WHITE_LAST] = FRESH                # a token of its own
    to[WHITE_MORE] = IN_WHITE
    cut[WHITE_MORE, IN_WHITE] = False
    for kind in range(QUOTE1, WHITE_MORE + 1):
        to[kind, ONE_MORE], to[kind, TWO_MORE] = to[kind, FRESH], to[kind, FRESH]
    to[LETTER, ONE_MORE], to[LETTER, TWO_MORE] = FRESH, ONE_MORE
    cut[LETTER, [ONE_MORE, TWO_MORE]] = False
    to[INSIDE], cut[INSIDE] = np.arange(8), False
    to[END] = FRESH
    return to.ravel(), cut.ravel()


NEXT_STATE, STARTS = _transitions()


@lru_cache(1)
def _point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE_MORE of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WHITE_MORE
    return out


def classes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of every byte; ``ends`` are the places of the end marks between texts."""
    cls = _point_classes()[:256][data]
    high = data >= 0x80
    if high.any():
        cls[high] = OTHER
        lead = np.flatnonzero(data >= 0xC2)
        b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
        x, y, z, w = b[lead], b[lead + 1], b[lead + 2], b[lead + 3]
        size = 2 + (x >= 0xE0) + (x >= 0xF0)
        point = np.where(size == 2, (x & 31) << 6 | y & 63, np.where(size == 3, (x & 15) << 12 | (y & 63) << 6 | z & 63,
                         (x & 7) << 18 | (y & 63) << 12 | (z & 63) << 6 | w & 63))
        good = ((y & 0xC0) == 0x80) & ((size < 3) | ((z & 0xC0) == 0x80)) & ((size < 4) | ((w & 0xC0) == 0x80)) & (point < 0x110000)
        lead, size, point = lead[good], size[good], point[good]
        kind = _point_classes()[point]
        cls[lead] = kind
        for k in (1, 2, 3):
            cls[lead[size > k] + k] = INSIDE
        wide = lead[kind == WHITE_MORE]
        wide_size = size[kind == WHITE_MORE]
    else:
        wide = wide_size = np.zeros(0, np.int64)
    cls[ends] = END
    # White space that a character follows; at the end of a text it runs on.
    after = np.append(cls[1:], END)
    solid = (after != WHITE_MORE) & (after != END)
    white = cls == WHITE_MORE
    last = white & solid
    if len(wide):
        beyond = np.append(cls, np.full(4, END, np.uint8))[wide + wide_size]
        last[wide] = (beyond != WHITE_MORE) & (beyond != END)
    cls[last] = WHITE_LAST
    cls[last & (data == 0x20)] = SPACE_LAST
    # Contractions.
    q = np.flatnonzero(data == 0x27)
    if len(q):
        pad = np.append(data, np.zeros(2, np.uint8))
        one, two = pad[q + 1], pad[q + 2]
        cls[q[np.isin(one, list(b"stmd"))]] = QUOTE1
        pair = one.astype(np.int32) << 8 | two
        cls[q[np.isin(pair, [a << 8 | b for a, b in (b"re", b"ve", b"ll")])]] = QUOTE2
        cls[ends] = END
    return cls


def boundaries(cls: np.ndarray) -> np.ndarray:
    """Places where a token (or an end mark) starts, by a chunked scan of transition functions."""
    n = len(cls)
    if not n:
        return np.zeros(0, np.int64)
    long = max(16, min(1024, int(n ** 0.5)))
    m = -(-n // long)
    grid = np.full(m * long, INSIDE, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(m, long).T) * np.uint8(8)      # a row for each step
    maps = np.repeat(np.arange(8, dtype=np.uint8)[:, None], m, axis=1)        # state before -> state after, by chunk
    for row in grid:
        maps = NEXT_STATE[row + maps]
    enter = np.zeros(m, np.uint8)
    state = FRESH
    for i, f in enumerate(maps.T.tolist()):
        enter[i] = state
        state = f[state]
    marks = np.zeros((long, m), bool)
    state = enter
    for j, row in enumerate(grid):
        at = row + state
        marks[j] = STARTS[at]
        state = NEXT_STATE[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: join the neighbouring pair of lowest rank until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    if len(parts) > 256:
        return _merge_long(parts, ranks)
    none = len(ranks) + 1
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and a linked list: n log n for a piece of any length."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, len(parts[i]) + len(parts[i + 1])) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)

    def offer(i: int, j: int) -> None:
        if (r := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[j])))

    while heap:
        r, i, size = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size or ranks.get(parts[i] + parts[j]) != r:
            continue
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return [ranks[p] for p in parts if p]


class ByteBPE:
    """Encoder and decoder of one rank file, with its cache of pieces (bounded; emptied when full)."""

    SLOTS = 1 << 19
    MAX_PIECES = 300_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for piece, i in self.ranks.items():
            by_id[i] = piece
        self.token_size = np.fromiter(map(len, by_id), np.int64, size)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.pieces: dict[bytes, int] = {}
        self.low, self.high = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.long = np.zeros(self.SLOTS, np.int64)
        self.piece = np.zeros(self.SLOTS, np.int64)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _add(self, piece: bytes) -> int:
        ids, k = merge_piece(piece, self.ranks), len(self.pieces)
        if k >= len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        self.store[self.used:self.used + len(ids)] = ids
        self.first[k], self.count[k] = self.used, len(ids)
        self.used += len(ids)
        self.pieces[piece] = k
        return k

    def _lookup(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each piece in the cache."""
        padded = np.concatenate((data, np.zeros(24, np.uint8)))
        word = np.ndarray(len(data) + 16, "<u8", padded.data, strides=(1,))
        keep = lambda n: np.where(n >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.clip(n, 0, 7)).astype(np.uint64)) - np.uint64(1))
        low = word[start] & keep(size)
        high = word[np.minimum(start + 8, len(data) + 8)] & keep(size - 8)
        slot = (mix(low ^ mix(high + size.astype(np.uint64))) & np.uint64(self.SLOTS - 1)).astype(np.int64)
        hit = (self.low[slot] == low) & (self.high[slot] == high) & (self.long[slot] == size) & (size <= 16)
        out = np.where(hit, self.piece[slot], -1)
        raw = data.tobytes()
        for i in np.flatnonzero(~hit).tolist():
            a = int(start[i])
            piece = raw[a:a + int(size[i])]
            k = self.pieces.get(piece)
            out[i] = k = self._add(piece) if k is None else k
            if len(piece) <= 16:
                s = slot[i]
                self.low[s], self.high[s], self.long[s], self.piece[s] = low[i], high[i], len(piece), k
        return out

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the end of each token in ``data``, and how many tokens each text has.

        ``data`` holds the texts, each followed by one byte, at ``ends``.
        """
        if len(self.pieces) > self.MAX_PIECES:
            self.reset()
        at = boundaries(classes(data, ends))
        size = np.diff(np.append(at, len(data)))
        mark = np.zeros(len(data), bool)
        mark[ends] = True
        real = ~mark[at]
        start, size = at[real], size[real]
        piece = self._lookup(data, start, size)
        count = self.count[piece]
        of = np.repeat(self.first[piece] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        ids = self.store[of]
        text = np.searchsorted(ends, start)
        tokens = np.bincount(text, weights=count, minlength=len(ends)).astype(np.int64)
        # a text's tokens cover it without gaps, so running sums of token sizes are offsets
        done = np.cumsum(self.token_size[ids])
        upto = np.cumsum(tokens)
        begin = np.append(0, ends[:-1] + 1) if len(ends) else ends
        before = np.append(0, done)[upto - tokens]
        return ids, done + np.repeat(begin - before, tokens), tokens

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of ids."""
        size = self.token_size[ids]
        of = np.repeat(self.token_start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.token_bytes[of]


@lru_cache(4)
def codec(path: str) -> ByteBPE:
    """One codec a worker process; its cache is emptied at the end of a task."""
    return ByteBPE(path)


def _safe_cuts(text: bytes, most: int) -> list[bytes]:
    """A long text in parts: each cut is before a space between two ASCII letters, where a token always starts."""
    parts, data = [], np.frombuffer(text, np.uint8)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    cuts = np.flatnonzero((data[1:-1] == 32) & letter[:-2] & letter[2:]) + 1
    a = 0
    while len(text) - a > most:
        k = int(np.searchsorted(cuts, a + most, side="right")) - 1
        if k < 0 or cuts[k] <= a:
            k += 1
            if k < len(cuts) and cuts[k] <= a:
                k += 1
            if k >= len(cuts):
                break
        parts.append(text[a:cuts[k]])
        a = int(cuts[k])
    return [*parts, text[a:]]


def encode_texts(bpe: ByteBPE, texts: pa.Array, max_bytes: int = SLICE_BYTES):
    """Yield, for slices of rows, (start, stop, ids, token ends within their text, tokens by text)."""
    for a, b in text_slices(texts, max_bytes):
        part = texts.slice(a, b - a)
        if b - a == 1 and (whole := part[0].as_py()) and len(raw := whole.encode("utf-8", "surrogatepass")) > 2 * max_bytes:
            ids, ends, base = [], [], 0
            for x in _safe_cuts(raw, max_bytes):
                i, e, _ = bpe.encode(np.frombuffer(x + b"\n", np.uint8), np.array([len(x)]))
                ids.append(i), ends.append(e + base)
                base += len(x)
            yield a, b, np.concatenate(ids), np.concatenate(ends), np.array([sum(map(len, ids))])
            continue
        data, off = text_bytes(part, "\n")
        ids, ends, tokens = bpe.encode(data, off[1:] - 1)
        yield a, b, ids, ends - np.repeat(off[:-1], tokens), tokens


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    return pa.ListArray.from_arrays(off, pa.array(values.astype(np.int32 if kind == pa.int32() else np.int64), kind))


def _with(df: DataFrame, new: str) -> tuple[list[str], T.StructType]:
    """Columns of ``df`` that stay, and the schema with the new fields at the end."""
    fields = T._parse_datatype_string(new)
    names = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in names]
    return [f.name for f in keep], T.StructType(keep + fields.fields)


def encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array<int>) and ``ends`` (array<int>: where each token ends, in bytes of the text)."""
    keep, schema = _with(df, "ids array<int>, ends array<int>")

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            texts = batch.column("__text")
            for a, b, ids, ends, tokens in encode_texts(bpe, texts):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in keep), _lists(ids, tokens, pa.int32()), _lists(ends, tokens, pa.int32())],
                    names=[*keep, "ids", "ends"])
        bpe.reset()      # an idle worker holds no cache

    return df.select(*(df[c] for c in keep), df[text_col].cast("string").alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of its ids.  A null array or id adds no bytes."""
    keep, schema = _with(df, "decoded binary")

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            out = [bpe.decode(np.asarray([i for i in row if i is not None], np.int64)).tobytes() if row else b""
                   for row in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return df.select(*(df[c] for c in keep), df[ids_col].cast("array<int>").alias("__ids")).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with n_tokens and the digests of its ids and of the bytes decoded from them."""
    df_keep = df.drop(text_col)
    keep, schema = _with(df_keep, "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            for a, b, ids, _, tokens in encode_texts(bpe, batch.column("__text")):
                text_size = np.add.reduceat(np.append(bpe.token_size[ids], 0), np.minimum(np.cumsum(tokens) - tokens, len(ids)))
                text_size[tokens == 0] = 0
                raw_ids, raw = memoryview(ids.astype("<u4").tobytes()), memoryview(bpe.decode(ids).tobytes())
                i = j = 0
                shas = ([], [])
                for n, m in zip(tokens.tolist(), text_size.tolist()):
                    shas[0].append(hashlib.sha256(raw_ids[i:i + 4 * n]).hexdigest())
                    shas[1].append(hashlib.sha256(raw[j:j + m]).hexdigest())
                    i, j = i + 4 * n, j + m
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in keep), pa.array(tokens, pa.int64()), *map(pa.array, shas)],
                    names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.reset()      # an idle worker holds no cache

    return df.select(*(df[c] for c in keep), df[text_col].cast("string").alias("__text")).mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return round_trip(docs, default_path())
