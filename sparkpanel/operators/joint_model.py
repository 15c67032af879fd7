"""Joint training of all topics with epochs, best weights and restarts.

One linear sigmoid head a topic over hashed words (tf-idf, scaled by the text's
length).  Each topic has a head for every regularisation of a short list.  All
heads are trained together: an epoch is one Spark job that reads every training
and hold-out text once, however many topics there are.  Tasks sum the gradients
of their rows, Spark sums them by feature with map-side combine, and
``num_features`` x heads numbers, a parameter, reach the driver.

The driver takes a quasi-Newton step (L-BFGS) for each head; a head whose loss
did not fall halves its step and tries again in the next epoch.  After each
epoch the hold-out loss of every head is known: its best weights are kept, and
training stops after ``patience`` epochs in which no head improved, or after
``max_epochs``.  Of a topic's heads the one with the lowest hold-out loss stays.

With ``state_dir`` the state is published after each epoch, so a driver that is
lost goes on where it was.

Defined results: a null text has no words; rows with a null label take no part;
a topic without hold-out rows is judged by its training loss; a topic with one
class comes close to that class's probability.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpanel.functions import numeric as N
from sparkpanel.functions import text as X
from sparkpanel.session import cut_lineage, ship
from sparkpanel.sources import store

HISTORY = 5             # steps that the quasi-Newton direction remembers
#: Regularisations that each topic is trained with.
REGS = (0.03, 0.003, 0.0003, 0.00001)
ENTRIES = 100_000       # words that a task multiplies at once when it scores
BLOCK_WORDS = 1 << 16   # words of the texts that stand together in training
TASK_WORDS = 1 << 24    # words of a task in training: each task sends a gradient of its own
SUFFICIENT = 1e-4       # share of the predicted fall of the loss that a step must bring
#: Rows of a pass's result beside the features: losses of training and hold-out texts, and the numbers of these.
LOSS, HELD, N_TRAIN, N_HELD = -1, -2, -3, -4


def features(text, num_features: int):
    """The hashed words of a text, with repeats."""
    return F.transform(X.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(num_features)).cast("int"))


def _logits(words: np.ndarray, off: np.ndarray, idf: np.ndarray, weights: np.ndarray):
    """(logits rows x topics, value of each word, row of each word); the last row of ``weights`` is the bias."""
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    value = idf[words] / np.sqrt(np.maximum(n, 1))[row]
    out = np.tile(weights[-1], (len(n), 1))
    full = np.flatnonzero(n)
    if len(full):
        out[full] += np.add.reduceat(weights[words] * value[:, None], off[:-1][full], axis=0)
    return out, value, row


def _chunks(lists: pa.ListArray, entries: int = ENTRIES):
    """(start, stop, words, offsets) of row ranges with about ``entries`` words, one row at least."""
    off = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.to_numpy()
    a, n = 0, len(lists)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + entries, side="right")) - 1)
        yield a, b, words[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


BLOCK = "uniq binary, loc binary, c binary, off binary, n binary, y binary, held binary"


def _fit(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them; read back by ``_read``."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _read(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n] if n else np.uint8)


def _pack(batches):
    """Reads (words, y, held); one row for the texts of about BLOCK_WORDS words.

    A row holds its distinct words, and for each text each of them once with its count: what every epoch needs.
    """
    for batch in batches:
        lists, held = batch.column("words"), batch.column("held").to_numpy()
        y = batch.column("y").flatten().to_numpy().reshape(batch.num_rows, -1)
        for a, b, words, off in _chunks(lists, BLOCK_WORDS):
            n = np.diff(off)
            code, c = np.unique((np.repeat(np.arange(b - a), n).astype(np.int64) << 32) | words, return_counts=True)
            uniq, loc = np.unique(code & 0xFFFFFFFF, return_inverse=True)
            ends = np.searchsorted(code >> 32, np.arange(b - a + 1))
            row = [uniq.astype(np.int32).tobytes(), _fit(loc), _fit(c), ends.astype(np.int64).tobytes(), n.astype(np.int64).tobytes(), y[a:b].astype(float).tobytes(), held[a:b].astype(np.int8).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=[f.split()[0] for f in BLOCK.split(", ")])


def _blocks(batch: pa.RecordBatch):
    """(distinct words, place among them and count of every entry, offsets, numbers of words, y, held) of each row."""
    for i in range(batch.num_rows):
        r = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
        off, n, held = np.frombuffer(r["off"], np.int64), np.frombuffer(r["n"], np.int64), np.frombuffer(r["held"], np.int8)
        yield np.frombuffer(r["uniq"], np.int32), _read(r["loc"], off[-1]), _read(r["c"], off[-1]), off, n, np.frombuffer(r["y"], float).reshape(len(n), -1), held


def _found(batches):
    """Reads blocks; rows (f, n, words): training texts that hold word f; at -1 the training texts and the words of all."""
    for batch in batches:
        for uniq, loc, _, off, n, _, held in _blocks(batch):
            mine = np.repeat(held == 0, np.diff(off))
            f = np.append(uniq.astype(np.int64), -1)
            df = np.append(np.bincount(loc[mine], minlength=len(uniq)), (held == 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(df.astype(np.int64)), pa.array(np.append(np.zeros(len(uniq), np.int64), n.sum()))], names=["f", "n", "words"])


def _gradients(shared):
    """Reads blocks; rows (f, g): gradient sums by feature, losses and counts of the task.

    The heads of one topic stand side by side.
    """

    def read(batches):
        weights, idf = shared.value
        topics = weights.shape[1]
        grad, touched = np.zeros_like(weights), np.zeros(len(weights), bool)
        loss, count = np.zeros((2, topics)), np.zeros(2)
        for batch in batches:
            for uniq, loc, c, off, n, y, held in _blocks(batch):
                y = np.repeat(y, topics // max(1, y.shape[1]), axis=1)
                scale = 1 / np.sqrt(np.maximum(n, 1))[:, None]
                own = idf[uniq][:, None]
                z = np.tile(weights[-1], (len(n), 1))
                full = np.flatnonzero(n)
                times = c[:, None].astype(float)
                if len(full):
                    z[full] += np.add.reduceat((weights[uniq] * own)[loc] * times, off[:-1][full], axis=0) * scale[full]
                bce = np.logaddexp(0, z) - y * z
                for h in (0, 1):
                    loss[h] += bce[held == h].sum(0)
                    count[h] += (held == h).sum()
                rest = np.where(held[:, None] == 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y, 0.0)
                grad[-1] += rest.sum(0)
                if len(loc):
                    order = np.argsort(loc, kind="stable")
                    many = np.bincount(loc)
                    row = np.repeat(np.arange(len(n)), np.diff(off))
                    grad[uniq] += np.add.reduceat((rest * scale)[row[order]] * times[order], np.cumsum(many) - many, axis=0) * own
                    touched[uniq] = True
        touched[-1] = True
        f = np.flatnonzero(touched)
        g = np.concatenate([grad[f], loss, np.repeat(count[:, None], topics, axis=1)])
        f = np.concatenate([f, [LOSS, HELD, N_TRAIN, N_HELD]]).astype(np.int64)
        rows = pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * topics, pa.array(g.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(f), rows], names=["f", "g"])

    return read


def run_pass(rows: DataFrame, weights: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]:
    """(mean training loss, mean hold-out loss, mean gradient, numbers of rows) of all heads: one job.  ``rows``: blocks, or (words, y, held)."""
    topics = weights.shape[1]
    ship(rows.sparkSession)
    if "words" in rows.columns:
        rows = rows.select("words", "y", "held").mapInArrow(_pack, BLOCK)
    shared = rows.sparkSession.sparkContext.broadcast((weights, idf))
    sums = rows.mapInArrow(_gradients(shared), "f long, g array<double>")
    out = sums.groupBy("f").agg(*[F.sum(F.col("g")[t]).alias(f"g{t}") for t in range(topics)]).toPandas()
    shared.unpersist()
    f, g = out["f"].to_numpy(), out[[f"g{t}" for t in range(topics)]].to_numpy()
    row = {k: g[f == k].sum(0) for k in (LOSS, HELD, N_TRAIN, N_HELD)}      # a table without partitions has none
    train, held = row[N_TRAIN][0], row[N_HELD][0]
    grad = np.zeros_like(weights)
    grad[f[f >= 0]] = g[f >= 0] / max(train, 1)
    return row[LOSS] / max(train, 1), row[HELD] / held if held else row[LOSS] / max(train, 1), grad, (train, held)


@dataclass
class State:
    """Training state after an epoch; arrays have one column a topic."""

    epoch: int
    at: np.ndarray          # accepted weights
    loss: np.ndarray
    grad: np.ndarray
    step: np.ndarray        # scale of the next step
    s: list                 # steps and changes of the gradient, newest last
    y: list
    fresh: np.ndarray       # number of remembered steps of each head
    best: np.ndarray
    best_held: np.ndarray
    best_epoch: np.ndarray
    since: int
    held: list              # mean hold-out loss after each epoch

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{k: np.array(v) for k, v in self.__dict__.items()})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> "State":
        z = np.load(io.BytesIO(data))
        x = {k: z[k] for k in z.files}
        x |= {k: int(x[k]) for k in ("epoch", "since")} | {k: list(x[k]) for k in ("s", "y", "held")}
        return State(**x)


def direction(state: State) -> np.ndarray:
    """The quasi-Newton direction of every head."""
    dot = lambda a, b: (a * b).sum(0)
    q, use = state.grad.copy(), []
    for k in range(len(state.s) - 1, -1, -1):
        sy = dot(state.s[k], state.y[k])
        ok = sy > 1e-300                            # a head that did not move in that epoch has zeros here
        a = np.where(ok, dot(state.s[k], q) / np.where(ok, sy, 1), 0)
        q -= a * state.y[k]
        use.append((k, a, sy, ok))
    scale = 1 / np.maximum(np.sqrt(dot(state.grad, state.grad)), 1e-12)
    for k, _, sy, ok in reversed(use):
        scale = np.where(ok, sy / np.where(ok, dot(state.y[k], state.y[k]), 1), scale)
    q *= scale
    for k, a, sy, ok in reversed(use):
        b = np.where(ok, dot(state.y[k], q) / np.where(ok, sy, 1), 0)
        q += (a - b) * np.where(ok, 1, 0) * state.s[k]
    return -q


def train(rows: DataFrame, idf: np.ndarray, topics: int, reg, max_epochs: int, patience: int, state: State | None = None, save=None, run=None) -> State:
    """Epochs until no head's hold-out loss has fallen for ``patience`` of them; ``reg``: one number, or one a head."""
    run = run or run_pass
    penalty = np.ones((len(idf) + 1, 1)) * reg
    penalty[-1] = 0.0                               # the bias is free
    dot = lambda a, b: (a * b).sum(0)
    while state is None or (state.epoch < max_epochs and state.since < patience):
        if state is None:
            trial, move = np.zeros((len(idf) + 1, topics)), None
        else:
            move = state.step * direction(state)
            trial = state.at + move
        loss, held, grad, _ = run(rows, trial, idf)
        loss, grad = loss + 0.5 * (penalty * trial ** 2).sum(0), grad + penalty * trial
        if state is None:
            state = State(1, trial, loss, grad, np.ones(topics), [], [], np.zeros(topics), trial.copy(), held.copy(), np.ones(topics, int), 0, [float(held.mean())])
        else:
            good = loss <= state.loss + SUFFICIENT * dot(state.grad, move)
            s, y = np.where(good, move, 0), np.where(good, grad - state.grad, 0)
            state.s, state.y = ([*old, new.astype(np.float32)][-HISTORY:] for old, new in ((state.s, s), (state.y, y)))
            state.at, state.grad, state.loss = np.where(good, trial, state.at), np.where(good, grad, state.grad), np.where(good, loss, state.loss)
            state.step = np.where(good, 1.0, state.step / 2)
            state.epoch += 1
            better = good & (held < state.best_held)
            state.best = np.where(better, trial, state.best)
            state.best_held, state.best_epoch = np.where(better, held, state.best_held), np.where(better, state.epoch, state.best_epoch)
            state.since = 0 if better.any() else state.since + 1
            state.held.append(float(held.mean()))
        if save:
            save(state)
    return state


@dataclass
class JointTopicModel:
    weights: np.ndarray     # (num_features + 1) x topics, the bias last
    idf: np.ndarray
    topics: list[str]
    text_col: str
    epochs: int
    best_epoch: list[int]
    held_loss: list[float]  # of the topics, at their best epochs
    reg: list[float]

    def score(self, df: DataFrame, threshold: float = 0.5, keep=None) -> DataFrame:
        """M5: probabilities[n_topics] and predicted_label[n_topics] of every row; stateless, so it also runs on streams."""
        keep = keep or list(df.columns)
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.idf))
        topics = len(self.topics)

        def read(batches):
            weights, idf = shared.value
            for batch in batches:
                lists = batch.column("__words")
                z = [_logits(words, off, idf, weights)[0] for _, _, words, off in _chunks(lists)]
                p = 1 / (1 + np.exp(-np.clip(np.concatenate(z) if z else np.zeros((0, topics)), -500, 500)))
                probs = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * topics, pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], probs], names=[*keep, "probabilities"])

        rows = df.select(*keep, features(F.col(self.text_col), len(self.idf)).alias("__words"))
        schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("probabilities", T.ArrayType(T.DoubleType()))])
        return rows.mapInArrow(read, schema).withColumn("predicted_label", N.binarize(F.col("probabilities"), threshold))

    def save(self, spark: SparkSession, path: str) -> None:
        """Published in one step; the former model stays until then."""
        def write(folder: str) -> dict:
            out = io.BytesIO()
            np.savez_compressed(out, weights=self.weights, idf=self.idf)
            spark.createDataFrame([(bytearray(out.getvalue()),)], "data binary").coalesce(1).write.parquet(f"{folder}/weights")
            return {k: getattr(self, k) for k in ("topics", "text_col", "epochs", "best_epoch", "held_loss", "reg")}

        store.publish(spark, path, write)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "JointTopicModel":
        found = store.current(spark, path)
        if not found:
            raise FileNotFoundError(f"no model in {path}")
        folder, about = found
        z = np.load(io.BytesIO(bytes(spark.read.parquet(f"{folder}/weights").first()["data"])))
        return JointTopicModel(z["weights"], z["idf"], **{k: v for k, v in about.items() if k != "version"})


def fit_joint(train_rows: DataFrame, text_col: str, label_cols: list[str], valid: DataFrame | None = None, num_features: int = 1 << 16,
              regs: tuple = REGS, max_epochs: int = 25, patience: int = 5, state_dir: str | None = None) -> JointTopicModel:
    """M3 + M4: all topics in one job an epoch; each head's weights of its best epoch come back."""
    spark = train_rows.sparkSession

    def prepared(df: DataFrame, held: int) -> DataFrame:
        y = F.array(*[F.col(c).cast("double") for c in label_cols])
        return df.select(features(F.col(text_col), num_features).alias("words"), y.alias("y"), F.lit(held).alias("held")).filter(F.forall("y", lambda v: v.isNotNull()))

    rows = prepared(train_rows, 0)
    rows = rows if valid is None else rows.unionByName(prepared(valid, 1))
    ship(spark)
    rows = cut_lineage(rows.mapInArrow(_pack, BLOCK))
    found = {r["f"]: r for r in rows.mapInArrow(_found, "f long, n long, words long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()}     # num_features rows at most
    n, words = (found.pop(-1)[1:] if found else (0, 0))
    idf = np.zeros(num_features)
    for f, r in found.items():
        if r["n"]:
            idf[f] = np.log((n + 1) / (r["n"] + 1)) + 1
    # as many tasks as run at once, more only for more words: what an epoch shuffles is one gradient a task
    tasks = max(min(spark.sparkContext.defaultParallelism, -(-words // BLOCK_WORDS)), -(-words // TASK_WORDS), 1)
    if rows.rdd.getNumPartitions() != tasks:
        rows = cut_lineage(rows.repartition(tasks))
    about = {"topics": label_cols, "num_features": num_features, "regs": list(regs), "rows": n}
    state, save = None, None
    if state_dir:
        found = store.current(spark, state_dir)
        if found and {k: found[1].get(k) for k in about} == about:
            state = State.load(bytes(spark.read.parquet(f"{found[0]}/state").first()["data"]))

        def save(s: State) -> None:
            def write(folder: str) -> dict:
                spark.createDataFrame([(bytearray(s.dump()),)], "data binary").coalesce(1).write.parquet(f"{folder}/state")
                return about

            store.publish(spark, state_dir, write)

    end = train(rows, idf, len(label_cols) * len(regs), np.tile(regs, len(label_cols)), max_epochs, patience, state, save)
    pick = [t * len(regs) + int(np.argmin(end.best_held[t * len(regs):(t + 1) * len(regs)])) for t in range(len(label_cols))]
    return JointTopicModel(end.best[:, pick], idf, list(label_cols), text_col, end.epoch, end.best_epoch[pick].tolist(), end.best_held[pick].tolist(), [regs[h % len(regs)] for h in pick])
