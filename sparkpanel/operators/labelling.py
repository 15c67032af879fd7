"""Pluggable labeller (M2) and the label-cleaning chain.

``label_texts`` sends texts to a caller-supplied function in Arrow batches via
``mapInPandas``: the function gets a list of texts and returns one reply per
text (JSON text of ``{"topics": [...]}`` or None for "no function call"), with
optional token usage.  An exception inside the function marks the rows that
cause it with an ``error`` instead of killing the job; those rows are split off
by ``split_rejects`` together with undecodable replies.  Without a function,
a deterministic keyword labeller runs as plain column expressions.

Remote labelling is costly and not repeatable: ``label_with_ledger`` keeps every
reply in an append-only table, so that no text is paid for twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpanel.functions import labels as L

REPLY_SCHEMA = ("prompt_tokens long, completion_tokens long, reply string, error string")


def label_texts(df: DataFrame, text_col: str, labeller: Callable | None = None, batch_size: int = 64,
                keywords=None) -> DataFrame:
    """Append ``reply``, ``usage`` (prompt, completion, total tokens) and ``error``.

    ``labeller`` is the caller's function; without one, ``keywords`` (words per
    topic, in topic order) drive the keyword labeller.  When a batch fails, its
    texts are tried one by one, so that only the failing ones are marked.
    """
    if labeller is None:
        if keywords is None:
            raise ValueError("pass a labeller function or the keywords of each topic")
        topics = L.keyword_topics(F.col(text_col), keywords)
        return df.withColumns({
            "reply": F.to_json(F.struct(topics.alias("topics"))),
            "usage": F.struct(F.lit(0).cast("long").alias("prompt_tokens"),
                              F.lit(0).cast("long").alias("completion_tokens"),
                              F.lit(0).cast("long").alias("total_tokens")),
            "error": F.lit(None).cast("string"),
        })
    in_cols = df.columns
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + REPLY_SCHEMA

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size].copy()
                rows = _label_rows(labeller, chunk[text_col].tolist())
                for k, name in enumerate(("reply", "prompt_tokens", "completion_tokens", "error")):
                    chunk[name] = [r[k] for r in rows]
                chunk["prompt_tokens"] = chunk["prompt_tokens"].astype("int64")
                chunk["completion_tokens"] = chunk["completion_tokens"].astype("int64")
                yield chunk

    out = df.mapInPandas(run, out_schema)
    return out.select(*in_cols, "reply",
                      F.struct("prompt_tokens", "completion_tokens",
                               (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
                      .alias("usage"), "error")


def label_with_ledger(df: DataFrame, text_col: str, labeller: Callable, ledger: str, batch_size: int = 64, batches_a_round: int = 200) -> DataFrame:
    """M2 that pays once: ``df`` with ``reply``, ``usage`` and ``error``, from an append-only ledger keyed by the text.

    The ledger (Parquet, one folder a round) holds a row per SHA-256 of a text.  Equal texts are sent once.  What the ledger
    has is not sent again, so a job that is started anew, or a plan that is read twice, calls the labeller only for the rest.
    Pending texts go in rounds of ``batches_a_round`` batches; a round is appended as a whole when it is done, and a task makes
    one call, so that a task that Spark tries again repeats that call alone.  Texts with an error are tried again by the next
    run.  A null text is not sent; its reply is null.
    """
    from sparkpanel.session import cut_lineage, ship
    from sparkpanel.sources import store
    spark = df.sparkSession
    ship(spark)
    key = F.sha2(F.col(text_col).cast("binary"), 256)
    texts = cut_lineage(df.select(key.alias("text_key"), F.col(text_col).alias("text")).filter("text is not null").dropDuplicates(["text_key"]))
    kind = "text_key string, " + REPLY_SCHEMA
    rounds = store.folders(spark, ledger)
    known = (spark.read.schema(kind).parquet(*rounds) if rounds else spark.createDataFrame([], kind)).filter("error is null").select("text_key").distinct()
    todo = cut_lineage(texts.join(known, "text_key", "left_anti"))
    n = todo.count()
    buckets = max(1, -(-n // (batch_size * batches_a_round)))
    turn = F.pmod(F.xxhash64("text_key"), F.lit(buckets))

    def run(frames):
        import pandas as pd
        rows = [pd.DataFrame(x) for x in frames]
        rows = pd.concat(rows) if rows else None
        for a in range(0, 0 if rows is None else len(rows), batch_size):
            part = rows.iloc[a:a + batch_size]
            got = _label_rows(labeller, part["text"].tolist())
            yield pd.DataFrame({"text_key": part["text_key"].to_numpy(), "prompt_tokens": [r[1] for r in got], "completion_tokens": [r[2] for r in got],
                                "reply": pd.Series([r[0] for r in got], dtype=object), "error": pd.Series([r[3] for r in got], dtype=object)})

    for b in range(buckets if n else 0):
        part = todo.filter(turn == b)
        tasks = max(1, -(-part.count() // batch_size))
        store.append(part.repartition(tasks).mapInPandas(run, kind), ledger)
    rounds = store.folders(spark, ledger)
    rows = spark.read.schema(kind).parquet(*rounds) if rounds else spark.createDataFrame([], kind)
    # a success before an error; both are stated, should two runs have sent the same text
    last = rows.groupBy(F.col("text_key").alias("__key")).agg(F.min_by(F.struct("prompt_tokens", "completion_tokens", "reply", "error"), F.struct(F.col("error").isNotNull().alias("bad"), "reply", "error")).alias("r"))
    out = df.withColumn("__k", key).join(last, F.col("__k") == F.col("__key"), "left")
    usage = [F.coalesce(F.col(f"r.{c}"), F.lit(0).cast("long")) for c in ("prompt_tokens", "completion_tokens")]
    return out.select(*df.columns, F.col("r.reply").alias("reply"),
                      F.struct(usage[0].alias("prompt_tokens"), usage[1].alias("completion_tokens"), (usage[0] + usage[1]).alias("total_tokens")).alias("usage"), F.col("r.error").alias("error"))


def _label_rows(labeller: Callable, texts: list) -> list[tuple]:
    """(reply, prompt tokens, completion tokens, error) of each text; a failing batch is halved down to its bad rows."""
    try:
        replies = labeller(texts)
        if len(replies) != len(texts):
            raise ValueError(f"labeller returned {len(replies)} replies for {len(texts)} texts")
        return [(_reply_text(r), _usage(r, "prompt_tokens"), _usage(r, "completion_tokens"), None) for r in replies]
    except Exception as e:  # noqa: BLE001 - reported per row, job continues
        if len(texts) == 1:
            return [(None, 0, 0, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return _label_rows(labeller, texts[:half]) + _label_rows(labeller, texts[half:])


def _reply_text(r):
    if r is None:
        return None
    if isinstance(r, dict):
        return r.get("reply")
    return str(r)


def _usage(r, key):
    if isinstance(r, dict):
        return int(r.get(key) or 0)
    return 0


def clean_labels(df: DataFrame, reply_col: str = "reply", out: str = "topics") -> DataFrame:
    """F2 -> F4 -> F5 and F6: decode, parse, drop the sentinel, flag invalid values.

    Adds ``status``, ``topics`` (array, NULL for rejects) and ``invalid_topics``.
    """
    dec = L.decode_reply(F.col(reply_col))
    d = df.withColumn("__d", dec)
    kept = F.col("__d.status").isin("ok", "not_list", "no_call")
    if "error" in df.columns:
        kept = kept & F.col("error").isNull()
    topics = F.when(kept, L.clean_topics(L.parse_list(F.col("__d.topics_json"))))
    status = F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.col("__d.status")) \
        if "error" in df.columns else F.col("__d.status")
    return (d.withColumn("status", status).withColumn(out, topics)
            .withColumn("invalid_topics", L.invalid_topics(F.col(out))).drop("__d"))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows kept for training vs. rejected rows (with their reason in ``status``)."""
    ok = F.col("status").isin("ok", "not_list", "no_call")
    return df.filter(ok), df.filter(~ok)


def usage_totals(df: DataFrame, usage_col: str = "usage") -> DataFrame:
    """A16 + A18: row count and the true sums of prompt, completion and total tokens."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.sum(f"{usage_col}.{k}").cast("long").alias(k)
                    for k in ("prompt_tokens", "completion_tokens", "total_tokens")])


def to_dummies(df: DataFrame, topics_col: str = "topics", as_string: bool = False) -> DataFrame:
    """19 topic dummies from the label list (native array) or its string form."""
    exprs = (L.topic_flag_exprs(F.col(topics_col)) if as_string
             else L.topic_flags_from_array(F.col(topics_col)))
    return df.select("*", *exprs)


def batched_apply(df: DataFrame, fn: Callable, schema: str, batch_size: int = 2048,
                  num_partitions: int | None = None, key: str | None = None) -> DataFrame:
    """Apply a pandas -> pandas function to fixed-size batches of rows.

    ``repartition`` spreads the rows (by ``key`` when given) so every task gets
    a similar share; each Arrow batch is cut into ``batch_size`` chunks before
    ``fn`` sees it (a model scoring 2,048 rows at a time, say).
    """
    d = df
    if num_partitions:
        d = d.repartition(num_partitions, key) if key else d.repartition(num_partitions)

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                yield fn(pdf.iloc[start:start + batch_size])

    return d.mapInPandas(run, schema)
