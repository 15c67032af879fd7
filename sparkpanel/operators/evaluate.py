"""Multi-label evaluation.

Two input forms: the long frame ``(row id, topic, actual, predicted[, prob])``,
or the wide one with a pair of 0/1 columns per topic (``reshape.find_pairs``).
Either is reduced to one row of tp/fp/fn/tn per topic in one pass; every metric
is arithmetic on that small table.  The wide form never explodes the rows: all
counts come out of a single aggregate, and whole label vectors are compared
within their row.  Empty denominators give 0, as the reference does with
``zero_division=0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _div0(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def _cells(a: Column, p: Column) -> dict[str, Column]:
    return {"tp": F.count_if((a == 1) & (p == 1)), "fp": F.count_if((a == 0) & (p == 1)),
            "fn": F.count_if((a == 1) & (p == 0)), "tn": F.count_if((a == 0) & (p == 0))}


def counts(long: DataFrame, topic: str = "topic") -> DataFrame:
    """(topic, tp, fp, fn, tn) from the long frame."""
    return long.groupBy(topic).agg(*[c.alias(n) for n, c in _cells(F.col("actual"), F.col("predicted")).items()])


def counts_wide(wide: DataFrame, pairs: list[tuple]) -> DataFrame:
    """The same from paired columns (topic, actual, predicted), in one aggregate."""
    aggs = [F.struct(F.lit(t).alias("topic"), *[c.alias(n) for n, c in _cells(F.col(a), F.col(p)).items()]) for t, a, p in pairs]
    return wide.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


def _prf(df: DataFrame) -> DataFrame:
    prec = _div0(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div0(F.col("tp"), F.col("tp") + F.col("fn"))
    return (df.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", _div0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def confusion(c: DataFrame, topic: str = "topic") -> DataFrame:
    """A8 over counts: 2x2 cells per topic, every one present, and the share of the topic's total."""
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("n"))
                      for a, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return (c.select(topic, (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("__tot"),
                     F.explode(cells).alias("__c"))
            .select(topic, "__c.actual", "__c.predicted", "__c.n", _div0(F.col("__c.n"), F.col("__tot")).alias("share")))


def topic_metrics(c: DataFrame, topic: str = "topic") -> DataFrame:
    """A9 over counts: precision, recall, F1, accuracy and support (actual positives) per topic."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return _prf(c).select(topic, "precision", "recall", "f1", _div0(F.col("tp") + F.col("tn"), n).alias("accuracy"),
                          (F.col("tp") + F.col("fn")).alias("support"))


def micro_metrics(c: DataFrame) -> DataFrame:
    """A10 over counts: pooled precision / recall / F1 over all topic cells."""
    return _prf(c.agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")])).select("precision", "recall", "f1")


def macro_metrics(c: DataFrame, topic: str = "topic") -> DataFrame:
    """A11 over counts: unweighted mean over topics of the per-topic metrics."""
    return topic_metrics(c, topic).agg(*[F.avg(x).alias(x) for x in ("precision", "recall", "f1")])


def _all_equal(pairs: list[tuple]) -> Column:
    return F.array(*[F.col(a) for _, a, _ in pairs]) == F.array(*[F.col(p) for _, _, p in pairs])


def subset_accuracy(wide: DataFrame, pairs: list[tuple]) -> DataFrame:
    """Share of rows whose whole label vector matches, compared within the row."""
    return wide.agg(F.avg(_all_equal(pairs).cast("double")).alias("subset_accuracy"))


def metrics_summary(wide: DataFrame, pairs: list[tuple]) -> DataFrame:
    """The seven summary metrics as (metric, value) rows, from one aggregate over the input."""
    aggs = [F.struct(*[c.alias(n) for n, c in _cells(F.col(a), F.col(p)).items()]) for _, a, p in pairs]
    one = wide.agg(F.array(*aggs).alias("x"), F.avg(_all_equal(pairs).cast("double")).alias("subset_accuracy"))

    def prf(tp: Column, fp: Column, fn: Column) -> Column:
        p, r = _div0(tp, tp + fp), _div0(tp, tp + fn)
        return F.struct(p.alias("precision"), r.alias("recall"), _div0(2 * p * r, p + r).alias("f1"))

    total = lambda name: F.aggregate(F.col("x")[name], F.lit(0).cast("long"), lambda s, v: s + v)
    mean = lambda name: F.aggregate(F.col("t")[name], F.lit(0.0), lambda s, v: s + v) / len(pairs)
    one = one.select("subset_accuracy", prf(total("tp"), total("fp"), total("fn")).alias("m"), F.transform("x", lambda v: prf(v["tp"], v["fp"], v["fn"])).alias("t"))
    names = ("precision", "recall", "f1")
    cells = [(f"micro_{n}", F.col(f"m.{n}")) for n in names] + [("subset_accuracy", F.col("subset_accuracy"))] + [(f"macro_{n}", mean(n)) for n in names]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in cells])))


def holdout_metrics(long: DataFrame, prob: str = "prob", threshold: float = 0.5, eps: float = 1e-7) -> DataFrame:
    """Mean binary cross-entropy over every cell (probabilities clipped to
    [eps, 1-eps]) plus element accuracy, recall and precision at ``p > threshold``."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1.0 - eps))
    y = F.col("actual").cast("double")
    bce = -(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))
    pred = (F.col(prob) > threshold).cast("int")
    a = F.col("actual")
    agg = long.agg(F.avg(bce).alias("loss"), F.avg((pred == a).cast("double")).alias("accuracy"),
                   F.count_if((a == 1) & (pred == 1)).alias("tp"), F.count_if((a == 0) & (pred == 1)).alias("fp"),
                   F.count_if((a == 1) & (pred == 0)).alias("fn"))
    return agg.select("loss", "accuracy", _div0(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                      _div0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
