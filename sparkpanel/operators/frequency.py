"""Topic counts (A4-A6) and topic shares by group.

One aggregate pass computes every topic sum and the all-zero count together
(partial aggregation on the map side, one row per partition shuffled), and
``stack`` turns the single result row into the long report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def topic_counts(df: DataFrame, topic_cols: list[str]) -> DataFrame:
    """A4 + A5: one row with the sum of each dummy and the all-zero row count."""
    any_topic = F.greatest(*[F.col(c) for c in topic_cols]) if len(topic_cols) > 1 else F.col(topic_cols[0])
    aggs = [F.sum(F.col(c)).cast("long").alias(c) for c in topic_cols]
    aggs.append(F.count_if(F.coalesce(any_topic, F.lit(0)) == 0).cast("long").alias("no_topic"))
    return df.agg(*aggs)


def topic_frequency(df: DataFrame, topic_cols: list[str], labels: list[str] | None = None) -> DataFrame:
    """Long frame ``(position, topic, n)`` in topic order with ``no_topic`` last."""
    labels = labels or topic_cols
    wide = topic_counts(df, topic_cols)
    cols = topic_cols + ["no_topic"]
    names = labels + ["no_topic"]
    pieces = ", ".join(f"{i}, '{n}', {_quote(c)}" for i, (c, n) in enumerate(zip(cols, names), start=1))
    return wide.selectExpr(f"stack({len(cols)}, {pieces}) AS (position, topic, n)")


def topic_share_by_group(df_flags: DataFrame, group_cols: list[str], topic_cols: list[str]) -> DataFrame:
    """Share of texts carrying each topic per group (e.g. language x period).

    One row per group comes out of the aggregate (all topic sums and the group's
    total); only those few rows are turned into the long form.
    """
    sums = df_flags.groupBy(*group_cols).agg(*[F.sum(c).cast("long").alias(c) for c in topic_cols], F.count(F.lit(1)).alias("n_texts"))
    cells = F.array(*[F.struct(F.lit(c).alias("topic"), F.col(c).alias("n_topic")) for c in topic_cols])
    long = sums.select(*group_cols, "n_texts", F.explode(cells).alias("x"))
    return long.select(*group_cols, "x.topic", "x.n_topic", "n_texts", F.try_divide("n_topic", "n_texts").alias("share"))


def share_decomposition(df: DataFrame, group_col: str, topic_cols: list[str], outcome: str, a, b) -> DataFrame:
    """The difference of a 0/1 (or numeric) outcome's mean between groups a and b, split by topic.

    A row counts for each topic it carries (tags).  With w the topic's share of a
    group's tags (its topic mix) and m the outcome's mean within the topic, the
    tag-weighted gap  sum(w_b m_b) - sum(w_a m_a)  is exactly the sum over topics of

        within = (w_a + w_b) / 2 * (m_b - m_a)      the change within the topic
        mix    = (m_a + m_b) / 2 * (w_b - w_a)      the change of the topic's weight

    A topic without tags in a group has weight 0 there, and takes the other group's mean.
    """
    groups = df.filter(F.col(group_col).isin(a, b))
    aggs = [F.sum(c).cast("double").alias(f"n_{i}") for i, c in enumerate(topic_cols)]
    aggs += [F.sum(F.col(c) * F.col(outcome)).cast("double").alias(f"s_{i}") for i, c in enumerate(topic_cols)]
    sums = groups.groupBy(group_col).agg(*aggs)                     # two rows
    tags = sum((F.col(f"n_{i}") for i in range(len(topic_cols))), F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(c).alias("topic"), F.try_divide(F.col(f"n_{i}"), tags).alias("w"), F.try_divide(F.col(f"s_{i}"), F.col(f"n_{i}")).alias("m"))
                      for i, c in enumerate(topic_cols)])
    long = sums.select(F.col(group_col).alias("g"), F.explode(cells).alias("x")).select("g", "x.*")
    pick = lambda g, c: F.max(F.when(F.col("g") == g, F.col(c)))
    both = long.groupBy("topic").agg(F.coalesce(pick(a, "w"), F.lit(0.0)).alias("w_a"), F.coalesce(pick(b, "w"), F.lit(0.0)).alias("w_b"),
                                     pick(a, "m").alias("m1"), pick(b, "m").alias("m2"))
    both = both.select("topic", "w_a", "w_b", F.coalesce("m1", "m2", F.lit(0.0)).alias("m_a"), F.coalesce("m2", "m1", F.lit(0.0)).alias("m_b"))
    return both.select("*", ((F.col("w_a") + F.col("w_b")) / 2 * (F.col("m_b") - F.col("m_a"))).alias("within"),
                       ((F.col("m_a") + F.col("m_b")) / 2 * (F.col("w_b") - F.col("w_a"))).alias("mix"))


def share_change(df: DataFrame, group_col: str, period_col: str, topic_cols: list[str], outcome: str) -> DataFrame:
    """The change of an outcome's mean from each period to the next, by group and topic, split in three.

    A row counts for each topic it carries (tags).  With s the group's share of a period's tags, w the topic's share of the
    group's tags and m the outcome's mean within group and topic, the period's mean is the sum of s * w * m.  Its change is
    exactly the sum over groups and topics of ``within`` (m changed), ``mix`` (w changed) and ``grouping`` (s changed); each
    part is the average over all orders in which the three may change, so the order does not matter.

    A cell without tags has weight 0 and takes the other period's mean; a group without tags in a period takes the other
    period's mix.  One aggregate makes the cube (group, period, topic); the rest works on its cells.
    """
    aggs = [F.sum(c).cast("double").alias(f"n_{i}") for i, c in enumerate(topic_cols)]
    aggs += [F.sum(F.col(c) * F.col(outcome)).cast("double").alias(f"s_{i}") for i, c in enumerate(topic_cols)]
    cube = df.select(F.col(group_col).alias("g"), F.col(period_col).alias("t"), *topic_cols, outcome).groupBy("g", "t").agg(*aggs)
    tags = sum((F.coalesce(F.col(f"n_{i}"), F.lit(0.0)) for i in range(len(topic_cols))), F.lit(0.0))
    rows = cube.select("g", "t", tags.alias("tags"), *[c for i in range(len(topic_cols)) for c in (f"n_{i}", f"s_{i}")])
    all_tags = rows.groupBy("t").agg(F.sum("tags").alias("all"))
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.try_divide(F.coalesce(F.col(f"n_{i}"), F.lit(0.0)), F.col("tags")).alias("w"), F.try_divide(F.col(f"s_{i}"), F.col(f"n_{i}")).alias("m"))
                      for i in range(len(topic_cols))])
    now = rows.join(all_tags, "t").select("g", "t", F.try_divide("tags", "all").alias("s"), cells.alias("x"))
    periods = [r["t"] for r in all_tags.filter("t is not null").orderBy("t").select("t").collect()]       # one row a period
    if len(periods) < 2:
        now = now.limit(0)
        periods = [None, None] if not periods else [*periods, periods[0]]
    kind = df.schema[period_col].dataType
    steps = F.array(*[F.struct(F.lit(a).cast(kind).alias("t0"), F.lit(b).cast(kind).alias("t1")) for a, b in zip(periods, periods[1:])])
    pairs = now.select("g").distinct().withColumn("step", F.explode(steps)).select("g", "step.*")
    side = lambda n: now.select("g", F.col("t").alias(f"t{n}"), F.col("s").alias(f"s{n}"), F.col("x").alias(f"x{n}"))
    both = pairs.join(side(0), ["g", "t0"], "left").join(side(1), ["g", "t1"], "left").filter("x0 is not null or x1 is not null")
    long = both.select("g", "t0", "t1", *[F.coalesce(f"s{n}", F.lit(0.0)).alias(f"s{n}") for n in (0, 1)],
                       F.explode(F.arrays_zip(F.coalesce("x0", "x1").alias("a"), F.coalesce("x1", "x0").alias("b"))).alias("x"))
    v = long.select("g", "t0", "t1", "s0", "s1", F.col("x.a.k").alias("k"), F.coalesce("x.a.w", "x.b.w", F.lit(0.0)).alias("w0"), F.coalesce("x.b.w", "x.a.w", F.lit(0.0)).alias("w1"),
                    F.coalesce("x.a.m", "x.b.m", F.lit(0.0)).alias("m0"), F.coalesce("x.b.m", "x.a.m", F.lit(0.0)).alias("m1"))

    def part(a: str, b: str, c: str):
        """The change of a, times b * c averaged over the orders."""
        x = lambda p, q: F.col(f"{b}{p}") * F.col(f"{c}{q}")
        return (F.col(f"{a}1") - F.col(f"{a}0")) * (2 * x(0, 0) + x(0, 1) + x(1, 0) + 2 * x(1, 1)) / 6

    names = F.array(*[F.lit(c) for c in topic_cols])
    return v.select(F.col("g").alias(group_col), F.col("t0").alias("from_period"), F.col("t1").alias("to_period"), names[F.col("k")].alias("topic"),
                    part("m", "s", "w").alias("within"), part("w", "s", "m").alias("mix"), part("s", "w", "m").alias("grouping"))
