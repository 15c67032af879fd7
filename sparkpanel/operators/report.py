"""Regression tables and coefficient-plot tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.functions.numeric import fmt
from sparkpanel.session import local_frame


def stars(p: Column, levels=(0.01, 0.05, 0.1)) -> Column:
    """*** p<0.01, ** p<0.05, * p<0.1."""
    a, b, c = levels
    return F.when(p < a, F.lit("***")).when(p < b, F.lit("**")).when(p < c, F.lit("*")).otherwise(F.lit(""))


def estimates_frame(spark: SparkSession, rows, model: str = "Baseline") -> DataFrame:
    """Hand-entered coefficients [(term, estimate, std_error)] as a coefficient frame."""
    return local_frame(spark, [(model, i + 1, t, float(b), float(s)) for i, (t, b, s) in enumerate(rows)],
                       "model string, position int, term string, estimate double, std_error double")


class Estimates:
    """Named store of results, kept as coefficient / stats frames."""

    def __init__(self):
        self._store = {}

    def store(self, name: str, result) -> None:
        self._store[name] = result

    def __getitem__(self, name):
        return self._store[name]

    def names(self):
        return list(self._store)


def regression_table(coefs: DataFrame, stats: DataFrame, models: list[str], dec: int = 5,
                     keep: list[str] | None = None, labels: dict | None = None) -> DataFrame:
    """Outreg-style table as a DataFrame (ord, row, stat, one column per model).

    Per kept term: a coefficient row with stars and an SE row in brackets; then one
    row of N and one of R-squared (overall for OLS, within for IV, as each command
    reports it).  Models keep their order of appending; an omitted term has no cell.
    """
    c = coefs if keep is None else coefs.filter(F.col("term").isin(keep))
    lab = F.col("term")
    if labels:
        m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        lab = F.coalesce(m[F.col("term")], F.col("term"))
    # rows in the order of ``keep``, or of the labels, or of appearance
    order = keep or list(labels or {})
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("term")).cast("int"), F.lit(0)) if order else F.lit(0)
    place = F.when(place > 0, place).otherwise(F.col("position") + len(order)).cast("int")
    cell_b = F.concat(fmt(F.col("estimate"), dec), stars(F.col("p")))
    cell_se = F.concat(F.lit("("), fmt(F.col("std_error"), dec), F.lit(")"))
    shown = F.col("estimate").isNotNull()
    cells = F.array(F.struct(F.lit("b").alias("stat"), F.when(shown, cell_b).alias("cell")),
                    F.struct(F.lit("se").alias("stat"), F.when(shown, cell_se).alias("cell")))
    long = c.select("model", place.alias("ord"), lab.alias("row"), F.explode(cells).alias("x")).select("model", "ord", "row", "x.*")
    n_cell = F.format_string("%,d", F.col("value").cast("long"))
    s = stats.filter(F.col("stat").isin("N", "r2", "r2_within"))
    per = s.groupBy("model").agg(F.max(F.when(F.col("stat") == "N", n_cell)).alias("n"),
                                 F.coalesce(F.max(F.when(F.col("stat") == "r2", F.col("value"))), F.max(F.when(F.col("stat") == "r2_within", F.col("value")))).alias("r2"))
    ends = F.array(F.struct(F.lit(1000).alias("ord"), F.lit("Observations").alias("row"), F.col("n").alias("cell")),
                   F.struct(F.lit(1001).alias("ord"), F.lit("R-squared").alias("row"), fmt(F.col("r2"), dec).alias("cell")))
    s_long = per.select("model", F.explode(ends).alias("x")).select("model", "x.ord", "x.row", F.lit("value").alias("stat"), "x.cell")
    return long.unionByName(s_long).groupBy("ord", "row", "stat").pivot("model", models).agg(F.first("cell"))


def render_table(table: DataFrame, models: list[str], title: str = "", column_titles: list[str] | None = None,
                 notes: list[str] | None = None) -> str:
    """S5 as text: title, column titles, rows in order (SE under its coefficient), a rule, notes."""
    rank = {"b": 0, "se": 1}
    rows = sorted(table.collect(), key=lambda r: (r["ord"], r["row"], rank.get(r["stat"], 2)))
    head = [["", *models]] + ([["", *column_titles]] if column_titles else [])
    body = [["" if r["stat"] == "se" else r["row"], *[r[m] or "" for m in models]] for r in rows]
    wide = [max(len(x[i]) for x in head + body) for i in range(len(models) + 1)]
    line = lambda x: "  ".join([x[0].ljust(wide[0]), *[c.rjust(w) for c, w in zip(x[1:], wide[1:])]]).rstrip()
    rule = "-" * (sum(wide) + 2 * len(models))
    return "\n".join([*([title] if title else []), rule, *map(line, head), rule, *map(line, body), rule, *(notes or [])])


def coef_table(coef_frames: list[DataFrame], keep: list[str], labels: dict | None = None,
               level_z: float = 1.959963984540054) -> DataFrame:
    """Kept terms with 95% CI from several models (plus hand-entered rows).

    A model's own interval is used; hand-entered rows have none and get the normal one.
    """
    z = F.lit(level_z)
    frames = []
    for f in coef_frames:
        own = "ci_lo" in f.columns
        lo = F.col("ci_lo") if own else F.col("estimate") - z * F.col("std_error")
        hi = F.col("ci_hi") if own else F.col("estimate") + z * F.col("std_error")
        frames.append(f.select("model", "term", "estimate", "std_error", lo.alias("ci_lo"), hi.alias("ci_hi")))
    u = reduce(lambda a, b: a.unionByName(b), frames).filter(F.col("term").isin(keep))
    lab = F.col("term")
    if labels:
        m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        lab = F.coalesce(m[F.col("term")], F.col("term"))
    return u.select("model", "term", lab.alias("label"), "estimate", "std_error", "ci_lo", "ci_hi")
