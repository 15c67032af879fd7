"""Quality rules with risk-controlled thresholds (operator 4, DataFrame functions only).

A text's base counts are array expressions over the whole text, row by row.
Each rule compares one ratio of them with a cutoff.  Cutoffs come from the
labelled documents that pass the base rule, used as a holdout:

* strata are the values of a column (the language); false rejections of good
  documents are counted for every stratum, rule and candidate cutoff in one
  pre-aggregated pass;
* a cutoff is admitted when the exact binomial test rejects "the rule would
  refuse more than ``alpha / rules`` of the stratum's good documents", i.e. when
  P(Binomial(n, alpha / rules) <= k) is at most ``delta`` divided by the number
  of tests (Bonferroni over strata, rules and cutoffs); this is the statement
  that the Clopper-Pearson upper bound is below the limit;
* the smallest admitted cutoff that refuses bad documents at ``LIFT`` times the
  rate of good ones is used; where there is none, the rule refuses nothing.

So with probability 1 - delta, in all strata at once, the rules refuse at most a
share ``alpha`` of the good documents that pass the base rule.

Defined results: a null text has no words and fails the base rule; a null
stratum is a stratum; without labels only the base rule decides; a document is
good if all its labels are 1, and null labels are ignored; repeated rows each
get a result; an empty table gives no rows; further columns pass through, those
named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.llm.common import let, table, words_col, written

ALPHA, DELTA, LIFT = 0.05, 0.05, 3.0

#: Ratio of each rule (over the base counts) and its candidate cutoffs, rising.
RULES = {
    "symbols": ("n_symbols / n_words", [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0]),
    "capitals": ("n_capitals / word_chars", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    "dup_lines": ("n_dup_lines / n_lines", [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9]),
    "repeats": ("n_repeat_words / n_words", [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]),
    "marks": ("n_marks / n_words", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0]),
}


def repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more in the array.

    Windows are compared by a 64-bit hash, sorted with their places; n log n for a text of n words.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(places(h))).otherwise(0))
    return F.when(n < 4, 0).otherwise(some)


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with the counts (long) and base_failed."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "base_failed"]
    keep = [c for c in df.columns if c.lower() not in new and c != text_col]
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(*keep, text.alias("__text"))
    rows = rows.select(*keep, "__text", words_col(F.col("__text")).alias("__words"),
                       F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    of = lambda marks: F.length("__text") - F.length(F.regexp_replace("__text", marks, ""))
    counts = {
        "n_words": F.size("__words"), "word_chars": F.length(F.array_join("__words", "")), "n_symbols": of(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")), "n_repeat_words": repeat_words(F.col("__words")),
        "n_lines": F.size("__lines"), "n_capitals": of(r"\p{Lu}"), "n_marks": of(r"[!?.,;:]"),
    }
    rows = rows.select(*keep, *(c.cast("long").alias(n) for n, c in counts.items()))
    return rows.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def ratio(rule: str) -> Column:
    """The rule's ratio; 0 where there is nothing to divide by."""
    over, under = RULES[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under)), F.lit(0.0))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series after a shift by 8."""
    y = x + 8.0
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + float(i))
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k): the last term times the sum of the terms' ratios.

    Below n p the ratios fall; 40 standard deviations and 100 terms hold all of the double's digits.
    """
    k, n = k.cast("double"), n.cast("double")
    log_term = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p))) + 100).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * (k - j + 1) * (1 - p) / ((n - k + j) * p)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["sum"])
    return F.when(k >= n, 1.0).when(k > n * p, 1.0).otherwise(F.exp(log_term) * total)


def select_cutoffs(counted: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA, lift: float = LIFT) -> DataFrame:
    """stratum, then the admitted cutoff of each rule (null: none).  ``counted`` has doc_id, the stratum and the base counts."""
    good = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    rows = counted.filter("NOT base_failed").join(good, "doc_id")
    # per rule, how many cutoffs a document's ratio exceeds
    above = lambda r: sum((ratio(r) > c).cast("int") for c in RULES[r][1])
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), above(r).alias("above")) for r in RULES])
    hist = (rows.select(stratum, "good", F.explode(rules).alias("x")).groupBy(stratum, "x.rule", "x.above")
            .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    hist = written(hist)
    strata = hist.select(stratum).distinct().count()
    steps = max(len(c) for _, c in RULES.values())
    level = delta / max(1, strata * len(RULES) * steps)
    # at most steps + 1 rows for a stratum and rule
    cut = F.map_from_entries(F.array(*[F.struct(F.lit(r), F.array(*map(F.lit, c))) for r, (_, c) in RULES.items()]))[F.col("rule")]
    per = hist.groupBy(stratum, "rule").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("above", "good", "bad")).alias("bins"))
    per = per.select("*", F.posexplode(cut).alias("pos", "cutoff"))
    beyond = lambda kind: F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + F.when(b["above"] > F.col("pos"), b[kind]).otherwise(0))
    per = per.select(stratum, "rule", "cutoff", "n_good", "n_bad", beyond("good").alias("k_good"), beyond("bad").alias("k_bad"))
    admitted = (binomial_cdf(F.col("k_good"), F.col("n_good"), alpha / len(RULES)) <= level) \
        & (F.col("k_bad") > 0) & (F.col("k_bad") * F.col("n_good") >= lift * F.col("k_good") * F.col("n_bad"))
    return per.filter(admitted).groupBy(stratum).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def apply_cutoffs(counted: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``counted`` with ``kept``."""
    cuts = cutoffs.withColumnRenamed(stratum, "__s")
    rows = counted.join(cuts, counted[stratum].eqNullSafe(cuts["__s"]), "left")
    refused = F.lit(False)
    for r in RULES:
        refused = refused | F.coalesce(ratio(r) > F.col(f"cut_{r}"), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~refused).drop("__s", *[f"cut_{r}" for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs`` without text, with the base counts, base_failed and kept."""
    counted = written(base_counts(docs.drop("kept")))
    return apply_cutoffs(counted, select_cutoffs(counted, labels, stratum, alpha, delta), stratum)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = judge(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    sep = r"[^\x20\x09-\x0D]"
    over = lambda r: "coalesce({0}::DOUBLE / nullif({1}, 0), 0)".format(*RULES[r][0].split(" / "))
    grid = ",".join(f"('{r}', {c}::DOUBLE)" for r, (_, cs) in RULES.items() for c in cs)
    steps = max(len(c) for _, c in RULES.values())
    p = ALPHA / len(RULES)
    return rf"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '{sep}+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{sep}')) AS lines FROM t),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM w, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + j) AS n FROM d, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
c AS MATERIALIZED (
  SELECT w.doc_id, w.lang, len(words)::BIGINT AS n_words, length(list_aggregate(words || [''], 'string_agg', ''))::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines) - len(list_distinct(lines))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_capitals,
    length(text) - length(regexp_replace(text, '[!?.,;:]', '', 'g')) AS n_marks
  FROM w LEFT JOIN r USING (rid)),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
good AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
x AS (SELECT lang, good, rule, ratio FROM (
  SELECT lang, good, {", ".join(f'{over(r)} AS "{r}"' for r in RULES)} FROM b JOIN good USING (doc_id) WHERE NOT base_failed)
  UNPIVOT (ratio FOR rule IN ({", ".join(f'"{r}"' for r in RULES)}))),
k AS (SELECT lang, rule, cutoff, count_if(good) AS ng, count_if(NOT good) AS nb, count_if(good AND ratio > cutoff) AS kg, count_if(NOT good AND ratio > cutoff) AS kb
  FROM x JOIN (VALUES {grid}) AS grid(rule, cutoff) USING (rule) GROUP BY ALL),
a AS (SELECT *, (SELECT sum(exp(lgamma(ng + 1) - lgamma(j + 1) - lgamma(ng - j + 1) + j * ln({p}) + (ng - j) * ln({1 - p})))
    FROM (SELECT unnest(range(0, kg::BIGINT + 1)) AS j)) AS tail FROM k),
cut AS (SELECT lang, {", ".join(f"min(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)} FROM a
  WHERE kg < ng AND kg <= ng * {p} AND tail <= {DELTA} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM x)) * {len(RULES) * steps}) AND kb > 0 AND kb * ng >= {LIFT} * kg * nb
  GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"coalesce({over(r)} > cut_{r}, false)" for r in RULES)}) AS kept
FROM b LEFT JOIN cut ON b.lang IS NOT DISTINCT FROM cut.lang
"""
