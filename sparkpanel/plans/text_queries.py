"""Text-side queries on ``documents``, ``labels``, ``conversations`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.functions import labels as L
from sparkpanel.operators import frequency
from sparkpanel.plans.sqlgen import FIXTURE_LEXICON, keyword_flags_sql, lit, q, stack_sql
from sparkpanel.session import scratch_path
from sparkpanel.sources import load_table, read_table, write_table

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id + 19 topic dummies from the keyword labeller."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", *L.keyword_flag_exprs(F.col("text"), FIXTURE_LEXICON))


# --- topic_frequency (flagship) ---------------------------------------------

_FREQ_SQL = f"""
WITH f AS (
  SELECT doc_id,
  {keyword_flags_sql()}
  FROM documents
), s AS (
  SELECT {", ".join(f"CAST(sum({q(c)}) AS BIGINT) AS {q(c)}" for c in L.TOPIC_COLUMNS)},
         CAST(count_if(greatest({", ".join(q(c) for c in L.TOPIC_COLUMNS)}) = 0) AS BIGINT) AS no_topic
  FROM f
)
{stack_sql("s", L.TOPIC_COLUMNS + ["no_topic"], L.TOPIC_COLUMNS + ["no_topic"])}
"""


@register("topic_frequency", _FREQ_SQL)
def q_topic_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = document_flags(spark, sf_dir)
    return frequency.topic_frequency(flags, L.TOPIC_COLUMNS)


# --- S1 / S3: the hand-off as CSV ------------------------------------------------------

@register("csv_round_trip", """
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, text IS NULL AS no_text FROM documents""")
def q_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 then S1: the texts (with line feeds and quotes) written as CSV and read back in splits."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = scratch_path(spark, "documents-csv")
    write_table(docs, path, "csv")
    back = read_table(spark, path, docs.schema, "csv")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), F.col("text").isNull().alias("no_text"))


# --- F1 / P13 / P14 / P15: topic dummies, packed and unpacked ------------------------

@register("topic_flags", f"""
WITH f AS (
  SELECT doc_id,
  {keyword_flags_sql()}
  FROM documents
)
SELECT doc_id, {" + ".join(q(c) for c in L.TOPIC_COLUMNS)} AS n_topics,
       concat_ws(',', {", ".join(q(c) for c in L.TOPIC_COLUMNS)}) AS labels_str,
       {", ".join(f"{q(c)} AS {q(c + '_actual')}" for c in L.TOPIC_COLUMNS)}
FROM f""")
def q_topic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import reshape
    flags = document_flags(spark, sf_dir)
    packed = reshape.pack(flags, L.TOPIC_COLUMNS, "labels").select("doc_id", "labels")
    out = reshape.unpack(packed, "labels", L.TOPIC_COLUMNS, "_actual")
    return out.select("doc_id", F.aggregate("labels", F.lit(0), lambda a, x: a + x).alias("n_topics"),
                      F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels_str"),
                      *[f"{c}_actual" for c in L.TOPIC_COLUMNS])


# --- F2-F6 / F11: reply decoding and label cleaning -----------------------------------

def _keyword_topics_sql() -> str:
    items = ", ".join(f"CASE WHEN strpos(lower(text), {lit(k)}) > 0 THEN {lit(t)} END"
                      for k, t in zip(FIXTURE_LEXICON, L.TOPICS))
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def synthetic_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labeller reply per document, derived from the keyword topics of its text.

    ``doc_id % 10`` picks one reply shape so every decoding branch is exercised:
    0 list, 1 list with the sentinel, 2 topics not a list, 3 malformed JSON,
    4 no topics key, 5 no function call, 6 list with a value outside the enum,
    7 topics null, 8 a text that looks like a list, 9 a list with a boolean.
    """
    # topics computed once per text (CASE branches do not share subexpressions)
    docs = load_table(spark, sf_dir, "documents").select("doc_id", L.keyword_topics(F.col("text"), FIXTURE_LEXICON).alias("t"))
    t = F.col("t")
    k = F.col("doc_id") % 10
    reply = (F.when(k == 0, F.to_json(F.struct(t.alias("topics"))))
             .when(k == 1, F.to_json(F.struct(F.concat(F.array(F.lit(L.NO_TOPIC)), t).alias("topics"))))
             .when(k == 2, F.to_json(F.struct(F.coalesce(F.try_element_at(t, F.lit(1)), F.lit("none")).alias("topics"))))
             .when(k == 3, F.concat(F.lit('{"topics": ["'), F.coalesce(F.try_element_at(t, F.lit(1)), F.lit("")), F.lit('"')))
             .when(k == 4, F.to_json(F.struct(F.size(t).alias("n"))))
             .when(k == 6, F.to_json(F.struct(F.concat(t, F.array(F.lit("made up"))).alias("topics"))))
             .when(k == 7, F.lit('{"topics":null}'))
             .when(k == 8, F.lit('{"topics":"[\\"economics\\"]"}'))
             .when(k == 9, F.lit('{"topics":[true,"economics"]}')))
    return docs.select("doc_id", reply.alias("reply"))


_ALLOWED_SQL = "[" + ", ".join(lit(a) for a in L.ALLOWED_REPLY_VALUES) + "]"

_PARSE_SQL = f"""
WITH f AS (SELECT doc_id, {_keyword_topics_sql()} AS topics FROM documents
), r AS (
  SELECT doc_id, CASE doc_id % 10
    WHEN 0 THEN to_json({{'topics': topics}})::VARCHAR
    WHEN 1 THEN to_json({{'topics': list_concat(['no topic'], topics)}})::VARCHAR
    WHEN 2 THEN to_json({{'topics': coalesce(topics[1], 'none')}})::VARCHAR
    WHEN 3 THEN '{{"topics": ["' || coalesce(topics[1], '') || '"'
    WHEN 4 THEN to_json({{'n': CAST(len(topics) AS INTEGER)}})::VARCHAR
    WHEN 5 THEN NULL
    WHEN 6 THEN to_json({{'topics': list_concat(topics, ['made up'])}})::VARCHAR
    WHEN 7 THEN '{{"topics":null}}'
    WHEN 8 THEN '{{"topics":"[\\"economics\\"]"}}'
    ELSE '{{"topics":[true,"economics"]}}' END AS reply
  FROM f
), v AS (
  SELECT doc_id, reply, try(json_extract(reply, '$.topics')) AS tj FROM r
), s AS (
  SELECT doc_id, tj, CASE WHEN reply IS NULL THEN 'no_call' WHEN NOT json_valid(reply) THEN 'bad_json'
    WHEN tj IS NULL THEN 'no_topics_key'
    WHEN json_type(tj) = 'ARRAY' THEN 'ok' ELSE 'not_list' END AS status
  FROM v
), p AS (
  SELECT doc_id, status, CASE WHEN status = 'ok' AND doc_id % 10 = 9 THEN []::VARCHAR[]
    WHEN status = 'ok' THEN from_json(CASE WHEN json_type(tj) = 'ARRAY' THEN tj END, '["VARCHAR"]')
    WHEN status = 'no_call' THEN ['No topic'] WHEN status = 'not_list' THEN []::VARCHAR[] END AS arr
  FROM s
), c AS (
  SELECT doc_id, status, CASE WHEN len(arr) > 1 AND list_contains(arr, 'no topic')
    THEN list_filter(arr, lambda x: x <> 'no topic') ELSE arr END AS cleaned
  FROM p
), j AS (SELECT doc_id, status, cleaned, to_json(cleaned)::VARCHAR AS topics_json FROM c)
SELECT doc_id, status, array_to_string(cleaned, '|') AS topics, CAST(len(cleaned) AS INTEGER) AS n_topics,
  CAST(len(list_filter(cleaned, lambda x: NOT list_contains({_ALLOWED_SQL}, x))) AS INTEGER) AS n_invalid,
  topics_json,
  CASE WHEN topics_json IS NULL THEN NULL ELSE
    {" + ".join(f"CAST(strpos(topics_json, {lit(t)}) > 0 AS INTEGER)" for t in L.TOPICS)} END AS n_flagged
FROM j"""


@register("label_parse", _PARSE_SQL)
def q_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import labelling
    x = labelling.clean_labels(synthetic_replies(spark, sf_dir), "reply", "cleaned")
    x = x.withColumn("topics_json", L.encode_list(F.col("cleaned")))
    flags = L.topic_flag_exprs(F.col("topics_json"))
    vec = F.concat(F.lit("["), F.concat_ws(", ", *[f.cast("string") for f in flags]), F.lit("]"))
    n_flagged = F.when(F.col("topics_json").isNotNull(),
                       F.aggregate(L.parse_int_array(vec), F.lit(0), lambda a, v: a + v))
    return x.select("doc_id", "status", F.array_join("cleaned", "|").alias("topics"),
                    F.size("cleaned").alias("n_topics"), F.size("invalid_topics").alias("n_invalid"),
                    "topics_json", n_flagged.alias("n_flagged"))


# --- F7: prompt assembly --------------------------------------------------------------

# Instruction sent with every text (our own wording; the reply contract is the
# topic list of functions/labels.py).
SYSTEM_PROMPT = ("Classify the message into zero or more of these topics and answer only with the topic "
                 "names, or 'no topic' if none applies: " + ", ".join(L.TOPICS) + ".")


@register("prompt_messages", f"""
SELECT conv_id, turn, role, 2 AS n_messages, 'system' AS first_role, 'user' AS second_role,
       md5({lit(SYSTEM_PROMPT)}) AS system_md5, md5(text) AS user_md5
FROM conversations""")
def q_prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = load_table(spark, sf_dir, "conversations")
    m = conv.select("conv_id", "turn", "role", L.build_messages(F.lit(SYSTEM_PROMPT), F.col("text")).alias("msgs"))
    return m.select("conv_id", "turn", "role", F.size("msgs").alias("n_messages"),
                    F.col("msgs")[0]["role"].alias("first_role"), F.col("msgs")[1]["role"].alias("second_role"),
                    F.md5(F.col("msgs")[0]["content"]).alias("system_md5"),
                    F.md5(F.col("msgs")[1]["content"]).alias("user_md5"))


# --- A16 / A18: usage accounting ------------------------------------------------------

def _word_count(col):
    return F.size(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit("[A-Za-z0-9]+"), 0))


SYSTEM_PROMPT_TOKENS = len(SYSTEM_PROMPT.split())


@register("usage_totals", f"""
WITH u AS (
  SELECT {SYSTEM_PROMPT_TOKENS} + len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS prompt_tokens,
         3 + 2 * len({_keyword_topics_sql()}) AS completion_tokens
  FROM documents
)
SELECT count(*) AS n_rows, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens
FROM u""")
def q_usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("text")
    prompt = F.lit(SYSTEM_PROMPT_TOKENS) + _word_count(F.col("text"))
    completion = F.lit(3) + 2 * F.size(L.keyword_topics(F.col("text"), FIXTURE_LEXICON))
    u = docs.select(F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
                             (prompt + completion).alias("total_tokens")).alias("usage"))
    from sparkpanel.operators import labelling
    return labelling.usage_totals(u)


# --- M2 / F2-F6 / F1 / P13: the labelling chain -----------------------------------------

@register("labelling_chain", f"""
WITH t AS (SELECT doc_id, {_keyword_topics_sql()} AS topics FROM documents
), f AS (SELECT doc_id, topics, {", ".join(f"list_contains(topics, {lit(t)})::INTEGER AS {q(c)}" for t, c in zip(L.TOPICS, L.TOPIC_COLUMNS))} FROM t)
SELECT doc_id, 'ok' AS status, array_to_string(topics, '|') AS topics, 0 AS n_invalid,
       concat_ws(',', {", ".join(q(c) for c in L.TOPIC_COLUMNS)}) AS labels
FROM f""")
def q_labelling_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts -> replies -> decoded, cleaned topics -> rejects split off -> 19 dummies -> packed vector."""
    from sparkpanel.operators import labelling, reshape
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept, _ = labelling.split_rejects(labelling.clean_labels(labelling.label_texts(docs, "text", keywords=FIXTURE_LEXICON)))
    packed = reshape.pack(labelling.to_dummies(kept), L.TOPIC_COLUMNS, "labels")
    return packed.select("doc_id", "status", F.array_join("topics", "|").alias("topics"), F.size("invalid_topics").alias("n_invalid"),
                         F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


# --- F8 / A15: encoding ---------------------------------------------------------------

MAX_LEN = 150

_TOK_SQL = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda t: lower(t))"


@register("encode_text", f"""
WITH t AS (SELECT doc_id, {_TOK_SQL} AS tok FROM documents)
SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, len(tok) > {MAX_LEN} AS truncated,
       CAST(least(len(tok), {MAX_LEN}) AS INTEGER) AS mask_sum,
       array_to_string(list_resize(tok[1:{MAX_LEN}], {MAX_LEN}, '[PAD]'), ' ') AS tokens_str
FROM t""")
def q_encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.functions import text as X
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    e = docs.select("doc_id", X.encode(F.col("text"), MAX_LEN).alias("e"))
    return e.select("doc_id", F.col("e.n_tokens").alias("n_tokens"), F.col("e.truncated").alias("truncated"),
                    F.aggregate("e.mask", F.lit(0), lambda a, v: a + v).alias("mask_sum"),
                    F.array_join("e.tokens", " ").alias("tokens_str"))


@register("max_tokens", f"""
SELECT CAST(max(len({_TOK_SQL})) AS INTEGER) AS max_tokens, count(*) AS n_docs FROM documents""")
def q_max_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.functions import text as X
    docs = load_table(spark, sf_dir, "documents").select("text")
    return docs.agg(F.max(F.size(X.tokens(F.col("text")))).alias("max_tokens"), F.count(F.lit(1)).alias("n_docs"))


# --- F9 / F10 / P1-P4: scoring ------------------------------------------------------

@register("score_binarize", f"""
WITH s AS (
  SELECT CAST(vec_id AS INTEGER) AS vec_id, label,
         list_transform(embedding, lambda x: 1 / (1 + exp(-CAST(x AS DOUBLE)))) AS probs
  FROM embeddings
)
SELECT vec_id, label, round(list_sum(probs), 6) AS p_sum, round(probs[1], 6) AS p_first,
       CAST(len(list_filter(probs, lambda p: p > 0.5)) AS INTEGER) AS n_positive,
       array_to_string(list_transform(probs, lambda p: CAST(p > 0.5 AS INTEGER)), '') AS predicted_label
FROM s""")
def q_score_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.functions import numeric as N
    emb = load_table(spark, sf_dir, "embeddings")
    s = emb.select(N.strict_cast(F.col("vec_id"), "int", "vec_id").alias("vec_id"), "label",
                   N.sigmoid(F.col("embedding")).alias("probs"))
    s = s.withColumn("pred", N.binarize(F.col("probs"), 0.5))
    return s.select("vec_id", "label", F.round(F.aggregate("probs", F.lit(0.0), lambda a, v: a + v), 6).alias("p_sum"),
                    F.round(F.col("probs")[0], 6).alias("p_first"),
                    F.aggregate("pred", F.lit(0), lambda a, v: a + v).alias("n_positive"),
                    F.array_join(F.col("pred").cast("array<string>"), "").alias("predicted_label"))


# --- W2 / W3 / W7: sampling -----------------------------------------------------------

SEED = 42
SAMPLE_N = 100
TEST_SHARE = 0.2
PER_TOPIC = 15


@register("sample_n", f"""
SELECT doc_id, lang FROM documents
ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT {SAMPLE_N}""")
def q_sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import sampling
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.sample_n(docs, SAMPLE_N, SEED, "doc_id")


@register("split_two_way", f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id)
                      <= ceil({TEST_SHARE} * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM documents""")
def q_split_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import sampling
    docs = load_table(spark, sf_dir, "documents").select("doc_id")
    return sampling.split(docs, TEST_SHARE, SEED, "doc_id")


@register("sample_per_topic", f"""
WITH f AS (SELECT doc_id, {keyword_flags_sql()} FROM documents
), lng AS (UNPIVOT f ON {", ".join(q(c) for c in L.TOPIC_COLUMNS)} INTO NAME topic VALUE flag
), r AS (
  SELECT topic, doc_id,
         row_number() OVER (PARTITION BY topic ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
  FROM lng WHERE flag = 1
)
SELECT topic, doc_id FROM r WHERE rn <= {PER_TOPIC}""")
def q_sample_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import sampling
    return sampling.sample_per_topic(document_flags(spark, sf_dir), "doc_id", L.TOPIC_COLUMNS, PER_TOPIC, SEED)


# --- I6: topic shares by group and period ----------------------------------------------

@register("topic_share_by_group", f"""
WITH f AS (SELECT doc_id, lang, CAST(doc_id % 4 AS INTEGER) AS period, {keyword_flags_sql()} FROM documents
), lng AS (UNPIVOT f ON {", ".join(q(c) for c in L.TOPIC_COLUMNS)} INTO NAME topic VALUE flag)
SELECT lang, period, topic, CAST(sum(flag) AS BIGINT) AS n_topic, count(*) AS n_texts,
       round(sum(flag) / count(*), 6) AS share
FROM lng GROUP BY lang, period, topic""")
def q_topic_share_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    flags = docs.select("lang", (F.col("doc_id") % 4).cast("int").alias("period"),
                        *L.keyword_flag_exprs(F.col("text"), FIXTURE_LEXICON))
    s = frequency.topic_share_by_group(flags, ["lang", "period"], L.TOPIC_COLUMNS)
    return s.select("lang", "period", "topic", "n_topic", "n_texts", F.round("share", 6).alias("share"))


@register("share_decomposition", f"""
WITH f AS (SELECT lang, CAST(length(text) > 2000 AS INTEGER) AS long_text, {keyword_flags_sql()} FROM documents WHERE lang IN ('en', 'fr')
), lng AS (UNPIVOT f ON {", ".join(q(c) for c in L.TOPIC_COLUMNS)} INTO NAME topic VALUE flag
), c AS (SELECT lang, topic, sum(flag)::DOUBLE AS n, sum(flag * long_text)::DOUBLE AS s FROM lng GROUP BY ALL
), m AS (SELECT lang, topic, n / sum(n) OVER (PARTITION BY lang) AS w, CASE WHEN n > 0 THEN s / n END AS m FROM c
), b AS (SELECT a.topic, a.w AS w_a, b.w AS w_b, coalesce(a.m, b.m, 0) AS m_a, coalesce(b.m, a.m, 0) AS m_b
         FROM m a JOIN m b ON a.topic = b.topic AND a.lang = 'en' AND b.lang = 'fr')
SELECT topic, round(w_a, 6) AS w_a, round(w_b, 6) AS w_b, round((w_a + w_b) / 2 * (m_b - m_a), 6) AS within,
       round((m_a + m_b) / 2 * (w_b - w_a), 6) AS mix FROM b""")
def q_share_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why French texts are longer or shorter than English ones: within topics, or by their mix of topics."""
    docs = load_table(spark, sf_dir, "documents").select("lang", "text")
    flags = docs.select("lang", (F.length("text") > 2000).cast("int").alias("long_text"), *L.keyword_flag_exprs(F.col("text"), FIXTURE_LEXICON))
    d = frequency.share_decomposition(flags, "lang", L.TOPIC_COLUMNS, "long_text", "en", "fr")
    return d.select("topic", *[F.round(c, 6).alias(c) for c in ("w_a", "w_b", "within", "mix")])


# The twin takes the three changes in each of the six orders and averages, where the operator has the closed form.
_ORDERS = [("m", "w", "s"), ("m", "s", "w"), ("w", "m", "s"), ("w", "s", "m"), ("s", "m", "w"), ("s", "w", "m")]


def _order_sql(of: str) -> str:
    """The change that ``of`` brings when its turn comes, summed over the six orders."""
    terms = []
    for order in _ORDERS:
        at = order.index(of)
        terms.append(f"({of}1 - {of}0) * " + " * ".join(f"{x}{1 if order.index(x) < at else 0}" for x in "mws" if x != of))
    return f"({' + '.join(terms)}) / 6"


@register("share_change", f"""
WITH f AS (SELECT lang, doc_id % 4 AS period, CAST(length(text) > 2000 AS INTEGER) AS long_text, {keyword_flags_sql()} FROM documents
), lng AS (UNPIVOT f ON {", ".join(q(c) for c in L.TOPIC_COLUMNS)} INTO NAME topic VALUE flag
), c AS (SELECT lang, period, topic, sum(flag)::DOUBLE AS n, sum(flag * long_text)::DOUBLE AS x FROM lng GROUP BY ALL
), v AS (SELECT lang, period, topic, n / sum(n) OVER (PARTITION BY lang, period) AS w, CASE WHEN n > 0 THEN x / n END AS m,
                sum(n) OVER (PARTITION BY lang, period) / sum(n) OVER (PARTITION BY period) AS s FROM c
), p AS (SELECT a.lang, a.period AS from_period, b.period AS to_period, topic, a.s AS s0, b.s AS s1, a.w AS w0, b.w AS w1, coalesce(a.m, b.m, 0) AS m0, coalesce(b.m, a.m, 0) AS m1
         FROM v a JOIN v b USING (topic) WHERE a.lang = b.lang AND b.period = a.period + 1)
SELECT lang, from_period, to_period, topic, round({_order_sql('m')}, 6) AS within, round({_order_sql('w')}, 6) AS mix, round({_order_sql('s')}, 6) AS grouping FROM p""")
def q_share_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I6 over time: why the texts of a period are longer than those of the one before: within topics and languages, by the mix of
    topics, or by the languages' shares."""
    docs = load_table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 4).alias("period"), "text")
    flags = docs.select("lang", "period", (F.length("text") > 2000).cast("int").alias("long_text"), *L.keyword_flag_exprs(F.col("text"), FIXTURE_LEXICON))
    d = frequency.share_change(flags, "lang", "period", L.TOPIC_COLUMNS, "long_text")
    return d.select("lang", "from_period", "to_period", "topic", *[F.round(c, 6).alias(c) for c in ("within", "mix", "grouping")])


# --- A8-A14 / P16 / P17 / M6: evaluation on 19 paired columns --------------------------
# Actual: the keyword labeller.  Scores are a fixed function of n_chars and the
# topic's place k, so the oracle is exact: p = (n_chars * (k + 3) % 200) / 200.

EVAL_TOPICS = L.TOPIC_COLUMNS


def gold_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired wide frame ``{topic}_human`` / ``{topic}_bert`` plus the probabilities ``{topic}_p``."""
    from sparkpanel.functions import numeric as N
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    names = [f"{t}_human" for t in EVAL_TOPICS]
    g = docs.select("doc_id", *L.keyword_flag_exprs(F.col("text"), FIXTURE_LEXICON, names),
                    F.array(*[(F.col("n_chars") * (k + 3) % 200).cast("double") / 200 for k in range(len(EVAL_TOPICS))]).alias("probs"))
    g = g.withColumn("pred", N.binarize(F.col("probs"), 0.5))
    return g.select("doc_id", *names, *[F.col("probs")[k].alias(f"{t}_p") for k, t in enumerate(EVAL_TOPICS)],
                    *[F.col("pred")[k].alias(f"{t}_bert") for k, t in enumerate(EVAL_TOPICS)])


def gold_pairs(spark: SparkSession, sf_dir: str):
    """(wide frame, its pairs of columns, found by their names)"""
    from sparkpanel.operators import reshape
    w = gold_wide(spark, sf_dir)
    return w, reshape.find_pairs(w.columns, "_human", "_bert")


def gold_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import reshape
    w, pairs = gold_pairs(spark, sf_dir)
    return reshape.to_long(w, ["doc_id"], pairs, extra={"prob": {t: f"{t}_p" for t in EVAL_TOPICS}})


def gold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import evaluate as V
    return V.counts_wide(*gold_pairs(spark, sf_dir))


_P_SQL = [f"CAST(n_chars * {k + 3} % 200 AS DOUBLE) / 200" for k in range(len(EVAL_TOPICS))]
_LONG_CTE = f"""
g AS (
  SELECT doc_id, n_chars, {keyword_flags_sql()} FROM documents
), lng AS (
  {" UNION ALL ".join(f"SELECT doc_id, '{t}' AS topic, {q(t)} AS actual, CAST({p} > 0.5 AS INTEGER) AS predicted, {p} AS prob FROM g" for t, p in zip(EVAL_TOPICS, _P_SQL))}
), cnt AS (
  SELECT topic, CAST(count_if(actual = 1 AND predicted = 1) AS BIGINT) AS tp,
         CAST(count_if(actual = 0 AND predicted = 1) AS BIGINT) AS fp,
         CAST(count_if(actual = 1 AND predicted = 0) AS BIGINT) AS fn,
         CAST(count_if(actual = 0 AND predicted = 0) AS BIGINT) AS tn
  FROM lng GROUP BY topic
), prf AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
            CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall
  FROM cnt
), tm AS (
  SELECT topic, precision, recall,
         CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
         CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, tp + fn AS support
  FROM prf
), pooled AS (
  SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cnt
), micro AS (
  SELECT CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM pooled
), micro2 AS (
  SELECT precision, recall,
         CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
  FROM micro
), macro AS (SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM tm
), subset AS (
  SELECT avg(CAST(ok AS DOUBLE)) AS subset_accuracy
  FROM (SELECT doc_id, min(CAST(actual = predicted AS INTEGER)) AS ok FROM lng GROUP BY doc_id)
)"""


@register("confusion", f"""
WITH {_LONG_CTE}, cells AS (
  SELECT topic, 0 AS actual, 0 AS predicted, tn AS n, tp + fp + fn + tn AS tot FROM cnt
  UNION ALL SELECT topic, 0, 1, fp, tp + fp + fn + tn FROM cnt
  UNION ALL SELECT topic, 1, 0, fn, tp + fp + fn + tn FROM cnt
  UNION ALL SELECT topic, 1, 1, tp, tp + fp + fn + tn FROM cnt
)
SELECT topic, actual, predicted, n, round(CASE WHEN tot = 0 THEN 0.0 ELSE CAST(n AS DOUBLE) / tot END, 6) AS share
FROM cells""")
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import evaluate as V
    c = V.confusion(gold_counts(spark, sf_dir))
    return c.select("topic", "actual", "predicted", "n", F.round("share", 6).alias("share"))


def _r6(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("topic_metrics", f"""
WITH {_LONG_CTE}
SELECT topic, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(accuracy, 6) AS accuracy, support FROM tm""")
def q_topic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import evaluate as V
    return _r6(V.topic_metrics(gold_counts(spark, sf_dir)), {"precision", "recall", "f1", "accuracy"})


@register("micro_metrics", f"""
WITH {_LONG_CTE}
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM micro2""")
def q_micro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import evaluate as V
    return _r6(V.micro_metrics(gold_counts(spark, sf_dir)), {"precision", "recall", "f1"})


@register("macro_metrics", f"""
WITH {_LONG_CTE}
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM macro""")
def q_macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import evaluate as V
    return _r6(V.macro_metrics(V.counts(gold_long(spark, sf_dir))), {"precision", "recall", "f1"})


@register("subset_accuracy", f"""
WITH {_LONG_CTE}
SELECT round(subset_accuracy, 6) AS subset_accuracy FROM subset""")
def q_subset_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import evaluate as V
    return _r6(V.subset_accuracy(*gold_pairs(spark, sf_dir)), {"subset_accuracy"})


@register("metrics_summary", f"""
WITH {_LONG_CTE}
SELECT 'micro_precision' AS metric, round(precision, 6) AS value FROM micro2
UNION ALL SELECT 'micro_recall', round(recall, 6) FROM micro2
UNION ALL SELECT 'micro_f1', round(f1, 6) FROM micro2
UNION ALL SELECT 'subset_accuracy', round(subset_accuracy, 6) FROM subset
UNION ALL SELECT 'macro_precision', round(precision, 6) FROM macro
UNION ALL SELECT 'macro_recall', round(recall, 6) FROM macro
UNION ALL SELECT 'macro_f1', round(f1, 6) FROM macro""")
def q_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import evaluate as V
    return _r6(V.metrics_summary(*gold_pairs(spark, sf_dir)), {"value"})


@register("holdout_metrics", f"""
WITH {_LONG_CTE}, c AS (SELECT actual, prob, least(greatest(prob, 1e-7), 1 - 1e-7) AS p,
                               CAST(prob > 0.5 AS INTEGER) AS pred FROM lng
), a AS (
  SELECT avg(-(actual * ln(p) + (1 - actual) * ln(1 - p))) AS loss, avg(CAST(pred = actual AS DOUBLE)) AS accuracy,
         count_if(actual = 1 AND pred = 1) AS tp, count_if(actual = 0 AND pred = 1) AS fp,
         count_if(actual = 1 AND pred = 0) AS fn
  FROM c
)
SELECT round(loss, 6) AS loss, round(accuracy, 6) AS accuracy,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
       round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision
FROM a""")
def q_holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpanel.operators import evaluate as V
    return _r6(V.holdout_metrics(gold_long(spark, sf_dir), "prob"), {"loss", "accuracy", "recall", "precision"})


@register("comparison", f"""
WITH g AS (SELECT doc_id, n_chars, {keyword_flags_sql()} FROM documents)
SELECT doc_id, {", ".join(f"{p} AS p_{t}, {q(t)} AS {t}_actual, CAST({p} > 0.5 AS INTEGER) AS {t}_predicted" for t, p in zip(EVAL_TOPICS, _P_SQL))}
FROM g""")
def q_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: hold-out comparison table - probabilities, packed actual and predicted
    vectors unpacked into ``_actual`` / ``_predicted`` columns."""
    from sparkpanel.functions import numeric as N
    from sparkpanel.operators import reshape
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    s = docs.select("doc_id", F.array(*L.keyword_flag_exprs(F.col("text"), FIXTURE_LEXICON)).alias("actual_labels"),
                    F.array(*[(F.col("n_chars") * (k + 3) % 200).cast("double") / 200 for k in range(len(EVAL_TOPICS))]).alias("predicted_probs"))
    s = s.withColumn("predicted_labels", N.binarize(F.col("predicted_probs"), 0.5))
    s = reshape.unpack(s, "actual_labels", EVAL_TOPICS, "_actual")
    s = reshape.unpack(s, "predicted_labels", EVAL_TOPICS, "_predicted")
    return s.select("doc_id", *[F.col("predicted_probs")[k].alias(f"p_{t}") for k, t in enumerate(EVAL_TOPICS)],
                    *[f"{t}_actual" for t in EVAL_TOPICS], *[f"{t}_predicted" for t in EVAL_TOPICS])


# --- M3 / M4 / M5: topic model -----------------------------------------------------------
# A trained model has no SQL form.  One twin states what must hold for every text: one row each, probabilities
# between 0 and 1, and a label where the probability is over 0.5.  The other computes the hold-out loss of the best
# constant (the training share) and states that the model does better and ranks positive texts higher.

GOLD_TOPICS = ["quality", "toxic"]


def gold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their seeded 80/20 split."""
    from sparkpanel.operators import sampling
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampling.split(load_table(spark, sf_dir, "labels"), TEST_SHARE, SEED, "doc_id").join(docs, "doc_id")


def trained_topics(gold: DataFrame):
    from sparkpanel.operators import joint_model
    return joint_model.fit_joint(gold.filter("split = 'train'"), "text", GOLD_TOPICS, valid=gold.filter("split = 'test'"))


@register("topic_model", "SELECT doc_id, true AS p_in_range, true AS label_follows_p, 2 AS n_labels FROM documents")
def q_topic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on labelled documents with the operator's defaults, score every document."""
    tm = trained_topics(gold_split(spark, sf_dir))
    scored = tm.score(load_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    ok = F.forall("probabilities", lambda p: (p >= 0) & (p <= 1))
    follows = F.forall(F.zip_with("probabilities", "predicted_label", lambda p, y: (p > 0.5).cast("int") == y), lambda x: x)
    return scored.select("doc_id", ok.alias("p_in_range"), follows.alias("label_follows_p"), F.size("predicted_label").alias("n_labels"))


_GOLD_CTE = f"""gold AS (
  SELECT l.doc_id, l.quality, l.toxic, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(l.doc_id AS VARCHAR)), l.doc_id) > ceil({TEST_SHARE} * count(*) OVER ()) AS train
  FROM labels l
), cells AS (SELECT train, unnest([{{'topic': 'quality', 'y': quality}}, {{'topic': 'toxic', 'y': toxic}}], recursive := true) FROM gold JOIN documents USING (doc_id)
), base AS (SELECT topic, avg(y) FILTER (train) AS p, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_test, avg(y) FILTER (NOT train) AS held FROM cells GROUP BY topic)"""


@register("topic_model_quality", f"""
WITH {_GOLD_CTE}
SELECT topic, n_train, n_test, round(-(held * ln(p) + (1 - held) * ln(1 - p)), 6) AS base_loss, true AS beats_base, true AS ranks_positives FROM base""")
def q_topic_model_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3-M5 on the hold-out: the loss against that of the best constant, and the mean probability of positives against negatives."""
    gold = gold_split(spark, sf_dir)
    scored = trained_topics(gold).score(gold, keep=["doc_id", "split", *GOLD_TOPICS])
    each = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(t).alias("y"), F.col("probabilities")[i].alias("p")) for i, t in enumerate(GOLD_TOPICS)])
    cells = scored.select("split", F.inline(each))
    train, test = F.col("split") == "train", F.col("split") == "test"
    y, p = F.col("y"), F.least(F.greatest("p", F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = F.avg(F.when(test, -(y * F.ln(p) + (1 - y) * F.ln(1 - p))))
    base = F.avg(F.when(train, y))
    held = F.avg(F.when(test, y))
    constant = -(held * F.ln(base) + (1 - held) * F.ln(1 - base))
    ranks = F.avg(F.when(test & (y == 1), F.col("p"))) > F.avg(F.when(test & (y == 0), F.col("p")))
    return cells.groupBy("topic").agg(F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"), F.round(constant, 6).alias("base_loss"),
                                      (loss < constant - 0.01).alias("beats_base"), ranks.alias("ranks_positives"))
