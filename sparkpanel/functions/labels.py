"""Topic vocabulary and label expressions.

Everything here is a native column expression: no Python UDF touches a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for right results).
# The 19 topics in their contractual order; every 19-vector uses this order.
TOPICS = [
    "immigration", "climate change", "renewable energy", "traditional energy",
    "inequality", "social policy", "taxation", "labour market",
    "international trade", "economics", "european union", "public health",
    "gender rights", "civil rights", "political rights", "connecting",
    "elections/voting", "self-promotion", "anti-establishment",
]
# Sentinels of the labelling step: the cleaner removes the lower-case one only
# when other topics exist; the fallback for a reply without a function call.
NO_TOPIC = "no topic"
NO_TOPIC_FALLBACK = "No topic"
# Names used for the same positions by the frequency report.
TOPIC_ALIASES = {"european union": "eu", "elections/voting": "elections"}
# ---------------------------------------------------------------------------

ALLOWED_REPLY_VALUES = TOPICS + [NO_TOPIC]


def column_name(topic: str) -> str:
    """Column-safe spelling of a topic: 'elections/voting' -> 'elections_voting'."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", topic).strip("_").lower()


TOPIC_COLUMNS = [column_name(t) for t in TOPICS]


def topic_flag_exprs(label_col: Column, topics=TOPICS, names=None) -> list[Column]:
    """1 if the topic name occurs anywhere in the label string (case-sensitive
    substring).  NULL label text gives 0 (documented deviation: reference crashes)."""
    names = names or [column_name(t) for t in topics]
    return [F.coalesce(label_col.contains(t).cast("int"), F.lit(0)).alias(n)
            for t, n in zip(topics, names)]


def topic_flags_from_array(arr: Column, topics=TOPICS, names=None) -> list[Column]:
    """F1 on a native topic array: list membership (equal to the substring test on
    the 19 names, since none contains another)."""
    names = names or [column_name(t) for t in topics]
    return [F.coalesce(F.array_contains(arr, t).cast("int"), F.lit(0)).alias(n)
            for t, n in zip(topics, names)]


def keyword_flag_exprs(text_col: Column, keywords, names=TOPIC_COLUMNS) -> list[Column]:
    """Keyword labeller (M2): a topic is on when any of its
    keywords is a substring of the lower-cased text.  ``keywords`` holds one
    string or a list of strings per topic."""
    low = F.lower(text_col)
    out = []
    for kw, n in zip(keywords, names):
        kws = [kw] if isinstance(kw, str) else list(kw)
        cond = F.lit(False)
        for k in kws:
            cond = cond | low.contains(k)
        out.append(F.coalesce(cond.cast("int"), F.lit(0)).alias(n))
    return out


def keyword_topics(text_col: Column, keywords, topics=TOPICS) -> Column:
    """Keyword labeller returning the topic list in topic order (empty -> [])."""
    low = F.lower(text_col)
    items = []
    for kw, t in zip(keywords, topics):
        kws = [kw] if isinstance(kw, str) else list(kw)
        cond = F.lit(False)
        for k in kws:
            cond = cond | low.contains(k)
        items.append(F.when(cond, F.lit(t)))
    # drop the NULLs without a lambda (keeps whole-stage codegen and the shared
    # lower(text)); topic names are distinct, so array_except's de-duplication is moot
    return F.array_except(F.array(*items), F.array(F.lit(None).cast("string")))


# --- F2: decode a reply ----------------------------------------------------

def decode_reply(reply: Column) -> Column:
    """reply JSON -> struct(status, topics_json).

    status: 'ok' (topics list kept), 'not_list' (key present but null, text or any
    other non-list: kept as []), 'bad_json' and 'no_topics_key' (rejected), 'no_call'
    (NULL reply: no function call -> ["No topic"]).
    """
    whole = F.try_parse_json(reply)
    topics = F.try_variant_get(whole, "$.topics", "variant")      # JSON null is a value of its own here
    status = (F.when(reply.isNull(), F.lit("no_call"))
              .when(whole.isNull(), F.lit("bad_json"))
              .when(topics.isNull(), F.lit("no_topics_key"))
              .when(F.schema_of_variant(topics).startswith("ARRAY"), F.lit("ok"))
              .otherwise(F.lit("not_list")))
    topics_json = (F.when(status == "ok", F.to_json(topics))
                   .when(status == "no_call", F.lit('["No topic"]'))
                   .when(status == "not_list", F.lit("[]")))
    return F.struct(status.alias("status"), topics_json.alias("topics_json"))


def encode_list(arr: Column) -> Column:
    """list -> JSON text."""
    return F.to_json(arr)


def parse_list(text: Column) -> Column:
    """list literal -> array<string>; anything else (NaN, NULL, scalar,
    malformed, JSON null or boolean items) -> []."""
    parsed = F.from_json(text, "ARRAY<STRING>")
    # a boolean item comes back as its name; as text it would be quoted
    kinds = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    boolean = F.coalesce(F.exists(kinds, lambda v: F.schema_of_variant(v) == "BOOLEAN"), F.lit(False))
    bad = parsed.isNull() | F.exists(parsed, lambda x: x.isNull()) | ~F.ltrim(text).startswith("[") | boolean
    return F.when(bad | text.isNull(), F.array().cast("array<string>")).otherwise(parsed)


def clean_topics(arr: Column) -> Column:
    """drop 'no topic' only when other entries exist (case-sensitive)."""
    return F.when((F.size(arr) > 1) & F.array_contains(arr, NO_TOPIC),
                  F.array_remove(arr, NO_TOPIC)).otherwise(arr)


def invalid_topics(arr: Column, allowed=ALLOWED_REPLY_VALUES) -> Column:
    """entries outside the allowed enum (duplicates kept)."""
    allowed_arr = F.array(*[F.lit(a) for a in allowed])
    return F.filter(arr, lambda x: ~F.array_contains(allowed_arr, x))


def parse_int_array(text: Column) -> Column:
    """'[0, 1, 0]' -> array<int>; strict: a bad item fails the job (ANSI cast)."""
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    items = F.split(inner, ",")
    return F.when(F.trim(inner) == "", F.array().cast("array<int>")).otherwise(
        F.transform(items, lambda x: F.trim(x).cast("int")))


def build_messages(system_prompt: Column, user_text: Column) -> Column:
    """the (system, user) chat message list of one request."""
    return F.array(
        F.struct(F.lit("system").alias("role"), system_prompt.alias("content")),
        F.struct(F.lit("user").alias("role"), user_text.alias("content")),
    )
