"""Small helpers that write the DuckDB oracle SQL text for the registered queries."""

from __future__ import annotations

from sparkpanel.functions.labels import TOPIC_COLUMNS

#: One lower-case substring per topic, in topic order: the keyword labeller's words for the driver's invented texts.
FIXTURE_LEXICON = ["with", "this", "from", "that", "license", "que", "und", "der", "les", "los", "tion", "thble",
                   "erly", "anan", "onou", "thwh", "ering", "ertion", "thing"]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def keyword_flags_sql(text: str = "text", keywords=FIXTURE_LEXICON, names=TOPIC_COLUMNS) -> str:
    return ",\n  ".join(f"CAST(strpos(lower({text}), {lit(k)}) > 0 AS INTEGER) AS {q(n)}"
                        for k, n in zip(keywords, names))


def stack_sql(source: str, cols: list[str], labels: list[str], value: str = "n") -> str:
    return "\nUNION ALL ".join(
        f"SELECT {i} AS position, {lit(lab)} AS topic, {q(c)} AS {value} FROM {source}"
        for i, (c, lab) in enumerate(zip(cols, labels), start=1))
