"""Text encoding for a fixed-length model input.

Word tokens (ASCII letters and digits, lower-cased), truncated to ``max_len``
and right-padded with ``[PAD]``; the mask marks real tokens.  The whole text is
tokenised; only the model input is cut.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = "[PAD]"
TOKEN_PATTERN = "[A-Za-z0-9]+"


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), 0)
    return F.transform(found, lambda t: F.lower(t))


def encode(text: Column, max_len: int) -> Column:
    """struct(tokens[max_len], mask[max_len], n_tokens, truncated)."""
    tok = tokens(text)
    n = F.size(tok)
    cut = F.slice(tok, 1, max_len)
    pad = F.greatest(F.lit(max_len) - F.size(cut), F.lit(0))
    padded = F.concat(cut, F.array_repeat(F.lit(PAD), pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(cut)), F.array_repeat(F.lit(0), pad))
    return F.struct(padded.alias("tokens"), mask.alias("mask"), n.alias("n_tokens"), (n > max_len).alias("truncated"))
