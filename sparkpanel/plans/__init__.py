"""Registered queries over the driver's tables, each with its DuckDB oracle.

``text_queries`` covers the labelling and evaluation side, ``panel_queries``
the econometrics side.  ``registry()`` merges both for ``__spark_entry__``.
"""

from __future__ import annotations


def registry():
    from sparkpanel.plans import panel_queries, text_queries
    q = {}
    q.update(text_queries.QUERIES)
    q.update(panel_queries.QUERIES)
    return q


def oracles():
    from sparkpanel.plans import panel_queries, text_queries
    s = {}
    s.update(text_queries.ORACLES)
    s.update(panel_queries.ORACLES)
    return s
