"""Collects the registered queries and their SQL."""

from __future__ import annotations

from fundamentals_spark.plans import queries_core, queries_evidence, queries_more, queries_rules

_MODULES = (queries_core, queries_evidence, queries_more, queries_rules)


def queries():
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
