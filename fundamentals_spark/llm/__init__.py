"""Operators for training-data pipelines: tokenising, scoring, mixing, privacy, search, deduplication and scans.

Nothing outside this subpackage imports it. Each operator lives in one module, and ``queries`` holds the registered
queries with their SQL.
"""
