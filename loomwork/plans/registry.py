"""Collects a module's queries: name -> (function, SQL or None)."""

from __future__ import annotations


def registry():
    queries = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = (f, sql)
            return f

        return add

    return queries, query
