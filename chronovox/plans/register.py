"""A small table of queries: a decorator adds a query, with the derived tables it takes and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from chronovox.plans.derived import frame, with_tables


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict = {}

    def query(*tables: str, sql: str | None = None):
        def add(fn):
            def run(spark, sf_dir):
                return fn(*[frame(spark, sf_dir, t) for t in tables])

            run.__doc__ = fn.__doc__
            queries[fn.__name__] = run
            if sql is not None:
                derived = [t for t in tables if t in _derived()]
                oracles[fn.__name__] = with_tables(sql, *derived) if derived else sql
            return fn

        return add

    return queries, oracles, query


def _derived() -> dict:
    from chronovox.plans.derived import TABLES

    return TABLES
