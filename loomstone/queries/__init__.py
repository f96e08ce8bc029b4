"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from loomstone.functions.text import spelled

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL where there is one."""

    def register(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = spelled(sql.strip())
        return fn

    return register


def load() -> None:
    from loomstone.queries import aggregates, corpus, dedup, rules, scalars, selection, tokens  # noqa: F401
