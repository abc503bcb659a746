"""Where queries register themselves: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from offerlake.plans import views as v

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, recursive: bool = False):
    """Register a query; sql is its twin, with the domain relations as common table expressions, some of them recursive."""
    head = "WITH RECURSIVE" if recursive else "WITH"

    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = f"{head} {v.SQL.strip()}{sql}" if sql.startswith(",") else f"{head} {v.SQL.strip()} {sql}"
        return fn

    return add
