"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from gaugeworks.plans.facts_sql import FACTS

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None, *ctes: str):
    """Registers a query with its SQL, which may use the CTEs given (facts by default)."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {', '.join(ctes or (FACTS,))} {sql}" if ctes != ("",) else sql
        return f

    return register
