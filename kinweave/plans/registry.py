"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def note(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return note


def r6(c) -> F.Column:
    return F.round(c if isinstance(c, F.Column) else F.col(c), 6)
