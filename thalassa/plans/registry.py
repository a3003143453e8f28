"""The registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, *columns, digits: int = 6):
    """df with these columns rounded, as summation order differs between engines."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
