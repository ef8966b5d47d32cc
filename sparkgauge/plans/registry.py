"""Registry of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def cents_sql(key: str, most: int) -> str:
    """Hours of two digits made from a key by whole numbers, alike in every engine."""
    return f"CAST(({key} * 37 % {most}) * 0.01 AS DECIMAL(18,2))"


def cents(key, most: int):
    return ((key * 37 % most).cast("decimal(18,2)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def doubles(df, *names):
    """The named decimal columns as doubles."""
    return df.withColumns({n: df[n].cast("double") for n in names})
