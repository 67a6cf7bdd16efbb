"""Registered queries: each has a Spark callable and, where SQL can say it, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import WHITE
from tidemark.views import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`; `sql` is the full text to compare its result with."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return register


def with_views(views: Sequence[str], body: str, recursive: bool = False) -> str:
    """SQL that starts from the named domain views; `body` continues the WITH list or selects."""
    ctes = ",\n".join(f"{v} AS ({SQL[v].strip()})" for v in views)
    body = body.strip()
    joiner = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{joiner}{body}"


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round for comparison; adding zero turns minus zero into zero."""
    return df.withColumns({c: F.round(F.col(c), n) + F.lit(0.0) for c, n in digits.items()})


def rounded_sql(digits: dict[str, int]) -> str:
    return ", ".join(f"CASE WHEN round({c}, {n}) = 0 THEN 0e0 ELSE round({c}, {n}) END AS {c}"
                     for c, n in digits.items())


def stripped(text: str) -> str:
    """SQL for a text without any white space at its ends, as `functions.text.strip` takes it off."""
    return f"trim({text}, '{WHITE}')"


def load_all() -> None:
    from tidemark.catalog import (  # noqa: F401
        daily, evaluation, feeds, macro, models, news, scans, similar, stores, streams, text, ticks)
