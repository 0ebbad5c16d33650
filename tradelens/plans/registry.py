"""Where queries register, each with the SQL that another engine answers it by."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None):
    """Registers a function under its name; None where SQL can't express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def plain(sql: str) -> str:
    """A synthesised SELECT (tables in braces) as the other engine reads it."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
