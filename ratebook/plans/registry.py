"""The query registry: each entry pairs a Spark plan with the SQL that states its result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Plain decimal literals are DECIMAL in the checking engine; the library computes in doubles.
_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


def doubles(sql: str) -> str:
    return _DECIMAL.sub(r"\1e0", sql)


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = doubles(sql)
        return fn

    return register
