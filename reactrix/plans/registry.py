"""Named queries: a callable over (spark, sf_dir) and, where SQL can say it, the DuckDB text to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .oracle import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TEXTS: dict[str, tuple[list[str], str]] = {}
SHARED_SQL: dict[str, tuple[list[str], str]] = {}
DIGITS = 6


def present(df: DataFrame) -> DataFrame:
    """Stable output types: doubles at 6 digits (no negative zero), whole numbers as long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, views=(), sql: str | None = None):
    """Register `fn(spark, sf_dir)`; `sql` is prefixed with the named views."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: present(fn(spark, sf_dir))
        if sql is not None:
            _TEXTS[name] = (list(views), sql)
        return fn
    return register


def shared_sql(name: str, needs, text: str) -> None:
    SHARED_SQL[name] = (list(needs), text)


def oracles() -> dict[str, str]:
    return {name: with_views(views, sql, SHARED_SQL) for name, (views, sql) in _TEXTS.items()}
