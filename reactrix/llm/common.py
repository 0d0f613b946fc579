"""Helpers shared by the document operators."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Registered by the operator modules: callables over (spark, sf_dir), and the DuckDB text where SQL can say it.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only; `lower` would change other letters too."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which has to follow the data size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, rows: int = 500):
    """Record batches of fewer rows, so that a task holds few whole texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc32_text(column: Column) -> Column:
    """crc32 of the value as text, null as an empty text; decides what a model may learn from."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def replace_columns(docs: DataFrame, new: dict[str, Column]) -> list[Column]:
    """Select list that keeps every column of `docs` and its order, with some of them replaced."""
    return [new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]
