"""The corpus pipeline over `documents`: each stage is written as Parquet and reread as the next one's docs.

Every stage takes and gives the columns of documents, extra ones included, and works on an empty table. Nulls and ties:
language ID drops null texts and texts without a letter; line dedup keeps null texts and lets a null id come first; near
dedup keeps texts without words and rows with a null id, and of equal texts the smallest id; mixing takes null sources last
and counts null texts as size 0, so it takes none of them; packing reads null texts as empty. Repeated rows share one fate
until mixing, which emits each of them as often as its rate says. Texts of any length go through whole.

The result can be read on its own: the rows of a sequence_id in the order of offset hold its token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reactrix.llm import language, lines, minhash, mixing, packing
from reactrix.session import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; texts without a letter and texts of no prevailing language go."""
    return language.keep_identified(docs, language.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat earlier three-line windows; every document stays."""
    return lines.drop_repeated_lines(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word sets that are alike to 0.8 or more."""
    return minhash.drop_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix to target weights takes them."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences, with their token ids; copy_id tells the copies of one document apart."""
    return packing.pack_with_ids(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express language models, MinHash or packing; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
