"""Exact duplicates by content sort.

Normalised texts (A-Z lower-cased) are range-partitioned between sampled splitters and sorted externally, so equal texts
lie next to each other; runs of equal neighbours are found by comparing whole texts. Splitter keys hold 64 characters of
the text, a 64-bit digest and a salt of the id: bounded in size, and a text that a third of the rows share is spread
over `salts` runs. Runs of one text then meet by SHA-256 as one row per run, never as one row per copy.

Null text counts as empty. A null id never wins over another id; a group of null ids keeps all of them. Repeated rows
(same id and text) share one fate. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reactrix.session import stage

from .common import ascii_lower, documents, partitions, query, text_of

SALTS = 64


def exact_duplicates(docs: DataFrame, keep: str = "smallest", salts: int = SALTS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. `keep` names which id of a group stays."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    n = partitions(docs.sparkSession)
    keyed = docs.select("doc_id", ascii_lower(text_of()).alias("norm")).select(
        "doc_id", "norm", F.substring("norm", 1, 64).alias("head"), F.xxhash64("norm").alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    ranged = keyed.repartitionByRange(n, "head", "digest", "salt")
    run = W.partitionBy("norm", "salt", "head", "digest")
    narrow = ranged.select(
        "doc_id", "salt", F.sha2("norm", 256).alias("text_sha256"), best("doc_id").over(run).alias("run_id"),
        F.count(F.lit(1)).over(run).alias("run_size"), F.row_number().over(run.orderBy("doc_id")).alias("place"))
    rows = stage(narrow, "content-runs")
    runs = rows.filter("place = 1").select("text_sha256", "salt", "run_id", "run_size")
    groups = runs.groupBy("text_sha256").agg(best("run_id").alias("keep_id"), F.sum("run_size").alias("group_size"))
    known = runs.select("text_sha256", "salt").join(groups, "text_sha256")
    return rows.join(known, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)"""


@query("op3_content_sort_dedup", SQL)
def op3_content_sort_dedup(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir), keep="largest")
