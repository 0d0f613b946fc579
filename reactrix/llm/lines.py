"""Line dedup by overlapping three-line windows.

The md5 of every run of three consecutive lines is counted over all documents. A window's first occurrence, by document
id, text digest and position, stays; each later one covers its three lines, covered positions are merged and removed.
Every removed line has an equal line earlier, and the earliest is never covered, so no content is lost.

Windows travel as (digest, id, position) rows. Counting combines before the shuffle, and the join back from repeated
windows to their occurrences is a plain keyed join without an aggregate on its key, which adaptive execution splits
when one window holds a large share of the rows.

Null text has no lines and stays null. Texts of fewer than three lines and empty texts are left alone. Repeated rows
(same id and text) count as one occurrence of each place and share one fate. A null id comes first in the order. Extra
columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, query, replace_columns

WIDTH = 3


def _windows(lines: Column, width: int) -> Column:
    return F.when(F.size(lines) >= width, F.transform(
        F.sequence(F.lit(1), F.size(lines) - (width - 1)),
        lambda i: F.unhex(F.md5(F.array_join(F.slice(lines, i, width), "\n").cast("binary")))))


def later_occurrences(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(line_doc, line_digest, starts): sorted start positions of the windows that repeat an earlier one."""
    split = docs.select(F.col("doc_id").alias("line_doc"), F.md5("text").alias("line_digest"), F.split("text", "\n", -1).alias("lines"))
    windows = split.select("line_doc", "line_digest", F.posexplode(_windows(F.col("lines"), width)).alias("start", "digest"))
    place = F.struct("line_doc", "line_digest", "start")
    first = windows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, "digest").filter(place > F.col("first"))
    return later.groupBy("line_doc", "line_digest").agg(F.array_sort(F.collect_set("start")).alias("starts"))


def drop_repeated_lines(docs: DataFrame, width: int = WIDTH, counts: bool = True) -> DataFrame:
    """Every row and column of `docs` with the text without repeated lines, n_chars to match where there is one, and
    the counts line_total and line_removed, which take the place of input columns of these names. Without `counts` exactly
    the input's columns, such ones unchanged."""
    later = later_occurrences(docs, width)
    rows = docs.select(F.struct("*").alias("row"), F.md5("text").alias("digest"))
    joined = rows.join(later, F.col("row.doc_id").eqNullSafe(F.col("line_doc")) & (F.col("digest") == F.col("line_digest")), "left")
    lines = joined.select("row", F.split("row.text", "\n", -1).alias("lines"),
                          F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1)))).alias("covered"))
    numbered = lines.select("row", "lines", F.when(F.col("covered").isNotNull(), F.array_except(
        F.sequence(F.lit(0), F.size("lines") - 1), "covered")).alias("left"))
    text = F.when(F.col("left").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform("left", lambda i: F.element_at("lines", i + 1)), "\n"))
    total = F.coalesce(F.size("lines"), F.lit(0))
    cut = numbered.select("row", text.alias("cut"), F.when(total < 0, 0).otherwise(total).cast("long").alias("line_total"),
                          F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("line_removed"),
                          F.col("left").isNotNull().alias("changed"))
    new = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("cut").cast("long")).otherwise(F.col("row.n_chars"))
    if not counts:
        return cut.select(*replace_columns(docs, new))
    made = ("line_total", "line_removed")
    kept = docs.select(*(f"`{c}`" for c in docs.columns if c not in made))
    return cut.select(*replace_columns(kept, new), *made)


SQL = """
WITH lines AS (
  SELECT doc_id, md5(text) AS digest, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT *, line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS win FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS place FROM windows WHERE win IS NOT NULL)
  WHERE place > 1),
covered AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, (SELECT unnest([0, 1, 2]) AS d)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
  FROM lines l WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = l.doc_id AND c.pos = l.pos) GROUP BY doc_id),
totals AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS line_total, CAST(coalesce(t.n, 0) - coalesce(k.n, 0) AS BIGINT) AS line_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN totals t ON t.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""


@query("op10_line_windows", SQL)
def op10_line_windows(spark, sf_dir):
    return drop_repeated_lines(documents(spark, sf_dir)).select("doc_id", "line_total", "line_removed", "text")
