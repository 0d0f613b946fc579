"""Mixing sources to target weights: token totals per source, repetition rates, hash-seeded copies.

A source may take at most `max_rate` times its own words. Weights go round over the sources in code point order (null
last); shares above that limit are reshared by weight until none is above it, which is one crossing point of running
sums over the sources ordered by limit / weight. Only that table of sources (one row each) is ordered in one place.
A document is emitted floor(rate) times, and once more with probability equal to the fraction, drawn from the md5 of
its id and a seed, so reruns agree.

Null or empty text: no words, its copies follow its source. A null source is a source of its own. A null id draws as
the text 'null'. Repeated rows draw alike. A source without words keeps rate 1. Extra columns are kept; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reactrix.session import stage

from .common import documents, query, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_RATE = 3.0
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_rates(sized: DataFrame, weights=WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size); staged, so that joins know its size."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    limit = F.col("source_size") * F.lit(max_rate)
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    known = (totals.withColumn("weight", weight).withColumn("limit", limit)
             .withColumn("full_at", F.col("limit") / F.col("weight"))
             .withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
             .withColumn("open_weight", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
             .withColumn("total", F.sum("source_size").over(W.partitionBy())))
    level = (F.col("total") - F.col("before")) / F.col("open_weight")
    settled = known.withColumn("level", F.when(level <= F.col("full_at"), level))
    first = F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least(F.col("limit"), first * F.col("weight"))
    rates = (settled.withColumn("target", target)
             .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(max_rate)))
                         .otherwise(F.lit(1.0))))
    return stage(rates.select("source", "source_size", "target", "rate"), "source-rates")


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """floor(rate), plus one with the fraction's probability."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate and the copies that the mix emits."""
    sized = stage(docs.select("doc_id", "source", word_count(text_of()).alias("size")), "sizes")
    rates = source_rates(sized, weights, max_rate)
    joined = sized.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
    return joined.select("d.doc_id", "d.source", "d.size", "r.source_size", "r.target", "r.rate",
                         copies(F.col("r.rate"), F.col("d.doc_id"), seed).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mixed rows themselves: every column of `docs`, each row as often as its plan says."""
    rates = source_rates(docs.select("source", word_count(text_of()).alias("size")), weights, max_rate)
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(rates.select(F.col("source").alias("rate_source"), "rate"), F.col("row.source").eqNullSafe(F.col("rate_source")))
    times = F.array_repeat(F.lit(0), copies(F.col("rate"), F.col("row.doc_id"), seed).cast("int"))
    return joined.select("row", F.explode(times)).select("row.*")


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
ranked AS (
  SELECT source, source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
filled AS (
  SELECT *, source_size * 3e0 AS lim, source_size * 3e0 / weight AS full_at FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
rates AS (
  SELECT *, least(lim, weight * (SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at)) AS target FROM levels),
draws AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN least(r.target / r.source_size, 3e0) ELSE 1e0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496e0 AS draw
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM draws"""


@query("op9_source_mixing", SQL)
def op9_source_mixing(spark, sf_dir):
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))
