"""Closed-form statistics as Columns, and hash draws both engines can repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import positions

# Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7.
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1.0 / (1.0 + ERFC_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERFC_A):
        poly = (poly + F.lit(a)) * t
    tail = poly * F.exp(-z * z)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def draw(key: Column, n: Column | int) -> Column:
    """Repeatable integer in [0, n) from a text key (32 bits of md5)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def rank_sum(df: DataFrame, groups: Sequence[str], value: str, is_x: str, tie: Sequence[str] = ("item_id",)) -> DataFrame:
    """Mann-Whitney per group: n_x, n_y, one-sided z (no tie correction) with p, two-sided p with ties and continuity."""
    narrow = df.filter(F.col(value).isNotNull()).select(*groups, value, is_x, *tie)
    ranked = positions(narrow, list(groups), [value, *tie], ties=[value])
    mid = (F.col("tie_first") + F.col("tie_last")) / 2.0 + 1.0
    run = F.col("tie_last") - F.col("tie_first") + 1
    sums = ranked.groupBy(*groups).agg(
        F.count_if(is_x).alias("n_x"), F.count_if(~F.col(is_x)).alias("n_y"),
        F.sum(F.when(F.col(is_x), mid)).alias("_r"), F.sum(run * run - 1).alias("_ties"))
    return rank_sum_test(sums)


def rank_sum_test(sums: DataFrame) -> DataFrame:
    """Test columns from n_x, n_y, rank sum _r of x, and tie term _ties."""
    n1, n2 = F.col("n_x").cast("double"), F.col("n_y").cast("double")
    u, mu, n = F.col("_r") - n1 * (n1 + 1) / 2, n1 * n2 / 2, n1 + n2
    enough = (n1 >= 5) & (n2 >= 5)
    z = F.when(enough, (u - mu) / F.sqrt(n1 * n2 * (n + 1) / 12))
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z2 = F.greatest(F.abs(u - mu) - 0.5, F.lit(0.0)) / sigma
    return (sums.withColumn("z", z).withColumn("p_greater", 0.5 * erfc(F.col("z") / F.sqrt(F.lit(2.0))))
            .withColumn("p_two", F.when(enough, erfc(z2 / F.sqrt(F.lit(2.0))))).drop("_r", "_ties"))


def partial_one(ab: Column, ac: Column, bc: Column) -> Column:
    """Correlation of a and b with c held."""
    return (ab - ac * bc) / F.sqrt((1 - ac * ac) * (1 - bc * bc))


def within_correlations(df: DataFrame, columns: Sequence[str], zone: str | None = None) -> DataFrame:
    """One row with r_<a>_<b>; with a zone, after removing zone means (same as zone dummies), from moment sums only."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    means = {c: df.agg(F.avg(c).alias("m")).scalar() for c in columns}
    shifted = df.select(*([zone] if zone else []), *[(F.col(c) - means[c]).alias(c) for c in columns])
    sums = shifted.groupBy(*([zone] if zone else [])).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns],
        *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in pairs])
    moments = sums.agg(*[F.sum(F.col(f"s_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")).alias(f"c_{a}_{b}") for a, b in pairs])
    return moments.select(*[
        (F.col(f"c_{a}_{b}") / F.sqrt(F.col(f"c_{a}_{a}") * F.col(f"c_{b}_{b}"))).alias(f"r_{a}_{b}") for a, b in pairs if a != b])


def partial_from(r: DataFrame, y: str, x: str, controls: Sequence[str], order: Sequence[str]) -> Column:
    """Partial correlation by recursion over the correlation row."""
    def corr(a, b, given):
        if not given:
            a, b = sorted((a, b), key=list(order).index)
            return F.col(f"r_{a}_{b}")
        *rest, c = given
        return partial_one(corr(a, b, rest), corr(a, c, rest), corr(b, c, rest))
    return corr(y, x, list(controls))
