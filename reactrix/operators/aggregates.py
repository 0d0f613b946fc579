"""Grouped summaries of scored items.  Every order statistic goes through exact range positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O


def is_high() -> Column:
    return F.col("tier") == "high"


def is_good() -> Column:
    return F.col("tier").isin("high", "good")


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def rates_by(df: DataFrame, keys: Sequence[str], min_n: int = 1) -> DataFrame:
    """n, high count and rate, good count and rate, mean index per group."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(is_high()).alias("high"), share(is_high()).alias("high_rate"),
        F.count_if(is_good()).alias("good"), share(is_good()).alias("good_rate"), F.avg("cbi").alias("mean_index"),
    ).filter(F.col("n") >= min_n)


def medians_by(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column | str] | Sequence[str], min_n: int = 1,
               method: str = "linear", prefix: str = "med") -> DataFrame:
    """n and the median of several measures per group; `upper` takes the sorted value at index n//2."""
    if not isinstance(measures, Mapping):
        measures = {m: m for m in measures}
    return O.quantiles(df, keys, measures, {prefix: 0.5}, method=method).filter(F.col("n") >= min_n)


def bands(value: Column, edges: Sequence[tuple[float, float, str]]) -> Column:
    """Half-open bands [lo, hi) by name, null outside."""
    out = F.when(F.lit(False), "")
    for lo, hi, name in edges:
        out = out.when((value >= lo) & (value < hi), name)
    return out


def suggest_thresholds(df: DataFrame, subset: Column) -> DataFrame:
    """P80/P50/P25 of the subset, of all rows when it is empty, and the correlation with log exposure."""
    both = df.select("item_id", "f7", F.explode(F.array_compact(F.array(
        F.lit("all"), F.when(subset, F.lit("subset"))))).alias("grp"))
    q = O.quantiles(both, ["grp"], {"f7": "f7"}, {"p80": 0.8, "p50": 0.5, "p25": 0.25})

    def pick(col):
        return F.coalesce(F.max(F.when(F.col("grp") == "subset", F.col(col))), F.max(F.when(F.col("grp") == "all", F.col(col))))

    corr = df.agg(F.corr("f7", "lv").alias("c"))
    return q.agg(pick("p80_f7").alias("high"), pick("p50_f7").alias("normal"), pick("p25_f7").alias("low")).withColumn(
        "corr_log_view", corr.scalar())


def ends(df: DataFrame, value: str, k: int) -> DataFrame:
    """k highest and k lowest rows by a value, ids breaking ties."""
    top = df.orderBy(F.desc(value), "item_id").limit(k).withColumn("side", F.lit("highest"))
    low = df.orderBy(F.asc(value), "item_id").limit(k).withColumn("side", F.lit("lowest"))
    return top.unionByName(low)


def row_at_median(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The one row per group at index n//2 by a measure."""
    return O.positions(df, keys, [by, "item_id"]).filter(F.col("pos") == F.floor(F.col("group_n") / 2))


def user_frame(edges: DataFrame, scored: DataFrame) -> DataFrame:
    """Collector edges with the scored item behind each."""
    return edges.join(scored, "item_id")


def shared_by(edges: DataFrame) -> DataFrame:
    """Distinct collectors per item."""
    return edges.groupBy("item_id").agg(F.countDistinct("user_id").alias("collectors"))
