"""Within-band percentiles of a value against a frozen reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import positions


def band_percentiles(df: DataFrame, is_ref, value: str = "coin_rate", groups=("band",), tie: str = "item_id") -> DataFrame:
    """Share of the reference values of the row's band strictly below the row's value; null under 3 values."""
    tagged = df.withColumn("_ref", F.when(is_ref, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    ranked = positions(tagged, list(groups), [value, tie], ties=[value], weights=["_ref"])
    known = (F.col("view") >= 3000) & (F.col("_ref_total") >= 3) & F.col(value).isNotNull() & ~F.isnan(value)
    return ranked.withColumn("ref_n", F.col("_ref_total")).withColumn(
        "pct", F.when(known, F.col("_ref_below") / F.col("_ref_total"))
    ).drop("_ref", "_ref_total", "_ref_before", "_ref_below", "pos", "group_n", "tie_first", "tie_last")
