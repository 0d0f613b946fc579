"""Fitted curves, regressions and depth, expressed as grouped moments and joins on small keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordering as O


def window_curve(scored: DataFrame, start=3.0, stop=7.2, step=0.1, reach=0.35, min_n=25) -> DataFrame:
    """Grid of sliding-window quantiles: each row is copied to the few grid points that can hold it."""
    last = round((stop - start) / step)
    lv = F.col("lv")
    near = F.sequence(
        F.greatest(F.floor((lv - reach - start) / step) - 1, F.lit(0)).cast("int"),
        F.least(F.ceil((lv + reach - start) / step) + 1, F.lit(last)).cast("int"))
    reachable = scored.filter((lv >= start - reach - step) & (lv <= stop + reach + step))
    g = F.lit(start) + F.col("k") * F.lit(step)
    rows = reachable.select("item_id", "lv", "f7", F.explode(F.filter(near, lambda k: (k >= 0) & (k <= last))).alias("k")).filter(
        (lv >= g - F.lit(reach)) & (lv <= g + F.lit(reach)))
    q = O.quantiles(rows, ["k"], {"f7": "f7"}, {"p50": 0.5, "p25": 0.25}).filter(F.col("n") >= min_n)
    return q.select(F.col("k").cast("int").alias("k"), (F.lit(start) + F.col("k") * F.lit(step)).alias("g"), "n",
                    F.round("p50_f7", 4).alias("p50"), F.round("p25_f7", 4).alias("p25"))


def curve_segments(curve: DataFrame, start=3.0, stop=7.2, step=0.1) -> DataFrame:
    """One row per grid cell with the nearest knots on both sides; at most (stop-start)/step + 2 rows."""
    last = round((stop - start) / step)
    cells = curve.sparkSession.range(-1, last + 1).select(F.col("id").cast("int").alias("k")).join(curve.select("k", "g", "p50"), "k", "left")
    left = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    return cells.select(
        "k", F.last("g", True).over(left).alias("x0"), F.last("p50", True).over(left).alias("y0"),
        F.first("g", True).over(right).alias("x1"), F.first("p50", True).over(right).alias("y1"))


def fitted_index(scored: DataFrame, curve: DataFrame, start=3.0, stop=7.2, step=0.1) -> DataFrame:
    """Rate over the fitted curve's expectation, clamped at both ends; the grid table is a bounded broadcast."""
    last = round((stop - start) / step)
    seg = F.broadcast(curve_segments(curve, start, stop, step))
    cell = F.least(F.greatest(F.floor((F.col("lv") - start) / step), F.lit(-1)), F.lit(last)).cast("int")
    inner = F.col("y0") + (F.col("lv") - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    expected = F.when(F.col("x0").isNull(), F.col("y1")).when(F.col("x1").isNull(), F.col("y0")).otherwise(inner)
    return (scored.withColumn("k", cell).join(seg, "k", "left").withColumn("expected", expected)
            .withColumn("fit_index", F.when(F.col("expected") > 0, F.col("f7") / F.col("expected")))
            .drop("k", "x0", "x1", "y0", "y1"))


def chi_square_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Yates-corrected statistic of a 2x2 table."""
    n = (a + b + c + d).cast("double")
    gap = F.greatest(F.abs(a.cast("double") * d - b.cast("double") * c) - n / 2, F.lit(0.0))
    return F.try_divide(n * gap * gap, (a + b).cast("double") * (c + d) * (a + c) * (b + d))


def power_law(rows: DataFrame, keys: Sequence[str], min_n: int = 10) -> DataFrame:
    """log10 rate on log10 view per group: n, a, b and residual mean square from moments."""
    y, x = F.log10(F.greatest("f7", F.lit(1e-6))), F.col("lv")
    return rows.withColumn("_y", y).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_intercept("_y", x).alias("a"), F.regr_slope("_y", x).alias("b"),
        (F.var_pop("_y") - F.regr_slope("_y", x) * F.covar_pop("_y", x)).alias("mse")).filter(F.col("n") >= min_n)


def conditional_residual(df: DataFrame, keys: Sequence[str], y: str, u: str, v: str) -> DataFrame:
    """Residual of y on (1, u, v) inside each group, from group moments joined back."""
    m = df.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in (y, u, v)],
        F.covar_pop(u, u).alias("_uu"), F.covar_pop(v, v).alias("_vv"), F.covar_pop(u, v).alias("_uv"),
        F.covar_pop(y, u).alias("_yu"), F.covar_pop(y, v).alias("_yv"))
    det = F.col("_uu") * F.col("_vv") - F.col("_uv") * F.col("_uv")
    m = m.withColumn("_b1", F.when(det > 1e-12, (F.col("_yu") * F.col("_vv") - F.col("_yv") * F.col("_uv")) / det)).withColumn(
        "_b2", F.when(det > 1e-12, (F.col("_yv") * F.col("_uu") - F.col("_yu") * F.col("_uv")) / det))
    out = df.join(m.select(*keys, "_n", "_b1", "_b2", *[f"_m_{c}" for c in (y, u, v)]), list(keys))
    resid = (F.col(y) - F.col(f"_m_{y}")) - F.col("_b1") * (F.col(u) - F.col(f"_m_{u}")) - F.col("_b2") * (F.col(v) - F.col(f"_m_{v}"))
    return out.withColumn("residual", resid).withColumnRenamed("_n", "cell_n").drop("_b1", "_b2", *[f"_m_{c}" for c in (y, u, v)])


def lorenz(df: DataFrame, scope: str, value: str) -> DataFrame:
    """Rows ordered from the largest value with rank, running total and group total (skew-safe)."""
    out = O.positions(df, [scope], [F.desc(value), "item_id"], weights=[value])
    return out.withColumn("rank", F.col("pos") + 1).withColumn("running", F.col(f"{value}_before") + F.col(value)).withColumnRenamed(f"{value}_total", "total")
