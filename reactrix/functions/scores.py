"""Column functions for scores, baselines, tiers and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zero(x) -> Column:
    return F.coalesce(_c(x), F.lit(0))


def raw_score(fav="fav", coin="coin", like="like_cnt", weights=(P.W_FAV, P.W_COIN, P.W_LIKE)) -> Column:
    wf, wc, wl = (w if isinstance(w, Column) else F.lit(float(w)) for w in weights)
    return wf * zero(fav) + wc * zero(coin) + wl * zero(like)


def denominator(mode: str, view="view") -> Column:
    view = zero(view)
    return {
        "view": F.greatest(view, F.lit(1)).cast("double"),
        "sqrt": F.sqrt(F.greatest(view, F.lit(1))),
        "log": F.log10(F.greatest(view, F.lit(10))),
    }[mode]


def weighted_ratio(mode: str = "view", weights=(P.W_FAV, P.W_COIN, P.W_LIKE), view="view", **counters) -> Column:
    return F.when(zero(view) > 0, raw_score(weights=weights, **counters) / denominator(mode, view)).otherwise(F.lit(0.0))


def f7(view="view", **counters) -> Column:
    return weighted_ratio("view", view=view, **counters)


def log_view(view="view") -> Column:
    return F.log10(F.greatest(_c(view), F.lit(10)))


def baseline(lv: Column | str, curve=P.BASELINE, start=P.BASELINE_START, step=P.BASELINE_STEP) -> Column:
    """Piecewise-linear curve on an even grid, flat beyond both ends; two array look-ups per row."""
    lv = _c(lv)
    last = len(curve) - 1
    knots = F.array(*[F.lit(float(y)) for y in curve])
    k = F.least(F.greatest(F.floor((lv - F.lit(start)) / F.lit(step)), F.lit(0)), F.lit(last - 1)).cast("int")
    left, right = F.element_at(knots, k + 1), F.element_at(knots, k + 2)
    inner = left + (lv - (F.lit(start) + k * F.lit(step))) / F.lit(step) * (right - left)
    return (F.when(lv <= start, F.lit(float(curve[0])))
            .when(lv >= start + step * last, F.lit(float(curve[last]))).otherwise(inner))


def absolute_tier(ratio="f7", view="view") -> Column:
    out = F.when(_c(view) < P.MIN_VIEW, "unproven")
    for name, line in P.ABSOLUTE_TIERS:
        out = out.when(_c(ratio) >= line, name)
    return out.otherwise("junk")


def relative_tier(index="cbi", view="view") -> Column:
    out = F.when(_c(view).isNull() | (_c(view) < P.MIN_VIEW), "unproven")
    for name, line in P.RELATIVE_TIERS:
        out = out.when(_c(index) >= line, name)
    return out.otherwise("junk")


def rate(counter, view="view") -> Column:
    return F.coalesce(F.try_divide(zero(counter).cast("double"), _c(view).cast("double")), F.lit(0.0))


def portrait(width="width", height="height", rotate="rotate") -> Column:
    turned = F.coalesce(_c(rotate), F.lit(0)).isin(90, 270)
    w = F.when(turned, _c(height)).otherwise(_c(width))
    h = F.when(turned, _c(width)).otherwise(_c(height))
    return F.when((zero(w) == 0) | (zero(h) == 0), F.lit(None).cast("boolean")).otherwise(w / h < P.PORTRAIT_RATIO)


def band(lv: Column | str, width: float = P.BAND_WIDTH) -> Column:
    """Half-even rounding, as the band key is defined."""
    return F.rint(_c(lv) / F.lit(width)).cast("long")


def with_scores(items: DataFrame, capture_time: str) -> DataFrame:
    """Shared feature frame: rates, F7, baseline, index, tier, year, age in days at the capture time."""
    age = (F.unix_timestamp(F.lit(capture_time).cast("timestamp")) - F.unix_timestamp("pub_ts")) / 86400.0
    return (
        items.select(
            "*", f7().alias("f7"), log_view().alias("lv"),
            *[rate(c).alias(f"{n}_rate") for n, c in (
                ("like", "like_cnt"), ("coin", "coin"), ("fav", "fav"),
                ("danmaku", "danmaku"), ("share", "share"), ("reply", "reply"))],
            rate(zero("danmaku") + zero("share") + zero("reply")).alias("social"),
            F.year("pub_ts").cast("long").alias("year"), F.greatest(age, F.lit(0.1)).alias("age"))
        .withColumn("base", baseline("lv"))
        .withColumn("cbi", F.col("f7") / F.col("base"))
        .withColumn("tier", relative_tier())
    )
