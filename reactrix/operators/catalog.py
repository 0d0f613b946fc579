"""Catalogue merge: population and graph nodes, frozen-reference percentiles, blacklist, approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import band, log_view
from .percentiles import band_percentiles


def merge_pool(population: DataFrame, nodes: DataFrame) -> DataFrame:
    """Population rows win; nodes fill their missing day and category; node-only rows get counts from rates."""
    n = nodes.select("item_id", *[F.col(c).alias(f"n_{c}") for c in nodes.columns if c != "item_id"])
    both = population.withColumn("_pop", F.lit(True)).join(n, "item_id", "full_outer")
    pop = F.coalesce("_pop", F.lit(False))

    def counted(name, rate):
        estimate = F.rint(F.col(f"n_{rate}") * F.col("n_view")).cast("long")
        return F.when(pop, F.col(name)).otherwise(F.coalesce(F.col(f"n_{name}"), estimate)).alias(name)

    return both.select(
        "item_id", F.when(pop, "population").otherwise("node").alias("origin"),
        *[F.when(pop, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c) for c in ("title", "view", "duration", "owner_id")],
        F.coalesce("pub_day", "n_pub_day").alias("pub_day"),
        F.when(F.col("category").isNull() | (F.col("category") == "other"), F.coalesce("n_category", "category", F.lit("other"))).otherwise(F.col("category")).alias("category"),
        F.least("first_seen", "n_first_seen").alias("first_seen"),
        (~pop & F.col("n_coin").isNull()).alias("approximate"),
        counted("coin", "coin_rate"), counted("fav", "fav_rate"), counted("like_cnt", "like_rate"))


def with_percentile(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Rates, band and the percentile of each row among the frozen reference of its band."""
    v = F.greatest(F.col("view"), F.lit(1))
    rows = rows.withColumns({"coin_rate": F.col("coin") / v, "fav_rate": F.col("fav") / v, "like_rate": F.col("like_cnt") / v, "band": band(log_view())})
    ref = reference.select(F.lit(True).alias("_is_ref"), "item_id", "view", "coin_rate", "band")
    both = rows.withColumn("_is_ref", F.lit(False)).unionByName(ref, allowMissingColumns=True)
    return band_percentiles(both, F.col("_is_ref")).filter(~F.col("_is_ref")).drop("_is_ref")


def approve(requested: DataFrame, approved: DataFrame, catalogue: DataFrame, short_max: int = 150) -> DataFrame:
    """Accept or reject each requested id with the reason; the note falls back to 80 title characters."""
    rows = requested.join(approved.select("item_id", F.lit(True).alias("_done")), "item_id", "left").join(
        catalogue.select("item_id", "title", "duration", F.lit(True).alias("_known")), "item_id", "left")
    outcome = (F.when(F.col("_done"), "already_approved").when(F.col("_known").isNull(), "unknown")
               .when(F.col("duration") <= short_max, "too_short").otherwise("accepted"))
    note = F.when(F.trim(F.coalesce("note", F.lit(""))) != "", F.col("note")).otherwise(F.substring("title", 1, 80))
    return rows.select("item_id", outcome.alias("outcome"), F.when(outcome == "accepted", note).alias("note"))


def hop_stops(hops: DataFrame, first: int, ratio_floor=0.95, absolute=0.8, least_seeds=10, last_hop=6) -> DataFrame:
    """Hop rates in order with the ratio to the previous hop; rows up to and including the first stop.

    `hops` has one row per hop, a handful in all, joined to its predecessor by number.
    """
    prev = hops.select((F.col("hop") + 1).alias("hop"), F.col("rate").alias("prev"))
    base = hops.filter(F.col("hop") == first).select("rate").scalar()
    rho = F.try_divide(F.col("rate"), F.col("prev"))
    reason = (F.when(rho < ratio_floor, "ratio").when(F.col("rate") < absolute * base, "floor")
              .when(F.col("n_seeds") < least_seeds, "seeds").when(F.col("hop") > last_hop, "depth"))
    rows = hops.join(prev, "hop", "left").withColumn("rho", rho).withColumn("reason", F.when(F.col("hop") > first, reason))
    stop = rows.filter("reason is not null").agg(F.min("hop").alias("s")).scalar()
    return rows.filter(stop.isNull() | (F.col("hop") <= stop)).drop("prev")
