"""Engagement-shaped views over the driver's tables, each derived once and kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import band, with_scores
from ..operators.percentiles import band_percentiles
from ..params import DRIVER
from ..session import shared_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_items(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, part: DataFrame) -> DataFrame:
    def flagged(flag):
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))

    lines = lineitem.groupBy("l_orderkey").agg(
        flagged("A").alias("qa"), flagged("R").alias("qr"), flagged("N").alias("qn"),
        F.sum("l_quantity").alias("q"), F.sum("l_linenumber").alias("ln"),
        F.sum(F.round(F.col("l_discount") * 100).cast("int")).alias("disc"),
        F.sum(F.round(F.col("l_tax") * 100).cast("int")).alias("tax"), F.min("l_partkey").alias("pk"))
    v, key = F.col("view"), F.col("o_orderkey")
    heads = orders.withColumn("view", F.floor(F.col("o_totalprice") * F.col("o_totalprice") / 1000).cast("long"))
    joined = (heads.join(lines, key == F.col("l_orderkey"))
              .join(customer, F.col("c_custkey") == F.col("o_custkey"))
              .join(part, F.col("p_partkey") == F.col("pk")))
    tall = key % 3 == 0
    return joined.select(
        key.alias("item_id"), F.col("p_name").alias("title"), F.col("o_custkey").alias("owner_id"),
        F.col("o_orderpriority").alias("category"), F.col("c_mktsegment").alias("source"),
        F.col("o_orderdate").alias("pub_ts"), (F.col("q") * 5).cast("long").alias("duration"),
        F.when(tall, 1080).otherwise(1920).alias("width"), F.when(tall, 1920).otherwise(1080).alias("height"),
        F.when(key % 10 == 0, 90).otherwise(0).alias("rotate"), v,
        F.floor(v * F.col("qa") * (1 + key % 4) / 2000).cast("long").alias("coin"),
        F.floor(v * F.col("qr") * (1 + key % 5) / 1500).cast("long").alias("fav"),
        F.floor(v * F.col("qn") / 300).cast("long").alias("like_cnt"),
        F.floor(v * F.col("ln") / 2000.0).cast("long").alias("danmaku"),
        F.floor(v * F.col("disc") / 5000.0).cast("long").alias("share"),
        F.floor(v * F.col("tax") / 5000.0).cast("long").alias("reply"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_table(spark, sf_dir, "items", lambda: build_items(
        *(table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part"))))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with rates, score, baseline, index and tier: the feature table every experiment reads."""
    return shared_table(spark, sf_dir, "scored", lambda: with_scores(items(spark, sf_dir), DRIVER.capture_time))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user_id, item_id, arm)."""
    return shared_table(spark, sf_dir, "edges", lambda: table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("item_id"),
        F.col("l_returnflag").alias("arm")).distinct())


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (part, item). Two items of one part are related, once per shared part; the pairs are never listed."""
    return shared_table(spark, sf_dir, "members", lambda: table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("item")).distinct())


def walk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that earlier walks have reached: those related to an item from before the first walk, and these themselves."""
    held = members(spark, sf_dir)
    seeds = items(spark, sf_dir).filter(F.col("pub_ts") < F.lit(DRIVER.first_walk).cast("timestamp")).select(F.col("item_id").alias("item"))
    parts = held.join(seeds, "item", "left_semi").select("part").distinct()
    return held.join(parts, "part", "left_semi").select(F.col("item").alias("item_id")).distinct()


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items with band, frozen-reference percentile and reference size."""
    def build():
        is_ref = (F.col("pub_ts") < F.lit(DRIVER.reference_cutoff).cast("timestamp")) & (F.col("view") >= 3000)
        return band_percentiles(scored(spark, sf_dir).withColumn("band", band("lv")), is_ref)
    return shared_table(spark, sf_dir, "banded", build)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated snapshots of an item: time, one counter, completeness and an optional metadata field."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("capture_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("counter"), (F.col("event_type") != "error").alias("complete"), "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("extra"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
