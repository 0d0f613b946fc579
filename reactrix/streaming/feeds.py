"""Streams over arriving capture files: verdict counts, verdict reuse, snapshot state, daily new items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ordering import range_layout
from ..operators import captures as C
from ..operators import rules as R
from ..params import FeedRules
from ..session import drop_stage, shared_dir, stage


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def verdict_counts(feed: DataFrame, rules: FeedRules) -> DataFrame:
    """Each arriving row is judged once; running counts per first reason."""
    judged = R.feed_verdict(feed, rules)
    return judged.groupBy(F.coalesce("first_reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("n"), F.count_if("hide").alias("cut"), F.sum("view").alias("views"))


def sighting_rows(feed: DataFrame, key: str = "item_id", ts: str = "ts") -> DataFrame:
    """The distinct (key, ts) of all sightings, each one state row of its own: late files change the past, none is dropped."""
    return feed.filter(F.col(ts).isNotNull()).select(key, F.col(ts).alias("ts")).dropDuplicates([key, "ts"])


def _links(rows: DataFrame, minutes: int, key: str) -> DataFrame:
    """(key, at, to): per sighting the item's first sighting at least `minutes` later; the last ones have none.

    Sightings and due times lie in one range-partitioned order. A due time takes the next sighting of its own partition,
    or the first one of the partitions behind, of which there is one row each.
    """
    seen = rows.select(key, F.col("at").alias("spot"), F.lit(1).alias("seen"), "at")
    due = rows.select(key, (F.col("at") + minutes * 60_000_000).alias("spot"), F.lit(0).alias("seen"), "at")
    laid = range_layout(seen.union(due), [key, "spot", "seen"])
    sighting = F.when(F.col("seen") == 1, F.struct("_mid", F.col(key).alias("key"), "at"))
    behind = Window.orderBy(F.desc("_pid")).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    heads = laid.groupBy("_pid").agg(F.min(sighting).alias("head")).select("_pid", F.last("head", ignorenulls=True).over(behind).alias("behind"))
    local = Window.partitionBy("_pid").orderBy(F.desc("_mid")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = laid.withColumn("ahead", F.last(sighting, ignorenulls=True).over(local)).filter("seen = 0").join(F.broadcast(heads), "_pid")
    found = ahead.select(F.col(key), "at", F.coalesce("ahead", "behind").alias("next"))
    return found.filter(F.col("next.key").eqNullSafe(F.col(key))).select(key, "at", F.col("next.at").alias("to"))


def judgement_rows(rows: DataFrame, minutes: int = 1440, key: str = "item_id") -> DataFrame:
    """(key, ts) of each judgement among distinct (key, ts): the first sighting, then each one at least `minutes` after the
    last judgement.

    The links from a sighting to its next due one are followed from each item's first sighting by pointer doubling: a
    round doubles the length of the links and the followed distance, so rounds grow with the logarithm of the judgements
    of one item. Each round is written to the shared folder. No item is gathered in one row or task.
    """
    if minutes <= 0:
        return rows.select(key, "ts")
    rows = stage(rows.select(key, F.unix_micros("ts").alias("at")), "sightings")
    links = stage(_links(rows, minutes, key), "links")
    judged = [stage(rows.groupBy(key).agg(F.min("at").alias("at")), "judged")]
    while True:
        done = judged[0]
        for part in judged[1:]:
            done = done.union(part)
        near, far = done.alias("near"), links.alias("far")
        same = F.col(f"near.{key}").eqNullSafe(F.col(f"far.{key}"))
        new = stage(near.join(far, same & (F.col("near.at") == F.col("far.at"))).select(f"near.{key}", F.col("far.to").alias("at")), "judged")
        if new.isEmpty():
            drop_stage(links)
            break
        judged.append(new)
        near = links.alias("near")
        longer = stage(near.join(far, same & (F.col("near.to") == F.col("far.at"))).select(f"near.{key}", "near.at", "far.to"), "links")
        drop_stage(links)
        links = longer
    return done.select(key, F.timestamp_micros("at").alias("ts"))


def sightings(feed: DataFrame, key: str = "item_id", ts: str = "ts") -> DataFrame:
    """Per item the distinct times it was seen as one value, for items known to be seen a few times only; the table of
    `sighting_rows` has no such limit."""
    return feed.groupBy(key).agg(F.array_sort(F.collect_set(ts)).alias("seen"))


def judgements(seen: DataFrame, minutes: int = 1440, key: str = "item_id") -> DataFrame:
    """`judgement_rows` of a table of `sightings`."""
    return judgement_rows(seen.select(key, F.explode("seen").alias("ts")), minutes, key)


def snapshot_state(captures: DataFrame) -> DataFrame:
    """Per item the newest complete counters, filled metadata and first day: the batch aggregation, kept as state.

    max_by buffers carry the capture stamp, so a late older file may fill gaps but never replaces newer counters.
    """
    return C.latest_snapshot(captures)


def first_seen(captures: DataFrame) -> DataFrame:
    """Per item its earliest capture, whatever order files arrive in: time, source and whether it was complete."""
    first = F.struct("ts", "capture_id")
    return captures.groupBy("item_id").agg(
        F.min("ts").alias("ts"), F.min_by("event_type", first).alias("source"), F.min_by("complete", first).alias("valid"))


def new_per_day(first: DataFrame) -> DataFrame:
    """Per day and source: items seen for the first time, and how many of those first captures were complete."""
    return first.groupBy(F.date_format("ts", "yyyyMMdd").alias("day"), "source").agg(F.count("*").alias("new_items"), F.count_if("valid").alias("valid"))


def run_available(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Process everything that has arrived into a table of changes with its batch number, then return the table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = stream.schema.add("batch", "long")

    def append(batch: DataFrame, number: int) -> None:
        # A retried batch overwrites its own folder, so results stay exactly-once.
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/data/part={number}")

    query: StreamingQuery = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).foreachBatch(append).start())
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/data").drop("part")


def latest_rows(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current value per key from an update-mode change table."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
