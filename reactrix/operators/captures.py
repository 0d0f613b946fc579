"""Repeated captures: newest complete counters, filled metadata, first-seen days, approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_snapshot(captures: DataFrame) -> DataFrame:
    """Counters of the newest complete capture; the metadata field's newest non-empty value; first and last day.

    One aggregation with map-side combine: an item seen in a third of all captures is reduced before the shuffle.
    """
    stamp = F.struct("ts", "capture_id")
    known = F.col("extra").isNotNull() & (F.col("extra") != 0)
    return captures.filter("complete").groupBy("item_id").agg(
        F.max_by("counter", stamp).alias("counter"), F.max_by("extra", F.when(known, stamp)).alias("extra"),
        F.date_format(F.min("ts"), "yyyyMMdd").alias("first_seen"), F.date_format(F.max("ts"), "yyyyMMdd").alias("last_seen"),
        F.count("*").alias("captures"))


def approved_streams(approvals: DataFrame, rows: DataFrame, excused: str, latest: int = 9) -> DataFrame:
    """First approval of an item that passes its flags; a checked approval excuses one flag; newest are marked."""
    flags = F.when(F.col("number_checked"), F.array_except("screen_flags", F.array(F.lit(excused)))).otherwise(F.col("screen_flags"))
    blank = (F.trim("note") == "")
    passing = approvals.join(rows, "item_id").filter(F.size(flags) == 0).withColumn(
        "note", F.when(blank, F.raise_error(F.lit("an approval needs a note"))).otherwise(F.col("note")))
    chosen = passing.groupBy("item_id").agg(F.min(F.struct("seq", "admitted_on", "note")).alias("a")).select("item_id", "a.admitted_on", "a.note")
    newest = chosen.orderBy(F.desc("admitted_on"), "item_id").limit(latest).select("item_id", F.lit(True).alias("_new"))
    return chosen.join(newest, "item_id", "left").select("item_id", "admitted_on", "note", F.coalesce("_new", F.lit(False)).alias("latest"))
