"""Structured Streaming runs over tables laid out as arriving files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import views as V
from ..streaming import feeds as S
from ..streaming.tables import keep_current
from .projections import OFFLINE
from .registry import query

_FILES: dict = {}


def arriving(spark, sf, name, build, *by):
    """The table written once as day (or layer) files, the way captures arrive."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FILES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df = build()
        df.write.partitionBy(*by).parquet(path)
        _FILES[key] = (path, df.schema)
    return _FILES[key]


def capture_stream(spark, sf, files=4):
    path, schema = arriving(spark, sf, "day_captures", lambda: V.captures(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day")
    return S.file_stream(spark, path, schema, files)


@query("stream_feed_verdict", ["verdicts"], "SELECT coalesce(first_reason, 'kept') AS reason, count(*) AS n, count(*) FILTER (hide) AS cut, CAST(sum(view) AS BIGINT) AS views FROM verdicts GROUP BY 1")
def stream_feed_verdict(spark, sf):
    path, schema = arriving(spark, sf, "feed", lambda: V.scored(spark, sf), "year")
    return keep_current(S.verdict_counts(S.file_stream(spark, path, schema), OFFLINE), ["reason"], "verdicts")


TTL = 1440  # minutes


@query("verdict_cache_ttl", ["captures"], f"""SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS judged, count(DISTINCT item_id) AS items FROM (
  WITH RECURSIVE j AS (SELECT item_id, min(ts) AS ts FROM captures GROUP BY item_id
    UNION ALL SELECT j.item_id, min(c.ts) AS ts FROM j JOIN captures c ON c.item_id = j.item_id AND c.ts >= j.ts + INTERVAL {TTL} MINUTE GROUP BY j.item_id, j.ts)
  SELECT * FROM j) GROUP BY 1""")
def verdict_cache_ttl(spark, sf):
    seen = S.run_available(S.sighting_rows(capture_stream(spark, sf)), "append", "sightings")
    kept = S.judgement_rows(seen, TTL)
    return kept.groupBy(F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.count("*").alias("judged"), F.countDistinct("item_id").alias("items"))


@query("incremental_snapshot_state", ["snapshots"], "SELECT item_id, round(counter, 6) AS counter, extra, first_seen, last_seen, captures FROM snapshots")
def incremental_snapshot_state(spark, sf):
    return keep_current(S.snapshot_state(capture_stream(spark, sf)), ["item_id"], "state")


@query("daily_new_items", ["captures"], """SELECT strftime(ts, '%Y%m%d') AS day, source, count(*) AS new_items, count(*) FILTER (valid) AS valid FROM (
  SELECT item_id, min(ts) AS ts, arg_min(event_type, (ts, capture_id)) AS source, arg_min(complete, (ts, capture_id)) AS valid FROM captures GROUP BY item_id) GROUP BY 1, 2""")
def daily_new_items(spark, sf):
    return S.new_per_day(keep_current(S.first_seen(capture_stream(spark, sf)), ["item_id"], "daily"))
