"""Streams whose result must not depend on the order in which files arrive."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from reactrix.streaming import feeds as S

DAY = dt.datetime(2024, 1, 1)


def capture_rows():
    rng = random.Random(4)
    rows = []
    for k in range(600):
        at = DAY + dt.timedelta(minutes=rng.randrange(29 * 1440))
        rows.append((rng.randrange(120), k, at, rng.choice(["view", "click", "error"]), rng.random() < 0.7))
    rows.append((999, 1000, DAY + dt.timedelta(days=30, hours=3), "click", True))  # first seen on the last day
    return rows


def written(spark, tmp_path, rows):
    """Files of several writers, newest days first, and one old file that arrives last."""
    df = spark.createDataFrame(rows, "item_id long, capture_id long, ts timestamp, event_type string, complete boolean")
    path = f"{tmp_path}/captures"
    old = F.col("capture_id") % 17 == 0
    df.filter(~old).repartition(4).sortWithinPartitions(F.desc("ts")).write.parquet(path)
    df.filter(old).coalesce(1).write.mode("append").parquet(path)
    return S.file_stream(spark, path, df.schema, 1)


def test_new_items_per_day(spark, tmp_path):
    rows = capture_rows()
    first = {}
    for item, capture, ts, source, complete in rows:
        first[item] = min(first.get(item, (ts, capture, source, complete)), (ts, capture, source, complete))
    want = Counter((ts.strftime("%Y%m%d"), source) for ts, _, source, _ in first.values())
    valid = Counter((ts.strftime("%Y%m%d"), source) for ts, _, source, complete in first.values() if complete)
    changes = S.run_available(S.first_seen(written(spark, tmp_path, rows)), "update", "daily")
    got = S.new_per_day(S.latest_rows(changes, ["item_id"])).collect()
    assert {(r.day, r.source): r.new_items for r in got} == want
    assert {(r.day, r.source): r.valid for r in got if r.valid} == valid
    assert ("20240131", "click") in want


def test_verdicts_are_reused_for_a_while(spark, tmp_path):
    rows, minutes = capture_rows(), 3000
    want = []
    for item in {r[0] for r in rows}:
        last = None
        for ts in sorted(r[2] for r in rows if r[0] == item):
            if last is None or ts - last >= dt.timedelta(minutes=minutes):
                want.append((item, ts))
                last = ts
    changes = S.run_available(S.sightings(written(spark, tmp_path, rows)), "update", "seen")
    got = S.judgements(S.latest_rows(changes, ["item_id"]), minutes).select("item_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")).collect()
    assert sorted(map(tuple, got)) == sorted((i, str(t)) for i, t in want)


def test_an_item_with_a_third_of_the_captures_stays_rows(spark, tmp_path, monkeypatch):
    """The table behind the query holds one scalar row per sighting, and the links cross the edges of partitions."""
    from pyspark.sql import types as T

    from reactrix.plans import streams as P

    rng = random.Random(8)
    rows = [(7 if k % 3 == 0 else rng.randrange(50), k, DAY + dt.timedelta(minutes=rng.randrange(200 * 1440)), "view", True) for k in range(3000)]
    rows += [(None, 5000 + k, DAY + dt.timedelta(days=k), "view", True) for k in range(3)] + [(1, 6000, None, "view", True)]
    want = Counter()
    for item in {r[0] for r in rows}:
        last = None
        for ts in sorted({r[2] for r in rows if r[0] == item and r[2] is not None}):
            if last is None or ts - last >= dt.timedelta(minutes=P.TTL):
                want[ts.strftime("%Y%m%d")] += 1
                last = ts
    tables = []
    run = S.run_available

    def noted(*args):
        tables.append(run(*args))
        return tables[-1]

    monkeypatch.setattr(S, "run_available", noted)
    monkeypatch.setattr(P, "capture_stream", lambda spark, sf: written(spark, tmp_path, rows))
    got = {r.day: r.judged for r in P.verdict_cache_ttl(spark, "").collect()}
    assert got == want
    assert not any(isinstance(f.dataType, (T.ArrayType, T.MapType)) for f in tables[0].schema)
    assert tables[0].count() == len({(r[0], r[2]) for r in rows if r[2] is not None})
