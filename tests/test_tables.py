"""Keyed tables of streams: size, retries, late files and going on after a stop."""

import os
import random

import pytest
from pyspark.sql import functions as F

from reactrix.commits import Commits
from reactrix.streaming import feeds as S
from reactrix.streaming.tables import KeyedTable, keep_current
from tests.test_streams import capture_rows, written

FIELDS = "k long, v long"


def rows_on_disk(spark, table):
    return sum(spark.read.parquet(table.commits.folder(n)).count() for n in table.commits.last()[1]["folders"])


def test_size_stays_below_two_rows_per_key_over_100_batches(spark, tmp_path):
    rng, want = random.Random(3), {}
    schema = spark.createDataFrame([], FIELDS).schema
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], schema)
    for number in range(100):
        batch = {rng.choice([None, *range(40)]): number for _ in range(rng.choice([1, 2, 20]))}
        want |= batch
        table.apply(spark.createDataFrame(list(batch.items()), schema).coalesce(1), number)
        sizes = [n for _, n in table.commits.last()[1]["runs"]]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) < 2 * len(want) + 1
    assert {r.k: r.v for r in table.read().collect()} == want
    assert rows_on_disk(spark, table) < 2 * len(want)
    assert len(table.commits.numbers()) == 2
    assert len(os.listdir(tmp_path / "t" / "data")) <= 2 * 7  # runs of two commits


def test_a_retried_batch_counts_once(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], FIELDS).schema
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], schema)
    one = spark.createDataFrame([(1, 10), (2, 20)], schema)
    table.apply(one, 0)
    with monkeypatch.context() as m:  # lost between its files and its commit
        m.setattr(Commits, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.apply(spark.createDataFrame([(1, 11)], schema), 1)
    assert {tuple(r) for r in table.read().collect()} == {(1, 10), (2, 20)}
    table.apply(spark.createDataFrame([(1, 11)], schema), 1)
    table.apply(spark.createDataFrame([(1, 11)], schema), 1)
    table.apply(one, 0)
    table.apply(spark.createDataFrame([], schema), 2)
    assert {tuple(r) for r in table.read().collect()} == {(1, 11), (2, 20)}


def test_an_empty_table_has_its_columns(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], spark.createDataFrame([], FIELDS).schema)
    assert table.read().columns == ["k", "v"] and table.read().count() == 0


def test_a_stopped_stream_goes_on_and_takes_late_files(spark, tmp_path):
    rows = capture_rows()
    stream = written(spark, tmp_path, rows)
    base = str(tmp_path / "base")
    first = keep_current(S.first_seen(stream), ["item_id"], "daily", base).count()
    early = spark.createDataFrame([(999, 1, rows[0][2].replace(year=2023), "view", False), (4242, 2, rows[0][2], "click", True)],
                                  "item_id long, capture_id long, ts timestamp, event_type string, complete boolean")
    early.coalesce(1).write.mode("append").parquet(f"{tmp_path}/captures")
    got = {r.item_id: r for r in keep_current(S.first_seen(stream), ["item_id"], "daily", base).collect()}
    want = {r.item_id: r for r in S.first_seen(spark.read.parquet(f"{tmp_path}/captures")).collect()}
    assert got == want and len(got) == first + 1 and got[999].ts.year == 2023 and not got[999].valid
