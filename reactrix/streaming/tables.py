"""Keyed tables that a stream keeps up to date: one current row per key, merged as changes come in."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..commits import Commits
from ..session import shared_dir


def newest(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the row of its last batch, the number of that batch included."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


class KeyedTable:
    """Runs of rows, each with one row per key, and commits that name the current runs.

    A batch is a new run. It takes in all runs at the end of the list that are at most twice its size, so each run is more
    than twice as large as the next: the table holds fewer than two rows per key, its runs grow with the logarithm of the
    keys, and a row is written again about as often. A batch whose commit exists is skipped, so retries count once; one
    that failed earlier overwrites what it left. Keys may be null. An empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType):
        self.spark, self.keys, self.commits = spark, list(keys), Commits(spark, path)
        self.schema = T.StructType(list(schema.fields)).add("batch", "long")

    def _rows(self, names: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[self.commits.folder(n) for n in names])

    def apply(self, batch: DataFrame, number: int) -> None:
        """The rows of `batch`, one per key, replace those of earlier batches."""
        last, state = self.commits.last()
        if last >= number:
            return
        name = f"change-{number}"
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(self.commits.folder(name))
        size = self._rows([name]).count()  # footers only
        if not size:
            return
        runs = list(state["runs"]) if state else []
        taken = []
        while runs and runs[-1][1] <= 2 * size:
            taken.append(runs.pop())
            size += taken[-1][1]
        if taken:
            parts, name = [name, *[n for n, _ in taken]], f"merged-{number}"
            newest(self._rows(parts), self.keys).write.mode("overwrite").parquet(self.commits.folder(name))
            size = self._rows([name]).count()
        runs.append([name, size])
        self.commits.put(number, {"folders": [n for n, _ in runs], "runs": runs})
        self.commits.tidy()

    def read(self) -> DataFrame:
        _, state = self.commits.last()
        if not state:
            return self.spark.createDataFrame([], self.schema).drop("batch")
        rows = self._rows(state["folders"])
        return (rows if len(state["folders"]) == 1 else newest(rows, self.keys)).drop("batch")


def keep_current(stream: DataFrame, keys: Sequence[str], label: str, base: str | None = None) -> DataFrame:
    """Process everything that has arrived of an update-mode aggregation and return its current rows.

    `base` names the folder of an earlier run to go on with: its checkpoint and table are used again.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    table = KeyedTable(spark, f"{base}/table", keys, stream.schema)
    query: StreamingQuery = (
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).foreachBatch(lambda batch, number: KeyedTable(batch.sparkSession, f"{base}/table", keys, stream.schema).apply(batch, number)).start())
    query.awaitTermination()
    return table.read()
