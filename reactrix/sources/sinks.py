"""Sinks: append-only captures, content-addressed pages, JSON summaries, catalogue fingerprint."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..commits import Commits
from ..functions import ordering as O
from ..params import PAGE_ROWS
from ..session import drop_stage, stage


def append_only(df: DataFrame, path: str, day: str = "capture_day") -> bool:
    """Write once, partitioned by day; an existing target is an error, an empty result writes nothing."""
    if df.isEmpty():
        return False
    df.write.mode("errorifexists").partitionBy(day).parquet(path)
    return True


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def pages(df: DataFrame, stream: str, order: Sequence, row: Sequence[str], size: int = PAGE_ROWS) -> DataFrame:
    """Fixed-size pages of each ordered stream, named by the first 20 hex digits of their SHA-256."""
    keys = list(dict.fromkeys([stream, *row, *[c for c in order if isinstance(c, str)]]))
    placed = O.positions(df.select(*keys), [stream], order)
    body = placed.withColumn("page", F.floor(F.col("pos") / size)).withColumn("_row", F.concat_ws("|", *[F.col(c).cast("string") for c in row]))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_row"))), lambda x: x["_row"])  # at most `size` rows
    return body.groupBy(stream, "page").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("body")).withColumn(
        "page_id", F.substring(F.sha2("body", 256), 1, 20))


def stale_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages of the previous manifest that no current stream refers to."""
    return old.join(new.select("page_id").distinct(), "page_id", "left_anti")


def publish_pages(spark: SparkSession, placed: DataFrame, store: str, stream: str, keep_previous: bool = False) -> dict[str, int]:
    """Bring the page store below `store` to the pages of `placed` (as `pages` gives them) and return what was done.

    Bodies lie under their page_id in generations, one per publication that wrote any. Bodies already stored are not
    written again, wherever they now stand in a stream. The manifest (stream, page, n, page_id) is swapped in by one
    commit after all bodies are written; the same pages once more write nothing. A generation that holds bodies no
    manifest refers to any more is written again without them, so withdrawn rows leave the store; `keep_previous` spares
    the bodies of the manifest before for readers still on it.
    """
    placed = stage(placed.select(F.col(stream).alias("stream"), "page", "n", "page_id", "body"), "pages")
    commits = Commits(spark, store)
    number, state = commits.last()
    places = ["stream", "page", "n", "page_id"]
    older = stored_pages(spark, store)
    if older is not None and older.count() == placed.count() and placed.select(*places).exceptAll(older).isEmpty():
        drop_stage(placed)
        return {"written": 0, "purged": 0}
    bodies = {g: spark.read.parquet(commits.folder(g)) for g in (state["bodies"] if state else [])}
    wanted, known = placed.select("page_id").distinct(), None
    for part in bodies.values():
        known = part.select("page_id") if known is None else known.union(part.select("page_id"))
    fresh = placed.select("page_id", "body").dropDuplicates(["page_id"])
    fresh = fresh if known is None else fresh.join(known, "page_id", "left_anti")
    live = wanted.union(older.select("page_id")).distinct() if keep_previous and older is not None else wanted
    name = f"bodies-{uuid.uuid4().hex}"
    fresh.write.parquet(commits.folder(name))
    written = spark.read.parquet(commits.folder(name)).count()
    kept, purged = ([name] if written else []), 0
    for generation, part in bodies.items():
        stale = part.join(live, "page_id", "left_anti").count()
        purged += stale
        if not stale:
            kept.append(generation)
        elif stale < part.count():
            again = f"bodies-{uuid.uuid4().hex}"
            part.join(live, "page_id", "left_semi").write.parquet(commits.folder(again))
            kept.append(again)
    manifest = f"manifest-{uuid.uuid4().hex}"
    placed.select(*places).write.parquet(commits.folder(manifest))
    commits.put(number + 1, {"folders": [manifest, *kept], "manifest": manifest, "bodies": kept})
    commits.tidy(1 if not keep_previous else 2)
    drop_stage(placed)
    return {"written": written, "purged": purged}


def stored_pages(spark: SparkSession, store: str) -> DataFrame | None:
    """(stream, page, n, page_id) of the published manifest; None before the first publication."""
    commits = Commits(spark, store)
    _, state = commits.last()
    return spark.read.parquet(commits.folder(state["manifest"])) if state else None


def read_pages(spark: SparkSession, store: str) -> DataFrame | None:
    """The published pages with their bodies."""
    commits = Commits(spark, store)
    _, state = commits.last()
    if not state:
        return None
    found = spark.read.parquet(commits.folder(state["manifest"]))
    if not state["bodies"]:
        return found.withColumn("body", F.lit(None).cast("string"))
    return found.join(spark.read.parquet(*[commits.folder(b) for b in state["bodies"]]), "page_id")


def fingerprint(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """SHA-256 identity of all rows, whatever their order and number: row hashes are added up in four 60-bit lanes.

    Sums combine before the shuffle and read the rows once; repeated rows count each time.
    """
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in fields]), 256)
    lanes = [F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return df.select(h.alias("h")).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *lanes), 256).alias("fingerprint"))
