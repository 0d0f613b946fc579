"""Shared storage for intermediate tables; the cluster names the folder in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. A temporary one is made only for a local master where none is configured (tests);
    any other master without the setting is refused, as each executor would write to its own disk."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="reactrix-")
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str = "stage", by: Sequence[str] = ()) -> DataFrame:
    """Write a frame as a Parquet table and read it back: cuts lineage and survives lost executors. `by`: folders per value.

    Nothing reads the write's shuffle files again, so they are deleted with it, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the folder of a frame made by `stage`, once nothing reads it any more; other folders are left alone."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    root = root.getFileSystem(conf).makeQualified(root).toString()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(conf)
        if files.makeQualified(path.getParent()).toString() == root:
            files.delete(path, True)


def _listing(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, lengths and modification times below a folder, so that changed input is not served from an older table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return ()
    found, walk = [], files.listFiles(path, True)
    while walk.hasNext():
        f = walk.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


_SHARED: dict[tuple, tuple[tuple, DataFrame]] = {}


def shared_table(spark: SparkSession, sf_dir: str, label: str, build, by: Sequence[str] = ()) -> DataFrame:
    """Table derived from the input once per application and state of the folder, then read by every query that needs it."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, label)
    listing = _listing(spark, sf_dir)
    if key not in _SHARED or _SHARED[key][0] != listing:
        _SHARED[key] = (listing, stage(build(), label, by))
    return _SHARED[key][1]
