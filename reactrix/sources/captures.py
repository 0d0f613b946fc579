"""Capture documents: JSON scan, file-name keys, normalisation, flow-graph nodes, manifests."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..commits import Commits

# Counters stay text until they are checked, so "true", "NaN" and null are told apart from numbers.
ITEM_TYPE = (
    "struct<item_id:string,title:string,owner:string,owner_id:string,category:string,source:string,duration:bigint,"
    "pub_day:string,view:string,stat:struct<view:string,coin:string,like:string,favorite:string,fav:string>>")
DOCUMENT_TYPE = f"struct<meta:struct<collected_at:string,arm:string>,videos:array<{ITEM_TYPE}>>"


def scan_captures(spark: SparkSession, path: str, optional: bool = False, whole_files: bool = False) -> DataFrame:
    """One row per record of `{meta, videos[]}` documents or bare arrays; broken JSON fails the read.

    Documents are one per line (splittable); `whole_files` reads one document per file.
    """
    try:
        text = spark.read.text(path, wholetext=whole_files)
    except AnalysisException as missing:
        if not optional or "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], f"meta struct<collected_at:string,arm:string>, file string, video {ITEM_TYPE}")
    strict = {"mode": "FAILFAST"}
    value = F.trim("value")
    parsed = text.filter(F.length(value) > 0).select(
        F.col("_metadata.file_name").alias("file"),
        F.when(value.startswith("["), F.from_json(value, f"array<{ITEM_TYPE}>", strict)).alias("bare"),
        F.when(~value.startswith("["), F.from_json(value, DOCUMENT_TYPE, strict)).alias("doc"))
    return parsed.select(F.col("doc.meta").alias("meta"), "file", F.explode(F.coalesce("bare", "doc.videos")).alias("video"))


def capture_key(file_name: Column) -> Column:
    """14-digit stamp found anywhere in the name; a bare day is padded, no stamp sorts first."""
    day = F.regexp_extract(file_name, r"(20\d{6})(?:_(\d{6}))?", 1)
    clock = F.regexp_extract(file_name, r"(20\d{6})(?:_(\d{6}))?", 2)
    return F.when(day == "", F.lit("0" * 14)).otherwise(F.concat(day, F.rpad(clock, 6, "0")))


def keep_files(df: DataFrame, file_name: str, cutoff: str | None) -> DataFrame:
    """Drop derived products and captures after the cutoff day."""
    name = F.col(file_name)
    kept = df.withColumn("capture_key", capture_key(name)).filter(~name.contains("_analysis") & ~name.contains("merged"))
    return kept if cutoff is None else kept.filter(F.substring("capture_key", 1, 8) <= cutoff)


def _count(c: Column) -> Column:
    number = c.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number < float("inf")), number)


def normalize(videos: DataFrame) -> DataFrame:
    """Flat records; a row without an id or with any missing, NaN, negative or non-numeric counter is dropped."""
    v = F.col("video")
    named = v["owner"].startswith("{")
    out = videos.select(
        v["item_id"].alias("item_id"), F.coalesce(v["title"], F.lit("")).alias("title"),
        _count(F.coalesce(v["stat"]["view"], v["view"])).alias("view"), _count(v["stat"]["coin"]).alias("coin"),
        _count(F.coalesce(v["stat"]["favorite"], v["stat"]["fav"])).alias("fav"), _count(v["stat"]["like"]).alias("like_cnt"),
        F.coalesce(F.when(named, F.get_json_object(v["owner"], "$.name")).otherwise(v["owner"]), F.lit("")).alias("owner"),
        F.coalesce(F.when(named, F.get_json_object(v["owner"], "$.mid")), v["owner_id"], F.lit("")).alias("owner_id"),
        F.coalesce(v["duration"], F.lit(0)).alias("duration"), "file")
    counts = ("view", "coin", "fav", "like_cnt")
    whole = F.coalesce("item_id", F.lit("")) != ""
    for c in counts:
        whole = whole & F.col(c).isNotNull()
    return out.filter(whole)


def first_source_wins(df: DataFrame, key: str, order: Sequence) -> DataFrame:
    """The first record of each key in source order, by aggregation (no per-key sort)."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")


def flow_nodes(runs: DataFrame) -> DataFrame:
    """Nodes of `flows[].nodes[]` and `arms.*.flows[].nodes[]`: newest complete counters, first day seen."""
    direct = runs.select("snapshot", F.explode("flows").alias("flow"))
    armed = runs.select("snapshot", F.explode(F.map_values("arms")).alias("arm")).select("snapshot", F.explode("arm.flows").alias("flow"))
    nodes = direct.unionByName(armed).select("snapshot", F.explode("flow.nodes").alias("n")).select("snapshot", "n.*").filter("node_id is not null")
    fields = ("view", "coin_rate", "fav_rate", "like_rate")
    complete = F.lit(True)
    for f in fields:
        complete = complete & F.col(f).isNotNull() & (F.col(f) >= 0)
    key = F.struct("snapshot", *fields)
    newest = F.max_by(F.struct("snapshot", *fields), key)
    best = F.max_by(F.struct("snapshot", *fields), F.when(complete, key))
    return nodes.groupBy("node_id").agg(
        F.coalesce(best, newest).alias("r"), F.min("snapshot").alias("first_seen"), F.count("*").alias("mentions")).select("node_id", "r.*", "first_seen", "mentions")


def duration_seconds(text: Column) -> Column:
    """'1:59' and '1:02:03' by base-60 folding, numbers as they are, anything else 0."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("long"))
    folded = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 60 + p)
    return F.coalesce(F.when(text.contains(":"), folded), text.try_cast("double").cast("long"), F.lit(0).cast("long"))


def anonymise(value: Column, prefix: str) -> Column:
    return F.substring(F.sha1(F.concat(F.lit(prefix), value.cast("string"))), 1, 10)


#: Files up to this size are digested whole by the JVM; larger ones are read in pieces of PIECE bytes.
WHOLE_BYTES = 64 << 20
PIECE = 4 << 20


def kept_paths(spark: SparkSession, folder: str, cutoff: str | None = None) -> list[str]:
    """Paths of the capture files to read, by key and name: derived products and files after the cutoff day are left out.

    Only the listing is read, which Spark holds on the driver for any scan.
    """
    paths = spark.read.text(folder).inputFiles()
    names = spark.createDataFrame([(p, unquote(p.rsplit("/", 1)[-1])) for p in paths], "path string, name string")
    return [r["path"] for r in keep_files(names, "name", cutoff).orderBy("capture_key", "name", "path").collect()]


def scan_captures_until(spark: SparkSession, folder: str, cutoff: str | None = None, whole_files: bool = False) -> DataFrame:
    """`scan_captures` over the files of `kept_paths` alone; the others are not part of the plan."""
    paths = kept_paths(spark, folder, cutoff)
    if not paths:
        return spark.createDataFrame([], f"meta struct<collected_at:string,arm:string>, file string, video {ITEM_TYPE}")
    return scan_captures(spark, paths, whole_files=whole_files)


def _streamed_digests(batches):
    """(path, sha256) of files read piece by piece; a task holds one piece at a time."""
    import hashlib

    import pandas as pd
    import pyarrow.fs as fs

    for batch in batches:
        found = []
        for path in batch["path"]:
            address = path if "://" in path else path.replace("file:/", "file:///", 1)
            store, inner = fs.FileSystem.from_uri(address)
            digest = hashlib.sha256()
            with store.open_input_stream(inner) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "sha256": found})


def manifest(spark: SparkSession, path: str, glob: str = "*", cutoff: str | None = None, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """File name and SHA-256 of the content per file up to the cutoff day; a file of any size takes bounded memory.

    Files are told apart by name. Larger files need a store that Arrow can open (local, HDFS, S3, GCS); files up to `whole_bytes` only one that Spark can.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    small = files.filter(F.col("length") <= whole_bytes).select("path", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole_bytes).select("path").mapInPandas(_streamed_digests, "path string, sha256 string")
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    # A scan leaves empty files out; its listing has them.
    listed = spark.createDataFrame([(unquote(p.rsplit("/", 1)[-1]),) for p in files.inputFiles()], "file string")
    empty = listed.join(files.select(name), "file", "left_anti").withColumn("sha256", F.sha2(F.lit("").cast("binary"), 256))
    named = small.unionByName(large).select(name, "sha256").unionByName(empty)
    return named if cutoff is None else keep_files(named, "file", cutoff).drop("capture_key")


def freeze(spark: SparkSession, actual: DataFrame, store: str, cutoff: str | None = None) -> None:
    """Store a manifest and its cutoff as the next version below `store`; earlier versions stay."""
    commits = Commits(spark, store)
    number, name = commits.last()[0] + 1, f"manifest-{uuid.uuid4().hex}"
    actual.select("file", "sha256").write.parquet(commits.folder(name))
    commits.put(number, {"folders": [name], "cutoff": cutoff})


def frozen(spark: SparkSession, store: str, version: int | None = None) -> tuple[DataFrame, str | None] | None:
    """(manifest, cutoff) of the newest or the given version; None before the first."""
    commits = Commits(spark, store)
    number = commits.last()[0] if version is None else version
    if number < 0:
        return None
    content = commits.read(number)
    return spark.read.schema("file string, sha256 string").parquet(commits.folder(content["folders"][0])), content["cutoff"]


def manifest_problems(actual: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against the stored manifest."""
    return manifest_report(actual, stored).filter("problem is not null")


def manifest_report(actual: DataFrame, stored: DataFrame) -> DataFrame:
    """(file, sha256, stored, problem) of all files on either side; problem is null where both agree."""
    s = stored.select("file", F.col("sha256").alias("stored"))
    both = actual.join(s, "file", "full_outer")
    return both.withColumn("problem", F.when(F.col("stored").isNull(), "new").when(F.col("sha256").isNull(), "missing").when(
        F.col("sha256") != F.col("stored"), "changed"))


def check_manifest(actual: DataFrame, stored: DataFrame) -> None:
    """Refuse a reference whose files differ from the frozen list."""
    bad = manifest_problems(actual, stored).limit(5).collect()
    if bad:
        raise ValueError(f"frozen reference changed: {[(r['file'], r['problem']) for r in bad]}")


def check_frozen(spark: SparkSession, folder: str, store: str, cutoff: str | None = None, glob: str = "*") -> None:
    """Refuse a folder whose cutoff or files differ from the manifest of an earlier run."""
    earlier = frozen(spark, store)
    if earlier is None:
        raise ValueError(f"nothing was frozen below {store}")
    stored, was = earlier
    if was != cutoff:
        raise ValueError(f"frozen reference changed: cutoff {was} became {cutoff}")
    check_manifest(manifest(spark, folder, glob, cutoff), stored)
