"""Centroid clustering by dimension-sharded Lloyd rounds in exact integers.

Vectors with exactly `dims` components, none null or non-finite, are kept; a component x counts as floor(scale * x). They
are laid out once as row groups of at most `ROWS` vectors, cut into `blocks` column blocks: one row per (group, block).

* A column block's work needs its own slice of the centroids only: it gives the exact partial squared distances of its
  group to every centroid slice.
* Partial distances are added by group, first within a task (blocks that lie next to each other), then across tasks; the
  whole sums give the nearest centroid, ties going to the smaller number.
* Each column block then adds its group's vectors by cluster; sums are combined within a task, and every block's slice is
  replaced by floor(sum / count) on its own. Empty clusters keep their slice. No step holds a whole centroid.

Slices, labels and sums are tables in the shared folder, so a lost executor costs tasks only. Groups are cut by row
count: equal vectors, however many, and crowded clusters never share one task.

Start: the `k` kept vectors with the smallest hex sha256 of "<seed>:<id>", equal hashes (repeated ids) by components; a
null id hashes as an empty text. With fewer kept vectors there are fewer centroids, with none the result is empty. Repeated
rows are rows of their own. Extra columns are ignored. Components of 2**27 or more after scaling are refused with an
error, as their squared distances leave 64 bits.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reactrix.session import drop_stage, stage

from .common import query

ROWS = 4096
LARGEST = 1 << 27


def quantised(values, scale: int) -> np.ndarray:
    whole = np.floor(np.asarray(values, np.float64) * scale)
    if whole.size and np.abs(whole).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // scale} or more have no exact distances in 64 bits")
    return whole.astype(np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """Row-major bytes at the least integer width that holds all numbers."""
    low, high = (int(numbers.min()), int(numbers.max())) if numbers.size else (0, 0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return numbers.astype(kind).tobytes()
    return numbers.astype(np.int64).tobytes()


def unpacked(data: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (rows * columns)}").reshape(rows, columns).astype(np.int64)


def edges_of(dims: int, blocks: int) -> list[int]:
    return [dims * b // blocks for b in range(blocks + 1)]


def shards(kept: DataFrame, dims: int, blocks: int, scale: int) -> DataFrame:
    """Staged (grp, block, n, ids, cells) of kept vectors (id, vector); ids lie with block 0."""
    edges, id_type = edges_of(dims, blocks), kept.schema["id"].dataType

    def work(batches):
        number = itertools.count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            whole = quantised(batch.column(1).flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, dims)
            for at in range(0, batch.num_rows, ROWS):
                part, ids = whole[at:at + ROWS], batch.column(0).slice(at, ROWS).to_pylist()
                grp = next(number)
                yield pa.RecordBatch.from_arrays([
                    pa.array([grp] * blocks, pa.int64()), pa.array(range(blocks), pa.int32()), pa.array([len(part)] * blocks, pa.int32()),
                    pa.array([ids, *[None] * (blocks - 1)], pa.list_(batch.schema.field(0).type)),
                    pa.array([packed(part[:, a:b]) for a, b in zip(edges, edges[1:])], pa.binary())], names)

    schema = T.StructType([T.StructField("grp", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("n", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(id_type)), T.StructField("cells", T.BinaryType())])
    names = schema.names
    return stage(kept.select("id", "vector").mapInArrow(work, schema), "vector-shards")


def assigned(table: DataFrame, slices: DataFrame, k: int, widths: list[int]) -> DataFrame:
    """Staged (grp, n, labels, far): nearest centroid and squared distance of every vector of a group, packed."""
    def partial(batches):
        held = None  # (grp, n, sums): blocks of one group that lie next to each other are added before they travel
        for batch in batches:
            for grp, n, block, cells, centres in zip(*(batch.column(c).to_pylist() for c in range(5))):
                x, c = unpacked(cells, n, widths[block]), np.frombuffer(centres, np.int64).reshape(k, -1)
                far = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
                if held and held[0] == grp:
                    held = grp, n, held[2] + far
                else:
                    if held:
                        yield row_of(held)
                    held = grp, n, far
        if held:
            yield row_of(held)

    def row_of(held):
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32()), pa.array([packed(held[2])], pa.binary())], ["grp", "n", "far"])

    def nearest(rows: pa.Table) -> pa.Table:
        n = rows.column("n")[0].as_py()
        far = sum(unpacked(f, n, k) for f in rows.column("far").to_pylist())
        label = far.argmin(axis=1)
        return pa.table({"grp": rows.column("grp")[:1], "n": rows.column("n")[:1], "labels": pa.array([packed(label)], pa.binary()),
                         "far": pa.array([packed(far[np.arange(n), label])], pa.binary())})

    read = table.select("grp", "n", "block", "cells").join(F.broadcast(slices), "block").select("grp", "n", "block", "cells", "centres")
    added = read.mapInArrow(partial, "grp long, n int, far binary").groupBy("grp")
    return stage(added.applyInArrow(nearest, "grp long, n int, labels binary, far binary"), "labels")


def moved(table: DataFrame, labels: DataFrame, slices: DataFrame, k: int, widths: list[int]) -> DataFrame:
    """Staged new slices (block, centres): each block's floor(sum / count) by cluster, empty clusters as they were."""
    def sums(batches):
        held = {}
        for batch in batches:
            for block, n, cells, label in zip(*(batch.column(c).to_pylist() for c in range(4))):
                x, one = unpacked(cells, n, widths[block]), unpacked(label, n, 1)[:, 0]
                here = np.zeros((k, widths[block] + 1), np.int64)
                hot = (one[:, None] == np.arange(k)).astype(np.float64)
                here[:, :-1] = (hot.T @ x.astype(np.float64)).astype(np.int64)  # below 2**53: exact
                here[:, -1] = np.bincount(one, minlength=k)
                held[block] = held.get(block, 0) + here
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h.tobytes() for h in held.values()], pa.binary())], ["block", "sums"])

    def replace(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        old = np.frombuffer(rows.column("centres")[0].as_py(), np.int64).reshape(k, widths[block])
        total = sum(np.frombuffer(s, np.int64).reshape(k, widths[block] + 1) for s in rows.column("sums").to_pylist())
        count = total[:, -1:]
        new = np.where(count > 0, total[:, :-1] // np.maximum(count, 1), old)
        return pa.table({"block": rows.column("block")[:1], "centres": pa.array([new.astype(np.int64).tobytes()], pa.binary())})

    rows = table.select("grp", "block", "n", "cells").join(labels.select("grp", "labels"), "grp").select("block", "n", "cells", "labels")
    parts = rows.mapInArrow(sums, "block int, sums binary").join(F.broadcast(slices), "block")  # one row per task and block
    return stage(parts.groupBy("block").applyInArrow(replace, "block int, centres binary"), "centroid-slices")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3,
            blocks: int = 4, scale: int = 64, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(assignments: <id>, cluster, distance; centroids: cluster, size, cluster_inertia, centroid, centroid_sha256)."""
    spark, widths = vectors.sparkSession, np.diff(edges_of(dims, blocks)).tolist()
    id_type = vectors.schema[id_col].dataType
    x = F.col("vector")
    kept = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector")).filter(
        (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = [r["vector"] for r in kept.orderBy(first, "vector").limit(k).collect()]  # k vectors
    k, edges = len(start), edges_of(dims, blocks)
    if not k:
        nothing = spark.createDataFrame([], T.StructType([T.StructField(id_col, id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))
        return nothing, spark.createDataFrame([], "cluster int, size long, cluster_inertia long, centroid string, centroid_sha256 string")
    whole = quantised(start, scale)
    slices = spark.createDataFrame([(b, bytearray(np.ascontiguousarray(whole[:, edges[b]:edges[b + 1]]).tobytes())) for b in range(blocks)], "block int, centres binary")
    table = shards(kept, dims, blocks, scale)
    for _ in range(rounds):
        labels = assigned(table, slices, k, widths)
        new = moved(table, labels, slices, k, widths)
        drop_stage(labels)
        slices = new
    labels = assigned(table, slices, k, widths)

    def rows(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n = batch.column(0).slice(r, 1).flatten(), batch.column(1)[r].as_py()
                label, far = (unpacked(batch.column(c)[r].as_py(), n, 1)[:, 0] for c in (2, 3))
                yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array(far, pa.int64())], [id_col, "cluster", "distance"])

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    out = table.filter("block = 0").select("grp", "ids").join(labels, "grp").select("ids", "n", "labels", "far").mapInArrow(rows, schema)
    out = stage(out, "assignments")

    def texts(batches):
        for batch in batches:
            for block, centres in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.frombuffer(centres, np.int64).reshape(k, widths[block])
                yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int32()), pa.array(range(k), pa.int32()),
                                                  pa.array([",".join(map(str, row)) for row in c.tolist()])], ["block", "cluster", "part"])

    parts = slices.select("block", "centres").mapInArrow(texts, "block int, cluster int, part string")
    centres = parts.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda p: p["part"]), ",").alias("centroid"))
    sizes = out.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("distance").alias("cluster_inertia"))
    found = centres.join(sizes, "cluster", "left").select(
        "cluster", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("cluster_inertia", F.lit(0)).alias("cluster_inertia"),
        "centroid", F.sha2("centroid", 256).alias("centroid_sha256"))
    found = stage(found, "centroids")
    drop_stage(table)
    drop_stage(labels)
    return out, found


def _sql(k: int = 16, rounds: int = 3) -> str:
    steps = ["""WITH kept AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT %d))""" % k]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT uid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT p.uid, p.vec_id, p.v, c.k, CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept p, c{r} c) GROUP BY uid)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT k, list(f ORDER BY i) AS v FROM (
  SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY k, i)) GROUP BY k) m ON m.k = c.k)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


@query("op12_sharded_kmeans", _sql())
def op12_sharded_kmeans(spark, sf_dir):
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    total = centroids.agg(F.sum("cluster_inertia").alias("inertia"))
    known = centroids.crossJoin(F.broadcast(total)).select("cluster", "cluster_inertia", "inertia", "centroid_sha256")  # 16 rows with one
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
