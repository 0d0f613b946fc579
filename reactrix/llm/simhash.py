"""Near duplicates by SimHash: segment popcounts as coordinates, a grid range join, exact verification.

Texts are lower-cased (A-Z), cut at ASCII white space and read as three-word shingles, repeats included (fewer words: the
whole sequence). A fingerprint's bit is 1 if it is set in over half of the shingles' 64-bit XXH64 values (seed 42); a text
without words has fingerprint zero and links like any other. Fingerprints link at 2 or fewer differing bits.

* Equal fingerprints collapse first: one node per distinct fingerprint, however many copies there are.
* The embedding maps a fingerprint to the number of ones in each of its `segments`. Every differing bit moves one
  coordinate by at most one, so the Manhattan distance of two embeddings never exceeds their differing bits.
* Range join on the unit grid: a node is laid into its own cell and the cells one step away (at most 2 * segments + 1).
  Two points within Manhattan distance 2 share such a cell, and points that share one are within distance 2.
* Cells of at most `crowd` nodes compare their members' bits, so a row takes part in at most `crowd` comparisons. The
  members of fuller cells meet by the exact values one bit away from them that lie in this cell: two fingerprints
  differ by 2 bits or fewer exactly if they share such a value, and at most 65 share one. So no cell lists its pairs,
  no link is lost, and the work grows with the rows.
* Links are joined into components by alternating large-star and small-star.
* Joins of this module are merge joins by hint: Spark sizes a task function's output by its input, so it takes the laid
  nodes (up to 65 rows each) for a small table and would collect them in the driver to broadcast them.

Null text counts as empty. A null id never names a component unless all its ids are null; its text still links. Repeated
rows and ties share one fingerprint and component. A text of any length is hashed whole, in chunks of bounded memory.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reactrix.session import drop_stage, stage

from .common import documents, query, slices
from .components import components

WORDS = 3
SEED = 42
MAX_BITS = 2  # the grid's reach of one step a side and the shared one-bit neighbours both stand for two bits
SEGMENTS = 32
CROWD = 8
CHUNK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes | None, width: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - width, 0) + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        till = min(at + CHUNK, n)
        a, b = starts[at:till].tolist(), ends[min(width, len(words)) - 1:][at:till].tolist()
        h = np.array([digest(whole[i:j], SEED) for i, j in zip(a, b)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def embed(fp: np.ndarray, segments: int) -> np.ndarray:
    """Ones of every segment, each count in its segment's own bits of the result."""
    u = np.uint64
    x, width = fp.astype(u), 1
    while width < 64 // segments:
        mask = u(sum(((1 << width) - 1) << at for at in range(0, 64, 2 * width)))
        x = (x & mask) + ((x >> u(width)) & mask)
        width *= 2
    return x


def cells_of(fp: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, cell): a node's own cell and each cell one step away."""
    own, bits = embed(fp, segments), 64 // segments
    index, cell = [np.arange(len(fp))], [own]
    for at in range(0, 64, bits):
        count = (own >> np.uint64(at)) & np.uint64((1 << bits) - 1)
        for inside, step in ((count > 0, -1), (count < bits, 1)):
            index.append(np.flatnonzero(inside))
            one = np.uint64(1 << at)
            cell.append(own[inside] - one if step < 0 else own[inside] + one)
    return np.concatenate(index), np.concatenate(cell)


def values_in(fp: np.ndarray, cell: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, value): the values at most one bit away from each fingerprint whose embedding is the row's cell."""
    index, value = [np.flatnonzero(embed(fp, segments) == cell)], [fp[embed(fp, segments) == cell]]
    for at in range(64):
        moved = fp ^ np.uint64(1 << at)
        inside = embed(moved, segments) == cell
        index.append(np.flatnonzero(inside))
        value.append(moved[inside])
    return np.concatenate(index), np.concatenate(value)


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """Staged (doc_id, fp) of every row; fp holds the fingerprint's 64 bits as a long."""
    def work(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return stage(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(work, schema), "fingerprints")


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def links(nodes: DataFrame, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp): they join exactly what links of 2 or fewer bits join."""
    def lay(batches):
        for batch in slices(batches, 10_000):
            fp = _unsigned(batch.column(0))
            index, cell = cells_of(fp, segments)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp[index].view(np.int64))], ["cell", "fp"])

    def shared_values(batches):
        for batch in slices(batches, 10_000):
            fp = _unsigned(batch.column(1))
            index, value = values_in(fp, _unsigned(batch.column(0)), segments)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(fp[index].view(np.int64))], ["value", "fp"])

    laid = nodes.select("fp").mapInArrow(lay, "cell long, fp long")
    full = laid.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(laid.hint("merge").join(full, "cell"), "grid")
    few = members.filter(F.col("n") <= crowd)
    pairs = few.select("cell", F.col("fp").alias("u")).hint("merge").join(few.select("cell", F.col("fp").alias("v")), "cell").filter(
        (F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)).select("u", "v")
    values = members.filter(F.col("n") > crowd).select("cell", "fp").mapInArrow(shared_values, "value long, fp long")
    stars = values.groupBy("value").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    spokes = stars.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).filter("u != v")
    return stage(pairs.union(spokes).distinct(), "links")


def near_duplicates(docs: DataFrame, width: int = WORDS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, fingerprint, component_id, kept."""
    if segments not in (8, 16, 32):
        raise ValueError("segments: 8, 16 or 32")
    prints = fingerprints(docs, width)
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = links(nodes, segments, crowd)
    found = components(edges).withColumnRenamed("node", "fp")
    placed = stage(nodes.hint("merge").join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "components")
    drop_stage(edges)
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    rows = prints.hint("merge").join(placed.select("fp", "component"), "fp").hint("merge").join(named, "component")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                       F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op11_simhash_near_dedup")
def op11_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
