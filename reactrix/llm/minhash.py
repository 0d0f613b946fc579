"""Near duplicates by MinHash: universal hash minima, banding, signature verification, star-based components.

Texts are lower-cased (A-Z) and cut at ASCII white space; a document's set holds its distinct five-word shingles, or its
whole word sequence where it has fewer words. Documents link where 100 * intersection >= percent * union of the full
sets (80 unless the caller says otherwise; the contract of op4 says 85), and a component's smallest id stands for it.

* Equal sets collapse first, so only one node per distinct set takes part, however many copies there are.
* `bands` x `rows` universal hash minima; nodes that agree on a band share a bucket. Both follow from the limit: two sets
  at it miss each other in all bands with a probability of at most 1e-6 (less above it). That is 35 x 5 at 0.80 and
  30 x 6 at 0.85.
* A bucket of n nodes never lists its n^2 pairs: each node is held against the bucket's hub, the member whose buckets are
  fullest. Pairs pass if their 8-bit signatures agree to within 6 standard deviations under the limit and their full
  sets confirm the link.
* Components of those links settle most buckets. Where members of one bucket are still apart, all pairs across
  components are compared by signature, in blocks of at most `block` members a side held in one task's memory, and
  again confirmed on full sets; so no link depends on the choice of the hub. With at most `block` members outside the
  bucket's largest component that is at most 2 * `block` comparisons a member. The members of buckets with more are
  first dealt anew, exactly: by each of their rarest shingles, as many as every pair at the limit must share one of (prefix
  filter), so that what many texts share makes no bucket.

Null and empty texts have no shingles, are linked with nothing and are kept. A row with null id stands alone: its
component is null and it is kept. Rows that share an id share that node's component. Extra columns are kept where rows
are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reactrix.session import stage

from .common import documents, partitions, query, slices
from .components import components

WORDS = 5
PERCENT = 80
CONTRACT_PERCENT = 85  # of op4
HASHES = 180  # minima a text takes at most, for choosing bands and rows
MISS = 1e-6  # probability that two sets at the limit share no bucket
SPREAD = 6  # standard deviations that the signatures of a link may lie under the limit
BLOCK = 1024
CHUNK = 60_000  # shingles hashed at once, to stay in the processor's cache
WORD_CACHE = 200_000  # words whose hash a task remembers


def banding(percent: int, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows with which `hashes` minima keep the chance to miss a pair at the limit to `miss`."""
    if percent >= 100:
        return 1, 1
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(miss) / math.log1p(-(percent / 100) ** rows))
        if best is None or bands * rows <= hashes:
            best = bands, rows
    return best


def floor_of(percent: int, hashes: int) -> float:
    """Least number of agreeing minima that the signatures of a link have."""
    s = percent / 100
    return hashes * (s - SPREAD * math.sqrt(s * (1 - s) / hashes))


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _finish(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHash(dict):
    """64-bit hash of a word, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, known: dict, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    n = min(width, len(h))
    mix = _odd(1, width)
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k:len(h) - n + 1 + k] * mix[k]
    return np.unique(_finish(total))


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Minima of each universal hash over each non-empty set, as rows of unsigned 32-bit numbers."""
    a, b = _odd(2, hashes), _odd(3, hashes)
    out = np.empty((len(sets), hashes), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= CHUNK:
            size += len(sets[end])
            end += 1
        values = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at:end - 1])])
        for k in range(hashes):
            out[at:end, k] = np.minimum.reduceat(values * a[k] + b[k], starts) >> np.uint64(32)
        at = end
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    mix, salt = _odd(4, rows), _odd(5, bands)
    grouped = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    return _finish((grouped * mix).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)


def sketch(docs: DataFrame, bands: int, rows: int, width: int = WORDS) -> DataFrame:
    """Staged (doc_id, n_shingles, digest, sig, keys) of every row; sets themselves are not kept."""
    def sketches(batches):
        import xxhash

        known = _WordHash()
        for batch in slices(batches):
            sets = [shingle_set(t, known, width) for t in batch.column(1).to_pylist()]
            full = np.array([len(s) > 0 for s in sets], bool)
            sig = signatures([s for s in sets if len(s)], bands * rows)
            keys = band_keys(sig, bands, rows)
            flags, small = iter(range(len(sig))), sig.astype(np.uint8)
            at_row = [next(flags) if f else None for f in full]
            sizes = np.where(full, bands, 0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([None if k is None else small[k].tobytes() for k in at_row], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys.reshape(-1), pa.int64()))], names)

    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
        T.StructField("sig", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    names = schema.names
    return stage(docs.select("doc_id", "text").mapInArrow(sketches, schema), "sketches")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int = WORDS) -> DataFrame:
    """Staged (doc_id, shingles) of the wanted nodes (node, digest), from whole texts. Texts travel instead of sets, as
    they are smaller, and only nodes that share a bucket are kept."""
    def sets(batches):
        import xxhash

        known = _WordHash()
        for batch in slices(batches):
            found = [shingle_set(t, known, width).tobytes() for t in batch.column(1).to_pylist()]
            same = [xxhash.xxh3_128_digest(s) == d for s, d in zip(found, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "shingles"]).filter(pa.array(same, pa.bool_()))

    rows = docs.select("doc_id", "text").join(wanted.select(F.col("node").alias("doc_id"), "digest"), "doc_id")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("shingles", T.BinaryType())])
    return stage(rows.mapInArrow(sets, schema), "shingle-sets")


def _pairs_schema(pairs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("u", pairs.schema["u"].dataType), T.StructField("v", pairs.schema["v"].dataType)])


def _beside(pairs: DataFrame, sketches: DataFrame, column: str) -> DataFrame:
    a = sketches.select(F.col("doc_id").alias("u"), F.col(column).alias("a"))
    b = sketches.select(F.col("doc_id").alias("v"), F.col(column).alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b")


def alike(pairs: DataFrame, sketches: DataFrame, hashes: int, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (u, v) whose signatures allow the link."""
    least = floor_of(percent, hashes)

    def work(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, hashes) for k in (2, 3))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= least))

    return _beside(pairs, sketches, "sig").mapInArrow(work, _pairs_schema(pairs)).distinct()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the limit."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (u, v) whose full sets confirm the link."""
    def work(batches):
        for batch in batches:
            keep = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
                    for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _beside(pairs, sets, "shingles").mapInArrow(work, _pairs_schema(pairs)).distinct()


def _joined_batches(rest: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    """All rows of both as one batch. Binary columns get 64-bit offsets: 32-bit ones are cut into chunks at 2 GB."""
    schema = pa.schema([pa.field(f.name, pa.large_binary() if pa.types.is_binary(f.type) else f.type) for f in batch.schema])
    batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)
    if rest is None or not rest.num_rows:
        return batch
    if not batch.num_rows:
        return rest
    whole = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()
    if len(whole) != 1:
        raise ValueError(f"the rows of one block came back in {len(whole)} batches")
    return whole[0]


def _prefix_buckets(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, component) of crowded (node, component): each node under its rarest shingles. Two sets at the limit
    share a shingle among the first size - ceil(percent * size) + 1 of each, whatever the common order; ordered by rarity,
    passages that many share come last and make no buckets."""
    def listed(batches):
        for batch in slices(batches, 200):
            node, component, raw = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            n = [len(r) // 8 for r in raw]
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([node.take(at), component.take(at), pa.array(np.repeat(n, n), pa.int64()),
                                              pa.array(np.frombuffer(b"".join(raw), np.int64))], ["node", "component", "size", "bucket"])

    id_type = crowded.schema["node"].dataType
    schema = T.StructType([T.StructField("node", id_type), T.StructField("component", id_type), T.StructField("size", T.LongType()), T.StructField("bucket", T.LongType())])
    rows = crowded.join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node").select("node", "component", "shingles").mapInArrow(listed, schema)
    known = rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")), "bucket")
    first = F.row_number().over(W.partitionBy("node").orderBy("held", "bucket"))  # a text's own shingles
    length = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    return known.withColumn("place", first).filter((F.col("place") <= length) & (F.col("held") > 1)).select("bucket", "node", "component")


def _across(shared: DataFrame, sketches: DataFrame, sets: DataFrame, hashes: int, block: int, percent: int) -> DataFrame:
    """Links (u, v) between different components within a bucket, by signatures and then full sets, block by block: as
    many as join the components that each block pair can join, so never more than the rows compared. The members of
    buckets with more than one block outside their largest component are first dealt anew by their rarest shingles."""
    def apart_of(rows):
        """(bucket, n, rest): buckets of more than one component, their members, and those outside the largest component."""
        parts = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("held"))
        found = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("held").alias("n"), F.max("held").alias("top"))
        return found.filter("parts > 1").select("bucket", "n", (F.col("n") - F.col("top")).alias("rest"))

    together = stage(shared.join(apart_of(shared), "bucket"), "apart")
    crowded = together.filter(F.col("rest") > block).select("node", "component").distinct()
    again = stage(_prefix_buckets(crowded, sets, percent), "rare-shingles")
    members = together.filter(F.col("rest") <= block).select("bucket", "node", "component").union(again.select(F.xxhash64("bucket").alias("bucket"), "node", "component"))
    apart = apart_of(members).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.join(apart, "bucket").select("bucket", "node", "component", "blocks", mine.alias("own"))
    known = members.join(sketches.select(F.col("doc_id").alias("node"), "sig"), "node").join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node")
    dealt = known.select("bucket", "own", "node", "component", "sig", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "sig", "shingles")
    dealt = dealt.repartition(partitions(shared.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    least = floor_of(percent, hashes)
    id_type = shared.schema["node"].dataType

    def pairs_of(rows: pa.RecordBatch):
        """Index pairs within one block pair."""
        sig = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint8).reshape(-1, hashes)
        component, own = rows.column(5).to_numpy(), rows.column(3).to_numpy()
        first, second = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        for at in range(0, len(left), 64):
            part = left[at:at + 64]
            apart = component[part][:, None] != component[right][None, :]
            if first == second:
                apart &= part[:, None] < right[None, :]
            x, y = apart.nonzero()
            for k in range(0, len(x), 65536):
                a, b = part[x[k:k + 65536]], right[y[k:k + 65536]]
                hit = (sig[a] == sig[b]).sum(axis=1) >= least
                yield a[hit], b[hit]

    def compare(batches):
        rest = None
        for batch in batches:
            rows = _joined_batches(rest, batch)
            yield from compared(rows, False)
            rest = tail(rows)
        if rest is not None:
            yield from compared(rest, True)

    def cuts(rows):
        key = [rows.column(k).to_numpy() for k in range(3)]
        change = np.zeros(rows.num_rows - 1, bool)
        for k in key:
            change |= k[1:] != k[:-1]
        return [0, *(np.flatnonzero(change) + 1), rows.num_rows]

    def tail(rows):
        return rows.slice(cuts(rows)[-2]) if rows.num_rows else None

    def compared(rows, last):
        if not rows.num_rows:
            return
        at, found_u, found_v = cuts(rows), [], []
        for a, b in zip(at, at[1:] if last else at[1:-1]):
            if b - a > 1:
                part = rows.slice(a, b - a)
                for x, y in joined(part):
                    found_u.append(a + x)
                    found_v.append(a + y)
        node = rows.column(4)
        yield pa.RecordBatch.from_arrays([node.take(pa.array(found_u, pa.int64())), node.take(pa.array(found_v, pa.int64()))], ["u", "v"])

    def joined(rows):
        """A link for each union of two components."""
        component, shingles = rows.column(5).to_pylist(), rows.column(7)
        root = {c: c for c in component}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for xs, ys in pairs_of(rows):
            for x, y in zip(xs.tolist(), ys.tolist()):
                a, b = find(component[x]), find(component[y])
                if a != b and linked(set_of(shingles, x), set_of(shingles, y), percent):
                    root[a] = b
                    yield x, y

    def set_of(column, k):
        return np.frombuffer(column[k].as_buffer(), np.uint64)

    schema = T.StructType([T.StructField("u", id_type), T.StructField("v", id_type)])
    found = dealt.mapInArrow(compare, schema)
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, bands: int | None = None, rows: int | None = None, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Bands and rows follow from the limit unless both are given."""
    if bands is None or rows is None:
        bands, rows = banding(percent)
    hashes = bands * rows
    sketches = sketch(docs, bands, rows)
    nodes = stage(sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "nodes")
    members = nodes.select("node", F.explode("keys").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stage(members.join(sizes, "bucket").select("bucket", "node", "n"), "buckets")
    score = shared.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = shared.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("best"))
    spokes = shared.join(hubs.select("bucket", F.col("best.node").alias("hub")), "bucket").filter("node != hub")
    spokes = spokes.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
    sets = full_sets(docs, nodes.join(shared.select("node").distinct(), "node").select("node", "digest"))
    links = confirm(alike(spokes, sketches, hashes, percent), sets, percent)
    found = stage(components(links), "components")
    placed = shared.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    more = _across(placed, sketches, sets, hashes, block, percent)
    where = found.select(F.col("node").alias("v"), F.col("component").alias("to"))
    lifted = (more.join(where, "v", "left").select("u", F.coalesce("to", "v").alias("cv"))
              .join(where.select(F.col("v").alias("u"), F.col("to").alias("from")), "u", "left").select(F.coalesce("from", "u").alias("u"), F.col("cv").alias("v")))
    joined = components(lifted)
    final = nodes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    final = final.join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select(
        "digest", F.coalesce("top", "component").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull() | F.col("component_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose document is kept. Ids that repeat are kept once for each row that holds the kept text."""
    kept = near_duplicates(docs, **options).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


@query("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), percent=CONTRACT_PERCENT)
