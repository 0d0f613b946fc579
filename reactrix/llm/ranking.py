"""Ranked lexical search over geometrically blocked posting lists, exact to the last rank.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII of a whole text, A-Z lower-cased. A term's
weight is w = floor(1000 * ln((2N + 2) / (2df + 1))); a posting's impact is (10**9 * tf) div (1000 * tf + 20 * m), m = 50 +
(50 * n * N) div L. A document scores the sum of w * impact over a query's distinct terms.

Index (every document and every term):
* Documents are laid out by similarity: the key is a 64-bit sketch, the sign of random hyperplanes over the document's
  distinct terms, so documents that share most terms lie next to each other. Range partitions are cut into cells of
  at most `CELL` neighbours (fewer where they hold `CELL_TERMS` distinct terms together), so copies, however many, spread over cells and partitions.
* Each posting list is thereby blocked by similarity: the block of a term in a cell holds the cell's documents that have
  the term. The block's summary is the coordinatewise maximum of impacts over its cell's documents. It is stored once per
  cell rather than once per block, as a copy per block would take the square of a document's distinct terms; the cell
  holds the block's documents, so the bound stays true for each of them.

Search, for a bounded block of queries at a time:
* The bound of (query, cell) is the sum of w * summary over the query's terms, no less than any score in the cell.
* The cells with the best bounds are scored first; their k-th best score is a floor under the true k-th best.
* Then each cell is skipped for a query only if its bound is below that floor or below the k-th best that its task has
  seen. Documents of the other cells are scored exactly, with integers that doubles hold without rounding.

Null texts and texts without a term are no documents of the index. A null id ranks after other ids of equal score.
Repeated rows are documents of their own. Repeated item ids are ranked apart, row by row; items without a term or a match
give no rows. Texts of any length count whole. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from reactrix.session import drop_stage, stage

from .common import documents, partitions, query, slices

CELL = 64
CELL_TERMS = 1 << 16  # distinct terms of all documents together after which a cell ends early
SEEDS = 4  # cells a task proposes for a query's first scores
ITEMS = 256  # queries searched in one pass
TOP = 50
SKETCH_TERMS = 1 << 14  # terms sketched at once
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def sketch(terms: list[bytes]) -> int:
    """Signed 64-bit number whose bits are the signs of 64 random hyperplanes over the distinct terms."""
    import xxhash

    ones = np.zeros(64, np.int64)
    for at in range(0, len(terms), SKETCH_TERMS):
        h = np.array([xxhash.xxh3_64_intdigest(t) for t in terms[at:at + SKETCH_TERMS]], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(terms)).tobytes(), "big", signed=True)


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers at the least of 1, 2, 4 or 8 bytes that holds them all, the width in the first byte."""
    top = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - (w == 8)))
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def term_vectors(docs: DataFrame) -> DataFrame:
    """Staged (doc_id, n, geo, terms, tfs) of the rows that hold a term; terms are joined by spaces, counts packed."""
    def work(batches):
        for batch in slices(batches):
            keep, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = terms_of(text)
                if found:
                    counts = Counter(found)
                    keep.append(k)
                    rows.append((len(found), sketch(list(counts)), b" ".join(counts).decode(), packed(np.fromiter(counts.values(), np.int64, len(counts)))))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep, pa.int64())), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary())], names)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("geo", T.LongType()),
                           T.StructField("terms", T.StringType()), T.StructField("tfs", T.BinaryType())])
    names = schema.names
    return stage(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(work, schema), "term-vectors")


class Index:
    """cells: staged (cell, doc_ids, terms, summary, sizes, places, impacts): the terms of a cell once, joined by spaces, their
    greatest impacts, and its documents' vectors one after another as places among those terms; df: staged (term, df); n: documents."""

    def __init__(self, cells: DataFrame, df: DataFrame, n: int):
        self.cells, self.df, self.n = cells, df, n

    def drop(self) -> None:
        drop_stage(self.cells)
        drop_stage(self.df)


def build_index(docs: DataFrame, cell: int = CELL) -> Index:
    vectors = term_vectors(docs)
    totals = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = totals["n"], totals["l"] or 1
    df = stage(vectors.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "document-counts")
    m = F.lit(50) + F.expr(f"(50L * n * {n_docs}L) div {n_terms}L")
    ready = vectors.select("doc_id", "geo", "terms", "tfs", m.alias("m"))
    laid = ready.repartitionByRange(partitions(docs.sparkSession), "geo", "doc_id", F.xxhash64("terms")).sortWithinPartitions("geo", "doc_id")

    def work(batches):
        number, held, size = itertools.count(TaskContext.get().partitionId() << 40), [], 0
        for batch in slices(batches, cell):
            for row in zip(*(batch.column(c).to_pylist() for c in range(4))):
                held.append((row[0], row[1].split(" "), unpacked(row[2]), row[3]))
                size += len(held[-1][1])
                if len(held) >= cell or size >= CELL_TERMS:
                    yield one_cell(next(number), held)
                    held, size = [], 0
        if held:
            yield one_cell(next(number), held)

    def one_cell(number, rows):
        sizes = np.array([len(r[1]) for r in rows], np.int64)
        tf = np.concatenate([r[2] for r in rows])
        impact = (10**9 * tf) // (1000 * tf + 20 * np.repeat(np.array([r[3] for r in rows], np.int64), sizes))
        known = {}
        places = np.array([known.setdefault(t, len(known)) for r in rows for t in r[1]], np.int64)
        summary = np.zeros(len(known), np.int64)
        np.maximum.at(summary, places, impact)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(id_type)), pa.array([" ".join(known)], pa.string()),
            *(pa.array([packed(x)], pa.binary()) for x in (summary, sizes, places, impact))], names)

    schema = T.StructType([
        T.StructField("cell", T.LongType()), T.StructField("doc_ids", T.ArrayType(vectors.schema["doc_id"].dataType)), T.StructField("terms", T.StringType()),
        *(T.StructField(c, T.BinaryType()) for c in ("summary", "sizes", "places", "impacts"))])
    names, id_type = schema.names, to_arrow_type(vectors.schema["doc_id"].dataType)
    cells = stage(laid.select("doc_id", "terms", "tfs", "m").mapInArrow(work, schema), "cells")
    drop_stage(vectors)
    return Index(cells, df, n_docs)


class _Queries:
    """A block of queries as term -> (query numbers, weights), and sums of weight times impact over them."""

    def __init__(self, queries: list[list[tuple[str, int]]]):
        found = {}
        for q, terms in enumerate(queries):
            for t, w in terms:
                found.setdefault(t, []).append((q, w))
        self.n, self.place = len(queries), {t: k for k, t in enumerate(found)}
        lengths = [len(v) for v in found.values()]
        self.start = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        flat = [x for v in found.values() for x in v]
        self.query = np.array([q for q, _ in flat], np.int64)
        self.weight = np.array([w for _, w in flat], np.float64)

    def places_of(self, terms: str) -> np.ndarray:
        """The place of each of a cell's terms among the queries' terms, -1 where no query holds it."""
        get = self.place.get
        return np.array([get(t, -1) for t in terms.split(" ")], np.int64)

    def _spread(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each matched term its queries: (index of the match, position in query/weight)."""
        lengths = self.start[place + 1] - self.start[place]
        index = np.repeat(np.arange(len(place)), lengths)
        inside = np.arange(len(index)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return index, self.start[place][index] + inside

    def bounds(self, place: np.ndarray, summary: np.ndarray) -> np.ndarray:
        """Per query the sum of weight times summary over a cell's terms (their `places_of`)."""
        held = place >= 0
        index, at = self._spread(place[held])
        return np.bincount(self.query[at], self.weight[at] * summary[held][index], self.n)

    def scores(self, place: np.ndarray, sizes: np.ndarray, places: np.ndarray, impacts: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """(documents, queries) exact scores of the queries alive."""
        found = place[places]
        held = found >= 0
        owner = np.repeat(np.arange(len(sizes)), sizes)[held]
        index, at = self._spread(found[held])
        use = alive[self.query[at]]
        index, at = index[use], at[use]
        key = owner[index] * self.n + self.query[at]
        return np.bincount(key, self.weight[at] * impacts[held][index], len(sizes) * self.n).reshape(len(sizes), self.n)


class _Best:
    """The k best (score, id) of each query in one task; equal scores by id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.rows, self.floor = k, [[] for _ in range(n)], np.zeros(n)

    def add(self, ids: list, scores: np.ndarray) -> None:
        for q in np.flatnonzero((scores > 0).any(axis=0) & (scores.max(axis=0) >= self.floor)).tolist():
            column = scores[:, q]
            rows = self.rows[q]
            rows += [(-column[d], ids[d] is None, 0 if ids[d] is None else ids[d]) for d in np.flatnonzero((column > 0) & (column >= self.floor[q])).tolist()]
            if len(rows) >= self.k:
                rows.sort()
                del rows[self.k:]
                self.floor[q] = -rows[-1][0]


def _scored(cells: DataFrame, block: list, k: int, floors: np.ndarray | None, alone: dict | None) -> DataFrame:
    """(q, score, doc_id): each task's k best per query. With `alone` only those (cell -> queries), else the cells that the bounds
    and floors leave."""
    id_type = cells.schema["doc_ids"].dataType.elementType

    def work(batches):
        known, best = _Queries(block), _Best(len(block), k)
        for batch in slices(batches, 16):
            for cell, ids, terms, *numbers in zip(*(batch.column(c).to_pylist() for c in range(7))):
                place = known.places_of(terms)
                summary, sizes, places, impacts = map(unpacked, numbers)
                if alone is None:
                    bound = known.bounds(place, summary)
                    alive = (bound > 0) & (bound >= np.maximum(floors, best.floor))
                else:
                    alive = np.zeros(len(block), bool)
                    alive[alone.get(cell, [])] = True
                if alive.any():
                    best.add(ids, known.scores(place, sizes, places, impacts, alive))
        rows = [(q, int(-s), None if missing else i) for q, found in enumerate(best.rows) for s, missing, i in found]
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], arrow_id)], ["q", "score", "doc_id"])

    arrow_id = to_arrow_type(id_type)
    return cells.mapInArrow(work, T.StructType([T.StructField("q", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("doc_id", id_type)]))


def _proposed(cells: DataFrame, block: list, seeds: int) -> dict[int, list[int]]:
    """cell -> queries: the `seeds` cells of the best bounds for each query."""
    def work(batches):
        known, rows = _Queries(block), []
        best = [[] for _ in block]
        for batch in slices(batches, 16):
            for cell, terms, summary in zip(*(batch.column(c).to_pylist() for c in range(3))):
                bound = known.bounds(known.places_of(terms), unpacked(summary))
                for q in np.flatnonzero(bound > 0).tolist():
                    if len(best[q]) < seeds or bound[q] > best[q][-1][0]:
                        best[q] = sorted([*best[q], (bound[q], cell)], reverse=True)[:seeds]
        rows = [(q, b, c) for q, found in enumerate(best) for b, c in found]
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())], ["q", "bound", "cell"])

    found = cells.select("cell", "terms", "summary").mapInArrow(work, "q int, bound double, cell long")
    top = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "cell"))).filter(F.col("place") <= seeds)
    out = {}
    for r in top.select("q", "cell").collect():  # queries of the block x seeds
        out.setdefault(r["cell"], []).append(r["q"])
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = TOP, at_once: int = ITEMS, seeds: int = SEEDS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = items.sparkSession

    def split(batches):
        number = itertools.count(TaskContext.get().partitionId() << 40)
        for batch in slices(batches):
            sets = [sorted({t.decode() for t in terms_of(x)}) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([next(number) for _ in sets], pa.int64()), batch.column(0), pa.array(sets, pa.list_(pa.string()))], ["uid", "item_id", "terms"])

    item_type = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("item_id", item_type), T.StructField("terms", T.ArrayType(T.StringType()))])
    known = stage(items.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(split, schema), "items")
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n + 2) / (2.0 * F.col("df") + 1)))
    weighted = known.select("uid", F.explode("terms").alias("term")).join(index.df, "term").select("uid", "term", weight.alias("w"))
    per_item = stage(weighted.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms")).join(known.select("uid", "item_id"), "uid"), "weighted-items")
    answers, rows = [], per_item.orderBy("uid").toLocalIterator()
    while block := list(itertools.islice(rows, at_once)):
        queries = [[(t["term"], t["w"]) for t in r["terms"]] for r in block]
        alone = _proposed(index.cells, queries, seeds)
        first = index.cells.filter(F.col("cell").isin(list(alone)))
        seen = _ranked(_scored(first, queries, k, None, alone), k).filter(F.col("rank") == k).select("q", "score").collect()
        floors = np.zeros(len(queries))
        for r in seen:
            floors[r["q"]] = r["score"]
        best = _ranked(_scored(index.cells, queries, k, floors, None), k)
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(block)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", item_type)]))
        answers.append(stage(best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"), "answers"))
    drop_stage(known)
    drop_stage(per_item)
    if not answers:
        schema = T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
                               T.StructField("doc_id", index.cells.schema["doc_ids"].dataType.elementType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    out = answers[0]
    for a in answers[1:]:
        out = out.union(a)
    return out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sizes AS MATERIALIZED (SELECT uid, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM sizes),
tf AS MATERIALIZED (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(terms) AS term FROM d) GROUP BY uid, term),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2e0 * any_value(n_docs) + 2) / (2e0 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
items AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS terms FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT q, item_id, unnest(terms) AS term FROM items),
impacts AS MATERIALIZED (SELECT t.uid, t.term, (1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * s.n * total.n_docs) // total.n_terms)) AS x FROM tf t JOIN sizes s ON s.uid = t.uid, total),
scores AS (SELECT a.q, any_value(a.item_id) AS item_id, i.uid, CAST(sum(w.w * i.x) AS BIGINT) AS score FROM asked a JOIN w ON w.term = a.term JOIN impacts i ON i.term = a.term GROUP BY a.q, i.uid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT s.item_id, s.score, sizes.doc_id, row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, sizes.doc_id) AS rank FROM scores s JOIN sizes ON sizes.uid = s.uid WHERE s.score > 0)
WHERE rank <= 50"""


@query("op13_blocked_search", SQL)
def op13_blocked_search(spark, sf_dir):
    index = build_index(documents(spark, sf_dir))
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    index.drop()
    return found
