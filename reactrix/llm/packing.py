"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Large-item matching: pieces above a third of the capacity are paired at most twice per sequence, largest first, each
with the largest partner that fits; smaller pieces then fill the tightest remaining gaps, largest first, and open new
sequences only where none fits. The plan needs the number of pieces of each length only: at most `capacity` x `buckets`
counts, whatever the table's size. It is made for runs of equal sequences at once, so its size is bounded by the
capacity too. Pieces of full capacity are sequences of their own and need neither plan nor rank. The others take their place
by their rank within their length, ranked in `buckets` parts per length (at least as many as the session's shuffle
partitions), so a length that a third of the pieces share is no single group.

Tokens are written once to the shared folder, and every later step reads the narrow columns of that table. `copy_id` numbers
the rows of `docs` (by their first pieces): (copy_id, piece) is unique however often a doc_id repeats, and joins places with token ids.

Null text counts as empty; an empty text is one piece holding the end id. Repeated rows are packed once each. A null id
is packed like any other. Longer texts are cut into pieces of full capacity of which the first may be shorter. Extra
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reactrix.session import stage

from .common import documents, partitions, query, slices

CAPACITY = 2048
BUCKETS = 64


def default_tokenizer() -> tuple[str, str]:
    """The vocabulary as the `tokenizers` library reads it, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(vocabulary: str, ranks: str | None = None):
    """Function from a text to its ids, as the `tokenizers` library gives them for `vocabulary`. Where the same
    vocabulary is given as `ranks`, plain Latin text goes through the faster reader of it, which yields the same ids. Texts that
    hold one of the vocabulary's special tokens go through the library, which reads it as that token."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    if ranks is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [re.escape(t.content) for t in slow.get_added_tokens_decoder().values()]
    unusual = re.compile("|".join(["[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f]", *special])).search
    return lambda text: slow.encode(text, add_special_tokens=False).ids if unusual(text) else fast.encode_ordinary(text)


def tokenize(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, end_id: int = 0,
             capacity: int = CAPACITY) -> DataFrame:
    """Staged table of pieces: doc_id, copy_id, piece, start, length, ids (little-endian unsigned 32-bit, as binary), ids_crc32."""
    if vocabulary is None:
        vocabulary, ranks = default_tokenizer()

    def pieces(batches):
        encode, number = encoder(vocabulary, ranks), TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            ids, copy, piece, start, length, raw = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = array("I", encode(text) if text else ())
                tokens.append(end_id)
                first = len(tokens) % capacity or capacity
                cuts = [0, *range(first, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    ids.append(doc_id)
                    copy.append(number)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    raw.append(tokens[a:b].tobytes())
                number += len(cuts) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(copy, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "copy_id", "piece", "start", "length", "ids"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("copy_id", T.LongType()), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    cut = docs.select("doc_id", "text").mapInArrow(pieces, schema)
    return stage(cut.withColumn("ids_crc32", F.crc32("ids")), "token-pieces")


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """From the number of pieces of each length: (length, first rank, pieces per sequence, first sequence, offset) of each
    run of equal sequences. Pieces of a length from `first rank` on fill that run's sequences, `per` in each."""
    left = {k: v for k, v in counts.items() if v > 0}
    rank = dict.fromkeys(left, 0)
    out, sequences = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room -> runs of sequences with it, as (first, number)
    order: list[int] = []  # the rooms in ascending order

    def put(length, per, first, offset, pieces):
        out.append((length, rank[length], per, first, offset))
        rank[length] += pieces
        left[length] -= pieces

    def opened(room, first, number):
        if room and number:
            if room not in gaps:
                bisect.insort(order, room)
                gaps[room] = []
            gaps[room].append((first, number))

    large = sorted(x for x in left if 3 * x > capacity)
    for length in reversed(large):
        k = bisect.bisect_right(large, min(length, capacity - length)) - 1
        while left[length]:
            while k >= 0 and (left[large[k]] == 0 or (large[k] == length and left[length] < 2)):
                k -= 1
            partner = large[k] if k >= 0 else None
            if partner is None:
                number = left[length]
                put(length, 1, sequences, 0, number)
                opened(capacity - length, sequences, number)
            elif partner == length:
                number = left[length] // 2
                put(length, 2, sequences, 0, 2 * number)
                opened(capacity - 2 * length, sequences, number)
            else:
                number = min(left[length], left[partner])
                put(length, 1, sequences, 0, number)
                put(partner, 1, sequences, length, number)
                opened(capacity - length - partner, sequences, number)
            sequences += number
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            k = bisect.bisect_left(order, length)
            if k == len(order):
                opened(capacity, sequences, number := -(-left[length] // (capacity // length)))
                sequences += number
                continue
            room = order[k]
            first, number = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], order[k]
            per = room // length
            whole = min(number, left[length] // per)
            if whole:
                put(length, per, first, capacity - room, whole * per)
                opened(room - per * length, first, whole)
            if rest := min(left[length], per) if whole < number else 0:
                put(length, rest, first + whole, capacity - room, rest)
                opened(room - rest * length, first + whole, 1)
                whole += 1
            opened(room, first + whole, number - whole)
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """The pieces' rows of (doc_id, copy_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    buckets = buckets or max(BUCKETS, partitions(pieces.sparkSession))
    named = pieces.select("doc_id", "copy_id", "piece", "start", "length", "ids_crc32")
    # numbers below zero are apart from the plan's; copy_id + piece is unique
    whole = named.filter(F.col("length") == capacity).select("*", (-1 - F.col("copy_id") - F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    narrow = named.filter(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("copy_id", "piece"), F.lit(buckets)).cast("int"))
    before = np.zeros((capacity + 1, buckets), np.int64)
    counted = narrow.groupBy("length", "bucket").count().toPandas()
    before[counted["length"].to_numpy(int), counted["bucket"].to_numpy(int)] = counted["count"].to_numpy(int)
    totals = before.sum(axis=1)
    before = before.cumsum(axis=1) - before
    plan = np.array(sorted(plan_sequences({int(k): int(totals[k]) for k in totals.nonzero()[0]}, capacity)), np.int64).reshape(-1, 5)
    key = (plan[:, 0] << 48) + plan[:, 1]

    def assign(batches):
        for batch in batches:
            length, bucket, local = (batch.column(k).to_numpy() for k in (4, 6, 7))
            rank = before[length, bucket] + local - 1
            row = plan[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            at = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(6)), pa.array(row[:, 3] + at // row[:, 2]), pa.array(row[:, 4] + at % row[:, 2] * length)],
                [*batch.schema.names[:6], "sequence_id", "offset"])

    ranked = narrow.withColumn("local", F.row_number().over(W.partitionBy("length", "bucket").orderBy("copy_id", "piece")).cast("long"))
    schema = T.StructType([*(narrow.schema[c] for c in narrow.columns[:6]), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return whole.union(ranked.mapInArrow(assign, schema))


def pack(docs: DataFrame, capacity: int = CAPACITY, buckets: int | None = None, **tokenizer) -> tuple[DataFrame, DataFrame]:
    """(pieces with their token ids, their places): join on (copy_id, piece) and order by offset to read a sequence."""
    pieces = tokenize(docs, capacity=capacity, **tokenizer)
    return pieces, place(pieces, capacity, buckets)


def pack_with_ids(docs: DataFrame, capacity: int = CAPACITY, **tokenizer) -> DataFrame:
    """The places with each piece's token ids: a sequence is the ids of its rows in the order of their offsets."""
    pieces, places = pack(docs, capacity, **tokenizer)
    return places.join(pieces.select("copy_id", "piece", "ids"), ["copy_id", "piece"]).select(*places.columns, "ids")


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))[1]
