"""Packing: round trip of the tokens, gapless places, and the number of sequences."""

import random
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from reactrix.llm import packing

from .brute import awkward, table


def test_round_trip(spark):
    rows = awkward()
    pieces, places = packing.pack(table(spark, rows))
    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((repr(i), reader.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in rows)
    by_doc = defaultdict(list)
    for p in pieces.collect():
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and p.length == len(p.ids) // 4 <= 2048
        by_doc[repr(p.doc_id)].append(p)
    for name, ids in want:
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        mine = sorted(by_doc[name], key=lambda p: p.piece)
        if name != "5":  # two equal rows
            assert b"".join(bytes(p.ids) for p in mine) == raw
            assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
            assert all(p.length == 2048 for p in mine[1:])
        else:
            assert len(mine) == 2 and all(bytes(p.ids) == raw for p in mine)
    placed = places.collect()
    assert len(placed) == sum(map(len, by_doc.values()))
    sequences = defaultdict(list)
    for p in placed:
        sequences[p.sequence_id].append((p.offset, p.length))
    for places_of in sequences.values():
        end = 0
        for offset, length in sorted(places_of):
            assert offset == end
            end += length
        assert end <= 2048


def test_ids_are_those_of_the_tokenizers_library():
    vocabulary, ranks = packing.default_tokenizer()
    fast, slow = packing.encoder(vocabulary, ranks), packing.encoder(vocabulary)
    for text in ("a  b \n c\t\td  ", "Éçole naïve  straße 123.45!!", "x" * 3000, "a b c 日本 \x85 <|endoftext|>", "it's we'll  \n\n\n", "\r\n \r\n"):
        assert fast(text) == slow(text)


def read_back(rows):
    """{(doc_id, copy_id): ids} from rows of sequences with token ids."""
    docs = defaultdict(list)
    for r in rows:
        docs[(r.doc_id, r.copy_id)].append((r.start, bytes(r.ids)))
    return {k: b"".join(ids for _, ids in sorted(v)) for k, v in docs.items()}


def test_copies_of_one_id_read_back_apart(spark):
    """Mixing emits copies under one id: pieces join their places one to one, and the sequences hold whole documents."""
    long_text = awkward()[3][1]
    rows = [(5, "one two three", "en", "s")] * 3 + [(6, long_text, "en", "s")] * 2 + [(None, "x", "en", "s")] * 2
    pieces, places = packing.pack(table(spark, rows))
    assert places.join(pieces.select("copy_id", "piece", "ids"), ["copy_id", "piece"]).count() == pieces.count() == places.count()
    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_with_ids(table(spark, rows)).collect()
    want = sorted((repr(i), b"".join(t.to_bytes(4, "little") for t in [*reader.encode(text, add_special_tokens=False).ids, 0])) for i, text, *_ in rows)
    assert sorted((repr(i), ids) for (i, _), ids in read_back(got).items()) == want


def test_full_pieces_need_no_plan(spark):
    places = packing.place(packing.tokenize(table(spark, awkward()), capacity=50), capacity=50).collect()
    whole = [p for p in places if p.length == 50]
    assert len(whole) > 100 and all(p.offset == 0 and p.sequence_id < 0 for p in whole) and len({p.sequence_id for p in whole}) == len(whole)
    assert all(p.sequence_id >= 0 for p in places if p.length < 50)


def test_special_tokens_are_those_of_the_plain_call():
    vocabulary, ranks = packing.default_tokenizer()
    plain = Tokenizer.from_file(vocabulary)
    for special in plain.get_added_tokens_decoder().values():
        text = f"a {special.content} b"
        assert packing.encoder(vocabulary, ranks)(text) == plain.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert packing.pack(table(spark, []))[1].count() == 0


def test_plan_is_valid_and_never_worse_than_best_fit():
    for seed in range(150):
        rng = random.Random(seed)
        counts = {rng.randint(1, 200): rng.randint(1, 40) for _ in range(rng.randint(1, 50))}
        rows = defaultdict(list)
        for run in packing.plan_sequences(counts, 200):
            rows[run[0]].append(run)
        filled = defaultdict(list)
        for length, n in counts.items():
            for rank in range(n):
                _, start, per, first, offset = max((r for r in rows[length] if r[1] <= rank), key=lambda r: r[1])
                at = rank - start
                filled[first + at // per].append((offset + at % per * length, length))
        for places in filled.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 200 and sum(3 * length > 200 for _, length in places) <= 2
        rooms = []
        for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= length]
            if fits:
                rooms[min(fits, key=rooms.__getitem__)] -= length
            else:
                rooms.append(200 - length)
        assert len(filled) <= len(rooms)
