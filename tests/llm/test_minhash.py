"""Near duplicates against all pairs, and components against a plain union."""

import random

from reactrix.llm import components, minhash

from .brute import awkward, near_components, prose, table


def test_matches_all_pairs(spark):
    rows = [r for r in awkward() if r[0] is not None and r[0] != 5 and r[0] not in (4, 12)]
    rng = random.Random(3)
    for k in range(6):  # chains in which each text changes two words of the one before
        words = prose(50 + k, 150).split()
        for step in range(12):
            rows.append((1000 * (k + 1) + step, " ".join(words), "en", "s"))
            words = words[:]
            for _ in range(2):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
    want, sizes = near_components(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, rows), block=4).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_links_do_not_depend_on_the_hub(spark):
    """Members of one bucket that are linked to each other but not to the hub."""
    base = prose(9, 200).split()
    rows = []
    for k in range(8):  # eight pairs; pairs differ from each other by 12 words
        words = base[:]
        for j in range(12):
            words[(k * 23 + j * 7) % 200] = f"v{k}x{j}"
        rows += [(2 * k, " ".join(words), "en", "s"), (2 * k + 1, " ".join([*words[:-1], f"end{k}"]), "en", "s")]
    want, _ = near_components(rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows)).collect()} == want


def test_awkward_rows(spark):
    rows = awkward()
    got = [tuple(r) for r in minhash.near_duplicates(table(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert (2, 0, 2, True) in got and (3, 0, 3, True) in got
    assert got.count((5, 4, 1, False)) == 2
    assert [r[2:] for r in got if r[0] is None] == [(None, True)]
    assert {r[0]: r[2] for r in got}[12] == 4
    kept = minhash.drop_near_duplicates(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r[0] for r in got if r[3] and r[0] is not None})
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_long_words_of_signature_blocks():
    known = minhash._WordHash()
    sets = [minhash.shingle_set(prose(k, 300), known) for k in range(3)]
    sig = minhash.signatures(sets, 60)
    assert sig.shape == (3, 60) and minhash.band_keys(sig, 10, 6).shape == (3, 10)
    assert (minhash.signatures([sets[1]], 60)[0] == sig[1]).all()


def test_default_and_stage_take_sets_from_080(spark):
    """Pairs on both sides of 0.80 and of 0.85: three changed words of 150 give 131/161, two give 136/156, four 126/166."""
    import corpus_pipeline

    rows = []
    for k in range(30):
        words = prose(300 + k, 150).split()
        rows.append((10 * k, " ".join(words), "en", "s"))
        for j in range(2 + k % 3):
            words[20 + 30 * j] = f"new{k}x{j}"
        rows.append((10 * k + 1, " ".join(words), "en", "s"))
    docs = table(spark, rows)
    want, _ = near_components(rows, 80)
    strict, _ = near_components(rows, 85)
    assert sum(i == c for i, c in want.items()) == 40 and sum(i == c for i, c in strict.items()) == 50
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {i for i, c in want.items() if i == c}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, percent=85).collect()} == strict


def test_bands_follow_the_limit():
    assert minhash.banding(85) == (30, 6) and minhash.banding(80) == (35, 5)
    for percent in (50, 70, 80, 85, 90, 95):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6 and bands * rows <= minhash.HASHES
        assert 0 < minhash.floor_of(percent, bands * rows) / (bands * rows) < percent / 100


def test_blocks_of_more_than_2_gb_keep_every_row():
    """Two sets of 1.1 GB: 32-bit offsets end at 2 GB. The zeros are shared, only the joined column takes memory."""
    import numpy as np
    import pyarrow as pa

    size = 1_100_000_000
    value = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, size], np.int32)), pa.py_buffer(np.zeros(size, np.uint8))])
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), value], ["node", "shingles"]) for k in range(2)]
    rows = minhash._joined_batches(minhash._joined_batches(None, batches[0]), batches[1])
    assert rows.column(0).to_pylist() == [0, 1] and [len(x.as_buffer()) for x in rows.column(1)] == [size, size]


def test_common_passages_make_no_quadratic_buckets(spark, monkeypatch):
    """Many texts that share half of their words, some with near copies: the links of all pairs, through few comparisons."""
    shared_part = prose(1, 80)
    rows = [(k, f"{shared_part} {prose(2000 + k, 70, 3000)}", "en", "s") for k in range(240)]
    rows += [(1000 + k, f"{shared_part} {prose(2000 + k, 70, 3000)} end{k}", "en", "s") for k in range(0, 240, 6)]
    docs = table(spark, rows)
    want, _ = near_components(rows, 80)
    assert sum(i != c for i, c in want.items()) == 40
    dealt = []
    kept = minhash._prefix_buckets
    monkeypatch.setattr(minhash, "_prefix_buckets", lambda *a: dealt.append(kept(*a)) or dealt[-1])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, block=8).collect()}
    assert got == want
    sizes = [r["count"] for r in dealt[0].groupBy("bucket").count().collect()]
    assert sum(n * (n - 1) // 2 for n in sizes) < 280 * 60  # all pairs of 280 texts: 39 060


def test_rarest_shingles_of_linked_sets_meet():
    """Any order: two sets at the limit share one of the first size - ceil(limit * size) + 1 of each."""
    import math

    rng = random.Random(4)
    for percent in (80, 85):
        for _ in range(200):
            a = set(rng.sample(range(200), rng.randint(1, 60)))
            b = {x if rng.random() < 0.93 else x + 1000 for x in a}
            if 100 * len(a & b) >= percent * len(a | b):
                order = {x: rng.random() for x in a | b}
                first = [set(sorted(s, key=order.get)[:len(s) - math.ceil(len(s) * percent / 100) + 1]) for s in (a, b)]
                assert first[0] & first[1]
