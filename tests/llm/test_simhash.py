"""SimHash near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from reactrix.llm import simhash

from .brute import SPACE, awkward, lowered, prose, table


def plain_fingerprint(text):
    words = re.findall(SPACE, lowered(text))
    if not words:
        return 0
    parts = [" ".join(words[k:k + 3]) for k in range(max(len(words) - 3, 0) + 1)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{position: component} of (doc_id, fp) rows, over all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [least[find(k)] for k in range(len(prints))]


def expected(rows):
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    return sorted((str(i), f"{fp:016x}", str(c)) for (i, fp), c in zip(prints, plain_components(prints)))


def result(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def edited():
    """Texts whose fingerprints differ by few bits: long texts with one to three changed words."""
    rng, rows = random.Random(5), []
    for k in range(5):
        words = prose(70 + k, 400).split()
        for step in range(14):
            rows.append((1000 * (k + 1) + step, " ".join(words), "en", "s"))
            words = words[:]
            words[rng.randrange(400)] = f"new{rng.random()}"
    return rows


@pytest.mark.parametrize("segments,crowd", [(32, 8), (32, 1), (16, 8), (8, 2)])
def test_matches_all_pairs(spark, segments, crowd):
    rows = awkward() + edited()
    assert result(simhash.near_duplicates(table(spark, rows), segments=segments, crowd=crowd)) == expected(rows)


def test_links_of_crowded_cells(spark):
    """Thousands of values a few bits from one centre, most of them in few cells: the components of all pairs."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 1500:
        x = centre
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 5, 6])):
            x ^= 1 << b
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    rows = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    frame = spark.createDataFrame(rows, "fp long")
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for crowd in (8, 100_000):
        edges = [(int(np.int64(r.u).view(np.uint64)), int(np.int64(r.v).view(np.uint64))) for r in simhash.links(frame, crowd=crowd).collect()]
        assert all(bin(u ^ v).count("1") <= 2 for u, v in edges)
        root = {p: p for p in prints}
        for u, v in edges:
            root[find(u)] = find(v)
        got = {}
        for p in prints:
            got.setdefault(find(p), set()).add(p)
        root = {p: p for p in prints}
        for k, a in enumerate(prints):
            for b in prints[:k]:
                if (a ^ b).bit_count() <= 2:
                    root[find(a)] = find(b)
        want = {}
        for p in prints:
            want.setdefault(find(p), set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_no_join_broadcasts_by_a_task_functions_estimate(spark, monkeypatch):
    """Spark sizes the laid nodes, up to 65 rows each, by the nodes: such a side must not go through the driver."""
    plans, plain = [], simhash.stage

    def kept(frame, *rest):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return plain(frame, *rest)

    monkeypatch.setattr(simhash, "stage", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        rows = simhash.near_duplicates(table(spark, awkward() + edited()))
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("Join" in plan for plan in plans) == 4  # grid, links, components, result
    assert not [plan for plan in plans if "Broadcast" in plan]


def test_embedding_bounds_differing_bits():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2), rng.integers(0, 2**63, 500, dtype=np.uint64)
    for segments in (8, 16, 32):
        bits = 64 // segments
        x, y = simhash.embed(a, segments), simhash.embed(b, segments)
        for at in range(0, 64, bits):
            field = [(v >> np.uint64(at)) & np.uint64((1 << bits) - 1) for v in (a, x)]
            assert [int(v).bit_count() for v in field[0]] == field[1].tolist()
        for p, q, u, v in zip(a.tolist(), b.tolist(), x.tolist(), y.tolist()):
            far = sum(abs((u >> at & (1 << bits) - 1) - (v >> at & (1 << bits) - 1)) for at in range(0, 64, bits))
            assert far <= (p ^ q).bit_count()


def test_long_text_and_empty_table(spark):
    text = prose(4, 70_000)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert simhash.near_duplicates(table(spark, [])).columns == ["doc_id", "fingerprint", "component_id", "kept"]


def test_only_null_ids(spark):
    rows = [(None, "a b c d", "en", "s"), (None, "a b c d", "en", "s"), (7, "", "en", "s"), (3, None, "en", "s")]
    assert result(simhash.near_duplicates(table(spark, rows))) == expected(rows)


def test_query_matches_all_pairs(spark):
    from reactrix.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(QUERIES["op11_simhash_near_dedup"](spark, sf)) == expected(rows)
