"""Blocked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from reactrix.llm import ranking
from reactrix.llm.queries import ORACLES, QUERIES
from tools.parity import compare, connect

from .brute import awkward, lowered, prose, table

SMALL = "/root/testdata/sf0.001"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain(docs, items, k=50):
    """Rows (item_id, rank, doc_id, score) as strings, sorted."""
    counts = [(i, Counter(re.findall(TERM, lowered(t)))) for i, t, *_ in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(re.findall(TERM, lowered(text))) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(str(item), r + 1, str(i), -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def searched(spark, docs, items, **options):
    index = ranking.build_index(table(spark, docs), cell=options.pop("cell", 4))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, q int")
    return sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in ranking.search(index, frame, **options).collect())


def corpus():
    rng = random.Random(8)
    rows = awkward()
    texts = [prose(500 + k, rng.choice([5, 40, 200]), vocabulary=300) for k in range(60)]
    rows += [(100 + k, t, "en", "s") for k, t in enumerate(texts)]
    rows += [(300 + k, texts[0], "en", "s") for k in range(70)]  # one text in a large share of the rows: ties by id
    rows += [(400 + k, texts[1] + f" unique{k}", "en", "s") for k in range(30)]
    return rows


@pytest.mark.parametrize("k,at_once,seeds", [(5, 256, 4), (50, 3, 1), (200, 2, 2)])
def test_matches_scoring_everything(spark, k, at_once, seeds):
    docs = corpus()
    items = [(k, " ".join((d[1] or "").split()[:25])) for k, d in enumerate(docs[::9])]
    items += [(900, None), (901, ""), (902, "!!! ???"), (903, "wordthatnobodyholds"), (904, "日本語 UNIQUE3 x"), (1, "the the the mi"), (None, "lo or")]
    assert searched(spark, docs, items, k=k, at_once=at_once, seeds=seeds) == plain(docs, items, k)


def test_null_ids_rank_last_among_equals(spark):
    docs = [(None, "a b", "en", "s"), (4, "a b", "en", "s"), (2, "a b", "en", "s"), (2, "a b", "en", "s"), (9, "c", "en", "s")]
    assert [r[1:3] for r in searched(spark, docs, [(1, "A")], k=10)] == [(1, "2"), (2, "2"), (3, "4"), (4, "None")]


def test_summaries_bound_every_document(spark):
    docs = corpus()
    index = ranking.build_index(table(spark, docs), cell=8)
    cells = index.cells.collect()
    assert sum(len(c.doc_ids) for c in cells) == sum(bool(re.findall(TERM, lowered(t))) for _, t, *_ in docs)
    assert max(len(c.doc_ids) for c in cells) <= 8
    for c in cells:
        summary, sizes, places, impacts = map(ranking.unpacked, (c.summary, c.sizes, c.places, c.impacts))
        assert len(sizes) == len(c.doc_ids) and sizes.sum() == len(places) == len(impacts)
        assert (summary[places] >= impacts).all() and len(c.terms.split(" ")) == len(summary)


def test_cells_end_early_on_long_documents(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CELL_TERMS", 100)
    docs = [(k, prose(k, 300, vocabulary=2000), "en", "s") for k in range(20)]
    items = [(1, docs[3][1][:200])]
    assert searched(spark, docs, items, cell=64, k=6) == plain(docs, items, 6)


def test_bounds_and_scores():
    known = ranking._Queries([[("a", 10), ("b", 20)], [("b", 5)], [("z", 7)]])
    place = known.places_of("a b q")
    assert known.bounds(place, np.array([3, 4, 9])).tolist() == [110.0, 20.0, 0.0]
    scores = known.scores(place, np.array([2, 1]), np.array([0, 1, 0]), np.array([1, 2, 3]), np.array([True, False, True]))
    assert scores.tolist() == [[50.0, 0.0, 0.0], [30.0, 0.0, 0.0]]


def test_packing():
    for top in (0, 255, 256, 65_536, 2**40):
        assert ranking.unpacked(ranking.packed(np.array([0, top]))).tolist() == [0, top]
    assert ranking.unpacked(ranking.packed(np.array([], np.int64))).tolist() == []


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a b")]) == []
    assert searched(spark, [(1, None, "en", "s"), (2, "...", "en", "s")], [(1, "a b")]) == []
    assert searched(spark, corpus()[:5], []) == []


def test_terms_follow_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128, 0x3000), 0x1F600])) for _ in range(40))
        assert [t.decode() for t in ranking.terms_of(text.encode())] == re.findall(TERM, lowered(text))


def test_query_matches_duckdb(spark):
    df = QUERIES["op13_blocked_search"](spark, SMALL)
    assert compare(df.collect(), df.columns, connect(SMALL).sql(ORACLES["op13_blocked_search"])) is None
