"""Content sort, line windows and mixing against plain versions."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reactrix.llm import exact, lines, mixing

from .brute import SPACE, awkward, line_dedup, lowered, prose, table


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(spark, keep):
    rows = awkward() + [(100 + k, "Copy", "en", "hot") for k in range(150)]
    got = exact.exact_duplicates(table(spark, rows), keep=keep, salts=4).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lowered(t)].append(i)
    want = []
    for i, t, *_ in rows:
        ids = [x for x in groups[lowered(t)] if x is not None]
        best = (min if keep == "smallest" else max)(ids) if ids else None
        want.append((i, best, len(groups[lowered(t)]), i == best, hashlib.sha256(lowered(t).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_tables(spark):
    none = table(spark, [])
    assert exact.exact_duplicates(none).count() == 0
    assert lines.drop_repeated_lines(none).count() == 0
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_exact_plan_moves_texts_once(spark):
    import contextlib
    import io

    docs = table(spark, awkward())
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        exact.exact_duplicates(docs).explain()
    assert "python" not in text.getvalue().lower()


def test_line_windows(spark):
    rows = awkward()
    docs = table(spark, rows)
    got = lines.drop_repeated_lines(docs)
    made = ["line_total", "line_removed"]
    assert got.columns == [c for c in docs.columns if c not in made] + made
    want = line_dedup(rows)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        original = [t for i, t, *_ in rows if i == r.doc_id and r.size == f"x{i}"]
        assert r.text in [None if t is None else want[(r.doc_id, t)] for t in original]
        assert r.n_chars == (None if r.text is None else len(r.text))
    total = {r.doc_id: (r.line_total, r.line_removed) for r in out}
    assert total[2] == (0, 0) and total[14] == (5, 4) and total[11] == (14, 12)


def test_hot_window_keeps_the_first_document(spark):
    passage = "one line\ntwo line\nthree line"
    rows = [(k, f"start {k}\n{passage}\nend {k}", "en", "s") for k in range(300)]
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(table(spark, rows)).collect()}
    assert got[0] == rows[0][1]
    assert all(got[k] == f"start {k}\nend {k}" for k in range(1, 300))


def test_targets_fill_up_to_the_limit(spark):
    rows = awkward() + [(1000 + k, "w " * (10 + k % 7), "en", f"z{k % 9}") for k in range(400)]
    got = mixing.mix_plan(table(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(SPACE, t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, list(names)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.remove(s)
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[r.source]
        assert math.floor(r.rate) <= r.copies <= min(3, math.ceil(r.rate))
    again = mixing.mix_plan(table(spark, rows)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixed_rows_follow_the_plan(spark):
    docs = table(spark, [(k, "w " * 20, "en", f"s{k % 4}") for k in range(200)])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(times.get(r.doc_id, 0) == r.copies for r in mixing.mix_plan(docs).collect())


def test_counts_replace_clashing_columns(spark):
    """An input column named like a count: the operator gives the count, the pipeline's stage keeps the column."""
    import corpus_pipeline

    passage = "\n".join(prose(60 + k, 8) for k in range(4))
    docs = table(spark, [(1, passage, "en", "s"), (2, f"intro\n{passage}", "en", "s"), (3, None, "en", "s")], extra=())
    docs = docs.selectExpr("*", "-7L AS line_total", "-8L AS line_removed")
    got = {r.doc_id: (r.line_total, r.line_removed) for r in lines.drop_repeated_lines(docs).collect()}
    assert got == {1: (4, 0), 2: (5, 4), 3: (0, 0)}
    stage = corpus_pipeline.line_dedup(spark, docs, "")
    assert stage.columns == docs.columns and {(r.line_total, r.line_removed) for r in stage.collect()} == {(-7, -8)}
