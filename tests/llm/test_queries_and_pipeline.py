"""Registered document queries against DuckDB, and the pipeline's stages one after the other."""

import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from reactrix.llm.queries import ORACLES, QUERIES

from .brute import line_dedup, near_components, prose, table

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    from tools.parity import compare, connect

    df = QUERIES[name](spark, SMALL)
    assert compare(df.collect(), df.columns, connect(SMALL).sql(ORACLES[name])) is None


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_models_hold_out(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name, mod, rest in (("op6_toxicity", 5, 0), ("op7_language_spans", 3, 1)):
        rows = QUERIES[name](spark, SMALL).collect()
        assert len(rows) == n
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)


def test_stages_in_turn(spark, tmp_path):
    passage = "\n".join(prose(900 + k, 20) for k in range(4))
    rows = []
    for k in range(60):
        rows.append((k, prose(k, 60) + "\n" + prose(500 + k, 40), "en", f"s{k % 4}"))
    rows += [(100 + k, f"{prose(700 + k, 30)}\n{passage}\n{prose(800 + k, 30)}", "en", "s1") for k in range(5)]
    rows += [(200 + k, rows[0][1] + (" more" if k else ""), "en", "s2") for k in range(3)]
    rows += [(300, "12 34 ---", "en", "s0"), (301, None, "en", "s0"), (302, "", "en", "s0")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), table(spark, []).columns
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    identified = {r.doc_id for r in seen["language_id"]}
    assert identified == {r[0] for r in rows} - {300, 301, 302}
    want = line_dedup([r for r in rows if r[0] in identified])
    texts = {r[0]: r[1] for r in rows}
    got = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert got == {i: want[(i, texts[i])] for i in identified}
    component, _ = near_components(list(got.items()))
    assert {r.doc_id for r in seen["near_dedup"]} == {i for i, c in component.items() if i == c}
    assert {r.doc_id for r in seen["source_mixing"]} <= {r.doc_id for r in seen["near_dedup"]}
    times = Counter(r.doc_id for r in seen["source_mixing"])
    assert max(times.values()) <= 3 and {r.doc_id: r.text for r in seen["source_mixing"]}.items() <= got.items()
    placed = Counter(r.doc_id for r in seen["best_fit_packing"] if r.piece == 0)
    assert placed == times
    sequences = {}
    for r in seen["best_fit_packing"]:
        sequences.setdefault(r.sequence_id, []).append((r.offset, bytes(r.ids)))
    for parts in sequences.values():  # the ids of a sequence lie gapless and within the capacity
        end = 0
        for offset, ids in sorted(parts):
            assert offset == end
            end += len(ids) // 4
        assert end <= 2048


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stages_on_empty_repeated_and_long_rows(spark, name, step):
    none = table(spark, [])
    out = step(spark, none, "")
    assert out.count() == 0 and (out.columns == none.columns or name == "best_fit_packing")
    text = prose(77, 20_000)
    rows = [(1, text, "en", "s1"), (2, "short words only here", "en", "s1"), (2, "short words only here", "en", "s1"), (3, None, None, None)]
    rows += [(10 + k, prose(k, 50), "en", "s1") for k in range(12)]
    got = step(spark, table(spark, rows), "").collect()
    assert {r.doc_id for r in got} >= ({1} | set(range(10, 22)) if name != "source_mixing" else {1})
    if name not in ("source_mixing", "best_fit_packing"):
        assert sum(r.doc_id == 2 for r in got) in (0, 2) and next(r for r in got if r.doc_id == 1).text == text


def test_run_is_the_stages_in_turn(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
