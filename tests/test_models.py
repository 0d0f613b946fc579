"""Matching, depth, walks and picks against brute force on small fixtures."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reactrix.operators import depth as D
from reactrix.operators import graph as G
from reactrix.operators import matching as M
from reactrix.operators import sampling as SM
from reactrix.session import shared_dir
from reactrix.sources import views

SMALL = "/root/testdata/sf0.001"


def test_greedy_match_equals_serving_one_by_one(spark):
    rng = np.random.default_rng(3)
    links = [(f, int(c), float(rng.integers(1, 6))) for f in range(40) for c in rng.choice(np.arange(100, 130), rng.integers(1, 8), replace=False)]
    by_focal = {}
    for f, c, d in links:
        by_focal.setdefault(f, []).append((d, c))
    want, used = {}, set()
    for _, _, f in sorted((len(v), min(v)[0], f) for f, v in by_focal.items()):
        for d, c in sorted(by_focal[f]):
            if c not in used:
                used.add(c)
                want[f] = c
                break
    got = {r["focal"]: r["control"] for r in M.greedy_match(spark.createDataFrame(links, "focal long, control long, dist double")).collect()}
    assert got == want


def test_candidates_respect_calipers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "g", bool(i % 5 == 0), *map(float, rng.uniform(0, 2, 3))) for i in range(150)]
    df = spark.createDataFrame(rows, "item_id long, grp string, is_focal boolean, a double, b double, c double")
    limits = (0.35, 0.6, 0.45)
    got = {(r["focal"], r["control"]) for r in M.candidates(df, ["grp"], ["a", "b", "c"], limits).collect()}
    want = {(f[0], k[0]) for f in rows if f[2] for k in rows if not k[2] and all(abs(f[3 + j] - k[3 + j]) / limits[j] <= 1 for j in range(3))}
    assert got == want


@pytest.mark.parametrize("block", [3, 500_000])
def test_nearest_candidates_match_the_listed_pairs(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, "gh"[i % 2], bool(i % 3 == 0), *map(float, np.round(rng.uniform(0, 2, 3), 1))) for i in range(150)]  # ties
    rows += [(200, "g", True, 1.0, None, 1.0), (201, None, False, 1.0, 1.0, 1.0), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "item_id long, grp string, is_focal boolean, a double, b double, c double")
    how = (["grp"], ["a", "b", "c"], (0.35, 0.6, 0.45))
    listed = M.candidates(df, *how)
    got = M.candidates(df, *how, nearest=2, block=block)
    assert {(r["focal"], r["n"], r["near"]) for r in got.collect()} == {
        tuple(r) for r in listed.groupBy("focal").agg(F.count("*"), F.min("dist")).collect()}
    by = {}
    for r in listed.collect():
        by.setdefault(r["focal"], []).append((r["dist"], r["control"]))
    assert {r["focal"]: [tuple(x) for x in r["links"]] for r in got.collect()} == {f: sorted(v)[:2] for f, v in by.items()}

    asked = []

    def further(short, k):
        asked.append(k)
        return M.candidates(df.filter("not is_focal").unionByName(df.filter("is_focal").join(short.select(F.col("focal").alias("item_id")).distinct(), "item_id", "left_semi")), *how, nearest=k)

    matched = {tuple(r) for r in M.greedy_match(got, ["grp"], further, 2).collect()}
    used, want, turns = set(), set(), {}
    for _, _, f in sorted((len(v), min(v)[0], f) for f, v in by.items()):
        turns[f % 2] = turns.get(f % 2, 0) + 1
        for d, c in sorted(by[f])[:turns[f % 2]]:  # a link listed twice counts twice
            if c not in used:
                used.add(c)
                want.add((f, c, d))
                break
    assert matched == want and asked


def test_paired_effect(spark):
    rng = np.random.default_rng(2)
    pairs = [("r", i, i // 3, float(v)) for i, v in enumerate(rng.normal(1, 2, 60))]
    got = M.paired_effect(spark.createDataFrame(pairs, "rule string, focal long, creator long, diff double"), ["rule"], "diff", "creator", replicates=200).first()
    assert got["estimate"] == pytest.approx(np.median([p[3] for p in pairs])) and got["creators"] == 20
    assert got["lo"] <= got["estimate"] <= got["hi"]
    few = M.paired_effect(spark.createDataFrame(pairs[:9], "rule string, focal long, creator long, diff double"), ["rule"], "diff", "creator", replicates=50).first()
    assert few["lo"] is None and few["creators"] == 3


def test_depth_equals_numpy(spark):
    rng = np.random.default_rng(9)
    n, d = 60, 5
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    f7 = rng.uniform(size=n)
    rows = [(i, "cell", float(f7[i]), *map(float, x[i])) for i in range(n)] + [(1000 + i, "thin", 1.0, 0.0, 1.0, 2.0, 3.0, 4.0) for i in range(10)]
    df = spark.createDataFrame(rows, "item_id long, cell string, f7 double, " + ", ".join(f"x{i} double" for i in range(d)))
    got = {r["item_id"]: r for r in D.directional_depth(df, ["cell"], [f"x{i}" for i in range(d)]).collect()}
    assert set(got) == set(range(n))  # a thin neighbourhood gives nothing
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(c.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = max(2, int(np.searchsorted(np.cumsum(values) / values.sum(), 0.85)) + 1)
    p = vectors[:, :k] @ vectors[:, :k].T
    moved = D.directions(d) @ p
    norm = np.linalg.norm(moved, axis=1)
    keep = np.flatnonzero(norm > 0.3)
    proj = c @ (moved[keep] / norm[keep, None]).T
    for i in range(n):
        depths = [(np.sum(np.delete(proj[:, j], i) < proj[i, j]) + 1) / n for j in range(len(keep))]
        best = int(np.argmax(depths))
        want = None if f7[i] < np.median(f7) else (depths[best] if proj[i, best] > 0 else 0.0)
        assert got[i]["depth"] == (None if want is None else pytest.approx(want))
        assert got[i]["orth"] == pytest.approx(np.linalg.norm(c[i] - p @ c[i]))


def test_depth_is_the_same_spread_or_whole(spark):
    rng = np.random.default_rng(12)
    x, f7 = np.round(rng.normal(size=(90, 5)), 1), rng.uniform(size=80)  # ties
    rows = [(i % 80, "ab"[i % 2], float(f7[i % 80]), *[None if i in (40, 41) and j == 2 else float(v) for j, v in enumerate(x[i])]) for i in range(90)]
    df = spark.createDataFrame(rows, "item_id long, cell string, f7 double, " + ", ".join(f"x{i} double" for i in range(5))).coalesce(1)
    xs = [f"x{i}" for i in range(5)]

    def run(**how):
        return {r["item_id"]: (r["depth"], r["dir"]) for r in D.directional_depth(df.filter("x2 is not null"), ["cell"], xs, **how).collect()}

    whole, before = run(), {p.name for p in Path(shared_dir(spark)).iterdir()}
    assert whole == run(whole=10, block=3) and len(whole) == 78  # a repeated id keeps its best row
    after = {p.name for p in Path(shared_dir(spark)).iterdir()} - before
    assert sum(n.startswith("best") for n in after) == 1  # each block's table replaces the one before
    empty = D.directional_depth(df, ["cell"], xs).filter("item_id in (40, 41)").collect()
    assert all(r["orth"] is None and r["depth"] in (None, 0.0) for r in empty)


def test_stage_leaves_no_shuffle_files(spark):
    from reactrix.session import stage

    local = Path(spark.sparkContext.getConf().get("spark.local.dir", "/tmp"))

    def files():
        return set(local.glob("blockmgr-*/*/shuffle_*.data")) | set(local.glob("spark-*/blockmgr-*/*/shuffle_*.data"))

    old = files()
    staged = stage(spark.range(1000).repartition(7), "t")
    wait = time.monotonic() + 20
    while files() - old and time.monotonic() < wait:
        time.sleep(0.2)
    assert not files() - old
    assert staged.count() == 1000  # has a shuffle of its own


@pytest.mark.parametrize("name", ["formula_grid", "boost_sensitivity"])
def test_orders_are_deleted_once_read(spark, name):
    """No order with a row per formula, direction or compared measure stays; the ranks that formula rows carry do."""
    folder = Path(shared_dir(spark))
    views.scored(spark, SMALL)
    before = {p.name for p in folder.iterdir()}
    assert entry.queries()[name](spark, SMALL).count()
    new = [p for p in folder.iterdir() if p.name not in before and p.name.startswith("ordered-")]
    long = [p for p in new if {"subset", "dir", "m"} & set(spark.read.parquet(str(p)).columns)]
    assert len(long) == (name == "formula_grid")


def test_walk_visits_once_and_stops(spark):
    edges = spark.createDataFrame([(a, b, 1) for a in range(12) for b in range(12) if a != b and (b - a) % 12 <= 3], "src long, dst long, pos int")
    nodes = spark.createDataFrame([(i, "top" if i % 2 else "fine", i / 12, "1999-01-01") for i in range(12)], "item_id long, ptier string, pct double, d string").withColumn("pub_ts", F.col("d").cast("timestamp"))
    walk = G.frontier_expansion(spark.createDataFrame([(0,)], "item_id long"), edges, nodes)
    assert walk.count() == walk.select("policy", "seed", "item_id").distinct().count()
    assert walk.filter("item_id = 0").count() == 0
    status = {r["policy"]: (r["depth"], r["status"]) for r in G.walk_status(walk).collect()}
    assert status["A"] == (1, "dry") and set(status) == {p.name for p in G.POLICIES}
    assert status["E"][1] == "pruned" and status["E"][0] > 1


def test_greedy_picks_equal_a_full_walk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 6)), f"f{rng.integers(0, 3)}", int(rng.integers(0, 3)), float(rng.uniform())) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id long, owner_id long, form string, a long, b double")
    owners, forms, want = set(), {}, []
    for i, o, f, a, b in sorted(rows, key=lambda r: (r[3], r[4], r[0])):
        if o not in owners and forms.get(f, 0) < 2 and len(want) < 5:
            owners.add(o)
            forms[f] = forms.get(f, 0) + 1
            want.append(i)
    got = [r["item_id"] for r in SM.greedy_picks(df, ["a", "b"]).orderBy("slot").collect()]
    assert got == want


def test_walk_budget(spark):
    edges = spark.createDataFrame([(a, a + b, b) for a in range(60) for b in (1, 2, 3)], "src long, dst long, pos int")
    nodes = spark.createDataFrame([(i, "top", 0.95, "1999-01-01") for i in range(70)], "item_id long, ptier string, pct double, d string").withColumn("pub_ts", F.col("d").cast("timestamp"))
    only = [p for p in G.POLICIES if p.name == "C"]
    seeds = spark.createDataFrame([(0,)], "item_id long")
    walk = G.frontier_expansion(seeds, edges, nodes, only, budget=5)
    row = G.walk_status(walk, only, budget=5).first()
    assert row["status"] == "censored_budget" and row["depth"] == 3
