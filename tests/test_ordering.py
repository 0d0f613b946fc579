"""Positions, ranks and quantiles against plain computations on skewed, tied data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reactrix.functions import ordering as O
from reactrix.functions import stats as ST


@pytest.fixture(scope="module", autouse=True)
def many_partitions(spark):
    """Small data would be coalesced to one partition and never cross an edge."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    # One group holds most rows and a third of all rows share one value.
    return [(i, "hot" if i % 10 else "rare", 0.0 if i % 3 == 0 else float(rng.integers(0, 40)), int(rng.integers(0, 4))) for i in range(4000)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, g string, v double, w long").repartition(16)


def test_ranges_cover_several_partitions(frame):
    laid = O.range_layout(frame, ["g", "v", "item_id"])
    assert laid.select("_pid").distinct().count() > 4
    spans = laid.groupBy("g").agg(F.countDistinct("_pid").alias("k")).filter("k > 1").count()
    runs = laid.groupBy("g", "v").agg(F.countDistinct("_pid").alias("k")).filter("k > 1").count()
    assert spans and runs  # a group and a run of equal values continue across partition edges
    assert sorted(r[0] for r in laid.select("_pos").collect()) == list(range(4000))


def test_positions_ties_and_weights(frame, rows):
    got = {r["item_id"]: r for r in O.positions(frame, ["g"], ["v", "item_id"], ties=["v"], weights=["w"]).collect()}
    for g in ("hot", "rare"):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        values = [r[2] for r in mine]
        running = 0
        for pos, (i, _, v, w) in enumerate(mine):
            first = values.index(v)
            assert got[i]["pos"] == pos and got[i]["group_n"] == len(mine)
            assert got[i]["tie_first"] == first and got[i]["tie_last"] == first + values.count(v) - 1
            assert got[i]["w_before"] == running and got[i]["w_total"] == sum(r[3] for r in mine)
            assert got[i]["w_below"] == sum(r[3] for r in mine if r[2] < v)
            running += w


def test_global_positions(frame, rows):
    got = {r["item_id"]: r["pos"] for r in O.positions(frame, [], [F.desc("v"), "item_id"]).collect()}
    for pos, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0]))):
        assert got[r[0]] == pos


@pytest.mark.parametrize("method", ["linear", "upper"])
def test_quantiles(frame, rows, method):
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    got = {r["g"]: r for r in O.quantiles(frame, ["g"], {"v": "v"}, probs, method=method).collect()}
    for g in ("hot", "rare"):
        values = sorted(r[2] for r in rows if r[1] == g)
        for name, p in probs.items():
            want = np.quantile(values, p) if method == "linear" else values[min(int(p * len(values)), len(values) - 1)]
            assert got[g][f"{name}_v"] == pytest.approx(want)


def test_quantiles_skip_nulls_and_count_each_group(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 3.0), (4, "b", 7.0)], "item_id long, g string, v double")
    got = {r["g"]: (r["n"], r["m_v"]) for r in O.quantiles(df, ["g"], {"v": "v"}, {"m": 0.5}).collect()}
    assert got == {"a": (2, 2.0), "b": (1, 7.0)}


@pytest.fixture(scope="module")
def wide(spark):
    """60 000 values: a hot null-keyed group with a value held by a third, a normal group, a small group."""
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 10 < 7 else ("b" if i % 10 < 9 or i > 9000 else "few"), 0.0 if i % 3 == 0 else float(v))
            for i, v in enumerate(rng.normal(0, 5, 60000))]
    frame = spark.createDataFrame(rows, "item_id long, g string, v double").repartition(16).cache()
    yield frame, rows
    frame.unpersist()


PROBS = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p25b": 0.2504, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def check_wide(got, rows, method):
    for g in {r[1] for r in rows}:
        values = sorted(r[2] for r in rows if r[1] == g)
        assert got[g]["n"] == len(values)
        for name, p in PROBS.items():
            want = np.quantile(values, p) if method == "linear" else values[min(int(p * len(values)), len(values) - 1)]
            assert got[g][f"{name}_v"] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("method", ["linear", "upper"])
def test_bracketed_quantiles(wide, method):
    frame, rows = wide
    got = {r["g"]: r for r in O.quantiles(frame, ["g"], {"v": "v"}, PROBS, method=method).collect()}
    check_wide(got, rows, method)


def test_only_rows_inside_brackets_are_sorted(wide, monkeypatch):
    frame, rows = wide
    sizes = []
    plain = O.range_layout
    monkeypatch.setattr(O, "range_layout", lambda df, *a, **k: (sizes.append(df.count()), plain(df, *a, **k))[1])
    got = O.quantiles(frame, [], {"v": "v"}, {"m": 0.5, "t": 0.9}).first()
    assert len(sizes) == 1 and sizes[0] < 600  # of 60 000 values
    values = [r[2] for r in rows]
    assert (got["n"], got["m_v"], got["t_v"]) == (60000, pytest.approx(np.median(values)), pytest.approx(np.quantile(values, 0.9)))


def test_missed_brackets_are_repeated_whole(spark, wide, monkeypatch):
    """A sketch that points at the wrong place costs a second pass, never a wrong quantile."""
    frame, rows = wide
    plain = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, cuts, accuracy: plain(c, [min(1.0, x + 0.3) for x in cuts], accuracy))
    got = {r["g"]: r for r in O.quantiles(frame, ["g"], {"v": "v"}, PROBS).collect()}
    check_wide(got, rows, "linear")


def test_quantiles_of_nothing_and_of_nan(spark):
    empty = spark.createDataFrame([], "item_id long, g string, v double")
    assert O.quantiles(empty, [], {"v": "v"}, {"m": 0.5}).first().asDict() == {"n": None, "m_v": None}
    assert O.quantiles(empty, ["g"], {"v": "v"}, {"m": 0.5}).count() == 0
    nan = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, float("nan"))], "item_id long, v double")
    assert O.quantiles(nan, [], {"v": "v"}, {"m": 0.5}).first()["m_v"] == 2.0


def test_midrank_and_rank_sum(spark):
    x, y = [3.0, 4.0, 4.0, 6.0, 9.0, 9.0], [1.0, 2.0, 4.0, 5.0, 5.0, 2.0, 9.0]
    rows = [(i, v, True) for i, v in enumerate(x)] + [(100 + i, v, False) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "item_id long, v double, is_x boolean")
    pool = sorted(x + y)
    rank = {v: np.mean([i + 1 for i, p in enumerate(pool) if p == v]) for v in pool}
    ranked = O.midranks(df, [], "v", "item_id").collect()
    assert all(r["midrank"] == pytest.approx(rank[r["v"]]) for r in ranked)
    n1, n2 = len(x), len(y)
    u = sum(rank[v] for v in x) - n1 * (n1 + 1) / 2
    z = (u - n1 * n2 / 2) / np.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    got = ST.rank_sum(df, [], "v", "is_x").first()
    assert got["z"] == pytest.approx(z) and 0 < got["p_greater"] < 1
    assert ST.rank_sum(df.filter("item_id > 2"), [], "v", "is_x").first()["z"] is None


def test_erfc(spark):
    from math import erfc
    for v in (-2.0, -0.3, 0.0, 0.7, 3.1):
        assert spark.range(1).select(ST.erfc(F.lit(v))).first()[0] == pytest.approx(erfc(v), abs=2e-7)
