"""Literal cases of the score, tier, title and review rules."""

import pytest
from pyspark.sql import functions as F

from reactrix import params as P
from reactrix.functions import scores as S
from reactrix.functions import titles as T
from reactrix.operators import rules as R
from reactrix.operators.percentiles import band_percentiles


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col).first()[0]


def test_score_and_baseline(spark):
    got = spark.createDataFrame([(1_000_000, 50_000, 20_000, 30_000)], "view long, like_cnt long, coin long, fav long").select(S.f7()).first()[0]
    assert got == pytest.approx(0.145)
    for lv, want in ((5.0, 0.1057), (4.0, 0.2065), (7.9, 0.0863), (5.95, (0.0616 + 0.0664) / 2), (4.5, 0.2065), (7.2, 0.0863)):
        assert one(spark, S.baseline("lv"), lv=lv) == pytest.approx(want)


@pytest.mark.parametrize("view,index,tier", [(2999, 9.0, "unproven"), (3000, 3.0, "high"), (3000, 2.0, "good"), (3000, 1.0, "normal"), (3000, 0.5, "low"), (3000, 0.49, "junk")])
def test_relative_tier(spark, view, index, tier):
    assert one(spark, S.relative_tier("i", "v"), i=index, v=view) == tier


def test_orientation(spark):
    df = spark.createDataFrame([(1080, 1920, 0), (1080, 1920, 90), (0, 1920, 0)], "width int, height int, rotate int")
    assert [r[0] for r in df.select(S.portrait()).collect()] == [True, False, None]


@pytest.mark.parametrize("pct,dur,tier", [(0.99, 20, "plain"), (0.99, 60, "fine"), (0.87, 120, "fine"), (0.99, 150, "fine"), (0.99, 151, "top"), (0.5, 300, "poor"), (None, 300, "none")])
def test_percentile_tiers(spark, pct, dur, tier):
    df = spark.createDataFrame([(pct, dur, 0.05, 0.05, 0.05, "x")], "pct double, duration long, fav_rate double, coin_rate double, like_rate double, title string")
    assert R.percentile_tier(df, P.TierRules()).first()["ptier"] == tier


def test_sympathy_lowers_and_silences_support(spark):
    row = (0.99, 600, 0.02, 0.09, 0.05, "众筹 手术")
    df = spark.createDataFrame([row], "pct double, duration long, fav_rate double, coin_rate double, like_rate double, title string")
    got = R.percentile_tier(df, P.TierRules()).first()
    assert got["ptier"] == "fine" and got["fired"] == ["R10 strong:众筹"]
    calm = R.percentile_tier(df.withColumn("title", F.lit("山")), P.TierRules()).first()
    assert calm["ptier"] == "top" and calm["fired"] == ["R9"]
    hit, note = R.sympathy("t", P.SYMPATHY_STRONG, P.SYMPATHY_WEAK)
    df = spark.createDataFrame([("感谢",), ("感谢妈妈",), ("plain",)], "t string")
    assert [tuple(r) for r in df.select(hit, note).collect()] == [(False, None), (True, "weak:感谢/妈妈"), (False, None)]


@pytest.mark.parametrize("title,flag", [
    ("第3集 山", "series"), ("第十二话", "series"), ("s02e05", "series"), ("更新至 12", "series"), ("Ｓ０１Ｅ０２", "series"),
    ("回望2024", None), ("20240229 散步", None), ("20230229 散步", "number_review"), ("耗时300天", None), ("音乐 123", "number_review"),
    ("风景 07", "number_review"), ("07 风景", None), ("3.14159", None), ("１２３４５", "number_review"), ("1080p", None), ("plain", None)])
def test_title_numbers(spark, title, flag):
    assert spark.createDataFrame([(title,)], "t string").select(T.number_flag(T.folded("t"))).first()[0] == flag


def test_band_percentile_counts_strictly_below(spark):
    rows = [(i, True, v, 5000, 1) for i, v in enumerate([1.0, 2.0, 2.0, 3.0])] + [(10, False, 2.0, 5000, 1), (11, False, 9.0, 5000, 1), (12, False, float("nan"), 5000, 1), (13, False, 2.0, 2000, 1)]
    rows += [(20, True, 1.0, 5000, 2), (21, True, 2.0, 5000, 2), (22, False, 2.0, 5000, 2)]
    df = spark.createDataFrame(rows, "item_id long, ref boolean, coin_rate double, view long, band long")
    got = {r["item_id"]: r["pct"] for r in band_percentiles(df, F.col("ref")).collect()}
    assert got[10] == 0.25 and got[11] == 1.0 and got[12] is None and got[13] is None and got[22] is None


def test_feed_cascade_order_and_client_options(spark):
    schema = "title string, category string, duration long, width int, height int, rotate int, view long, f7 double, cbi double"
    rows = [("x", "", 60, 1080, 1920, 0, 900, 0.01, 0.1), ("x", "", 600, 1080, 1920, 0, 900, 0.01, 0.1), ("x", "", 600, 1920, 1080, 0, 60_000, 0.01, 0.1),
            ("x", "电影", 600, 1920, 1080, 0, 60_000, 0.01, 0.1), ("x", "", 600, 1920, 1080, 0, 60_000, 0.04, 0.6), ("第3集", "", 600, 1920, 1080, 0, 60_000, 0.2, 2.0)]
    df = spark.createDataFrame(rows, schema)
    client = [r["reasons"] for r in R.feed_verdict(df, P.FeedRules()).collect()]
    assert client == [["short"], ["portrait", "low_views"], ["index"], [], [], ["signature"]]
    offline = [r["reasons"] for r in R.feed_verdict(df, P.FeedRules(low_view_suppresses_tier=False, index_pass_exempts=False)).collect()]
    assert offline[4] == ["tier"]
    assert R.feed_verdict(df, P.FeedRules(hide_unproven=True)).collect()[1]["reasons"] == ["portrait", "low_views"]


@pytest.mark.parametrize("payload,problem,status", [
    ('{"schema":"s","craft":2,"resonance":3,"reason":"craft_expression","watched":true,"evidence":"seen","status":"x"}', None, "confirmed"),
    ('{"schema":"s","craft":1,"resonance":3,"reason":"craft_expression","watched":true,"evidence":"seen"}', None, "not_fit"),
    ('{"schema":"s","craft":2,"resonance":null,"reason":"other","watched":true,"evidence":"seen"}', None, "incomplete"),
    ('{"schema":"s","craft":2,"resonance":2,"reason":"other","watched":false,"evidence":"seen"}', None, "unreviewed"),
    ('{"schema":"s","craft":true,"resonance":2}', "craft", None), ('{"schema":"s","craft":4}', "craft", None), ('{"schema":"s","craft":1.0}', "craft", None),
    ('{"schema":"s","reason":"whim"}', "reason", None), ('{"schema":"s","watched":1}', "watched", None), ('{"schema":"s","evidence":5}', "evidence", None), ('{"schema":"old"}', "schema", None)])
def test_reviews(spark, payload, problem, status):
    row = R.validated_reviews(spark.createDataFrame([(payload,)], "p string"), "p", "s").withColumn("status", R.review_status()).first()
    assert row["problem"] == problem
    if problem is None:
        assert row["status"] == status


def test_categories_verdicts_and_approval(spark):
    df = spark.createDataFrame([("科学馆", "猫"), ("", "猫和钢琴"), ("", "x")], "zone string, title string")
    cat, src = R.category("zone", "title", ((("知识", "科学"), "知识科普"),), (("动物萌宠", ("猫",)), ("音乐", ("钢琴",))))
    assert [tuple(r) for r in df.select(cat, src).collect()] == [("知识科普", "zone"), ("动物萌宠", "keyword"), ("other", "keyword")]
    df = spark.createDataFrame([(1, "神作"), (2, "不可能神作，优秀"), (3, "教程"), (4, "低创神作"), (5, "嗯"), (6, "神作但辛苦")], "i int, v string")
    assert [r[0] for r in df.select(R.verdict_group("v")).collect()] == ["top", "fine", "utility", "reject", "unclear", "top"]
    assert [r[0] for r in df.select(R.approved_positive("v", "i")).collect()] == [True, False, False, True, False, False]


def test_topics_are_a_parameter(spark):
    from reactrix.functions import titles as T

    df = spark.createDataFrame([("ＢＬＵＥ  Archive 1",), ("blue eth",), ("a b",), (None,)], "t string")
    got = [tuple(r) for r in df.select(R.topic_named(T.folded("t")), R.topic_named(T.folded("t"), ("a b", "eth$")), R.topic_named(T.folded("t"), ())).collect()]
    assert got == [(True, False, False), (False, True, False), (False, True, False), (False, False, False)]


def test_requests_count_hops_that_reach_nothing(spark):
    from reactrix.operators import graph as G

    policy = G.POLICIES[0].name
    rows = [(policy, 1, 1, 10, "top", True), (policy, 1, 1, 11, "top", True), (policy, 1, 1, 12, "fine", False), (policy, 2, 1, 20, "fine", False)]
    walk = spark.createDataFrame([(*r[:5], True, 1, r[5]) for r in rows], "policy string, seed long, hop long, item_id long, ptier string, in_pool boolean, spent long, chosen boolean")
    got = G.hop_requests(walk)
    assert sorted(tuple(r) for r in got.collect()) == [(policy, 1, 1, 1, 2), (policy, 1, 2, 2, 0), (policy, 2, 1, 1, 0)]
    assert [tuple(r) for r in G.hop_efficiency(got).orderBy("hop").collect()] == [(policy, 1, 2, 2, 1.0), (policy, 2, 2, 0, 0.0)]
    assert [(r["seed"], r["finds"], r["requests"]) for r in G.best_flows(got).collect()] == [(1, 2, 3), (2, 0, 1)]
