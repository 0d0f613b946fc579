"""Grouped summaries over the scored items and their collectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import scores as S
from ..operators import aggregates as A
from ..operators import rules as R
from ..params import DRAFT_RULES, DRIVER, NEIGHBOUR_WIDTH
from ..sources import views as V
from .projections import FORM_SQL, FORMS, PORTRAIT_SQL, SIG, TIERS, likes, ptier_sql, verdicts
from .registry import query, shared_sql

HIGH, GOOD = "tier = 'high'", "tier IN ('high', 'good')"
RATE_SQL = f"""count(*) AS n, count(*) FILTER ({HIGH}) AS high, round(avg(CASE WHEN {HIGH} THEN 1e0 ELSE 0e0 END), 6) AS high_rate,
  count(*) FILTER ({GOOD}) AS good, round(avg(CASE WHEN {GOOD} THEN 1e0 ELSE 0e0 END), 6) AS good_rate, round(avg(cbi), 6) AS mean_index"""
HOT = ("AUTOMOBILE", "BUILDING")
HOT_SQL = "source IN ('AUTOMOBILE', 'BUILDING')"


def med(expr, name, p="0.5e0"):
    return f"round(quantile_cont({expr}::DOUBLE, {p}), 6) AS {name}"


def upper(expr, name, p="0.5e0", cond=""):
    """Sorted value at index floor(p*n)."""
    return f"round(list_sort(list({expr}::DOUBLE))[CAST(least(floor({p} * count(*)), count(*) - 1) AS INT) + 1], 6) AS {name}"


@query("score_quantiles", ["scored"], "SELECT " + ", ".join(med("f7", f"p{p}", f"{p / 100}e0") for p in (5, 10, 25, 50, 75, 80, 90, 95)) + ", round(avg(f7), 6) AS mean FROM scored")
def score_quantiles(spark, sf):
    df = V.scored(spark, sf)
    ps = (5, 10, 25, 50, 75, 80, 90, 95)
    q = O.quantiles(df, [], {"f7": "f7"}, {f"p{p}": p / 100 for p in ps})
    return q.select(*[F.col(f"p{p}_f7").alias(f"p{p}") for p in ps], df.agg(F.avg("f7").alias("m")).scalar().alias("mean"))


@query("overlapping_group_medians", ["scored"], f"""SELECT grp, count(*) AS n, {med('f7', 'med_f7')} FROM (
  SELECT CASE WHEN {PORTRAIT_SQL} THEN 'portrait' ELSE 'landscape' END AS grp, f7 FROM scored
  UNION ALL SELECT CASE WHEN duration <= 75 THEN 'short' ELSE 'long' END, f7 FROM scored) GROUP BY grp""")
def overlapping_group_medians(spark, sf):
    portrait = S.portrait()
    groups = F.array_compact(F.array(
        F.when(portrait, "portrait").when(~portrait, "landscape"), F.when(F.col("duration") <= 75, "short").otherwise("long")))
    df = V.scored(spark, sf).select("item_id", "f7", F.explode(groups).alias("grp"))
    return A.medians_by(df, ["grp"], ["f7"])


@query("suggest_thresholds", ["scored"], f"""SELECT {med('f7', 'high', '0.8e0')}, {med('f7', 'normal')}, {med('f7', 'low', '0.25e0')},
  (SELECT round(corr(f7, lv), 6) FROM scored) AS corr_log_view FROM scored WHERE source = 'FURNITURE'""")
def suggest_thresholds(spark, sf):
    return A.suggest_thresholds(V.scored(spark, sf), F.col("source") == "FURNITURE")


@query("tier_and_reason_counts", ["verdicts"], """
SELECT 'tier' AS section, t AS label, count(verdicts.item_id) AS n, NULL::DOUBLE AS ratio FROM (SELECT unnest(['high', 'normal', 'low', 'junk', 'unproven']) AS t)
  LEFT JOIN verdicts ON coalesce(verdict_tier, 'high') = t GROUP BY t
UNION ALL SELECT 'reason', r, count(*), NULL FROM (SELECT unnest(string_split(reasons, ';')) AS r FROM verdicts WHERE reasons <> '') GROUP BY r
UNION ALL SELECT * FROM (SELECT 'highest', CAST(item_id AS VARCHAR), view, round(f7, 6) FROM verdicts ORDER BY f7 DESC, item_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'lowest', CAST(item_id AS VARCHAR), view, round(f7, 6) FROM verdicts ORDER BY f7, item_id LIMIT 10)""")
def tier_and_reason_counts(spark, sf):
    df = verdicts(spark, sf)
    none = F.lit(None).cast("double")
    order = ("high", "normal", "low", "junk", "unproven")
    counts = df.agg(*[F.count_if(F.coalesce("verdict_tier", F.lit("high")) == t).alias(t) for t in order])
    tiers = counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("label"), F.col(t).alias("n")) for t in order])).alias("x")).select(
        F.lit("tier").alias("section"), "x.label", "x.n", none.alias("ratio"))
    reasons = df.select(F.explode("reasons").alias("label")).groupBy("label").agg(F.count("*").alias("n")).select(
        F.lit("reason").alias("section"), "label", "n", none.alias("ratio"))
    tails = A.ends(df, "f7", 10).select(F.col("side").alias("section"), F.col("item_id").cast("string").alias("label"), F.col("view").alias("n"), F.col("f7").alias("ratio"))
    return tiers.unionByName(reasons).unionByName(tails)


VIEW_BANDS = ((1e3, 1e4, "1k-10k"), (1e4, 1e5, "10k-100k"), (1e5, 1e6, "100k-1M"), (1e6, 1e18, "1M+"))


@query("view_band_table", ["scored"], f"""SELECT band, count(*) AS n, {med('like_rate', 'med_like_rate')}, {med('coin_rate', 'med_coin_rate')}, {med('fav_rate', 'med_fav_rate')}, {med('f7', 'med_f7')},
  round(avg(CASE WHEN f7 < (SELECT quantile_cont(f7, 0.25e0) FROM scored) THEN 1e0 ELSE 0e0 END), 6) AS below_p25
  FROM (SELECT *, CASE WHEN view >= 1e6 THEN '1M+' WHEN view >= 1e5 THEN '100k-1M' WHEN view >= 1e4 THEN '10k-100k' WHEN view >= 1e3 THEN '1k-10k' END AS band FROM scored) GROUP BY band""")
def view_band_table(spark, sf):
    df = V.scored(spark, sf).withColumn("band", A.bands(F.col("view"), VIEW_BANDS)).filter("band is not null")
    p25 = O.quantiles(df, [], {"f7": "f7"}, {"p25": 0.25}).select("p25_f7").scalar()
    below = df.withColumn("below", F.col("f7") < p25).groupBy("band").agg(A.share(F.col("below")).alias("below_p25"))
    return A.medians_by(df, ["band"], ["like_rate", "coin_rate", "fav_rate", "f7"]).join(below, "band")


@query("hot_cold_and_gems", ["scored"], f"""
WITH_Q SELECT kind, item_id, view, round(f7, 6) AS f7, n FROM (
  SELECT *, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'cold' THEN -view ELSE -f7 END, item_id) AS rn
  FROM (SELECT item_id, view, f7, CASE WHEN {HOT_SQL} THEN 'cold' ELSE 'gem' END AS kind FROM scored
    WHERE ({HOT_SQL} AND view >= 500000 AND f7 < (SELECT quantile_cont(f7, 0.25e0) FROM scored))
       OR (NOT {HOT_SQL} AND f7 >= (SELECT quantile_cont(f7, 0.75e0) FROM scored)))) WHERE rn <= 10""".replace("WITH_Q ", ""))
def hot_cold_and_gems(spark, sf):
    df = V.scored(spark, sf)
    q = O.quantiles(df, [], {"f7": "f7"}, {"p25": 0.25, "p75": 0.75})
    p25, p75 = q.select("p25_f7").scalar(), q.select("p75_f7").scalar()
    hot = F.col("source").isin(*HOT)
    kind = F.when(hot & (F.col("view") >= 500_000) & (F.col("f7") < p25), "cold").when(~hot & (F.col("f7") >= p75), "gem")
    picked = df.select("item_id", "view", "f7", kind.alias("kind")).filter("kind is not null")
    order = F.when(F.col("kind") == "cold", -F.col("view").cast("double")).otherwise(-F.col("f7"))
    top = O.top_per_group(picked, ["kind"], [order, "item_id"], 10).drop("rn")
    return top.join(picked.groupBy("kind").agg(F.count("*").alias("n")), "kind")


@query("keyword_group_contrast", ["scored"], f"""
SELECT grp, count(*) AS n, {med('view', 'med_view')}, NULL::BIGINT AS item_id FROM (SELECT unnest(['all'] || CASE WHEN {HOT_SQL} THEN ['hot'] ELSE [] END
    || CASE WHEN regexp_matches(title, 'gizmo|widget') THEN ['keyword'] ELSE [] END) AS grp, view FROM scored) GROUP BY grp
UNION ALL SELECT * FROM (SELECT 'most_viewed', 1, view::DOUBLE, item_id FROM scored WHERE regexp_matches(title, 'gizmo|widget') ORDER BY view DESC, item_id LIMIT 15)""")
def keyword_group_contrast(spark, sf):
    df = V.scored(spark, sf)
    word = F.col("title").rlike("gizmo|widget")
    groups = F.array_compact(F.array(F.lit("all"), F.when(F.col("source").isin(*HOT), "hot"), F.when(word, "keyword")))
    meds = A.medians_by(df.select("item_id", "view", F.explode(groups).alias("grp")), ["grp"], ["view"]).withColumn("item_id", F.lit(None).cast("long"))
    top = df.filter(word).orderBy(F.desc("view"), "item_id").limit(15).select(
        F.lit("most_viewed").alias("grp"), F.lit(1).cast("long").alias("n"), F.col("view").cast("double").alias("med_view"), "item_id")
    return meds.unionByName(top)


ZONE_SQL = "category || '/' || source"


def zoned(spark, sf):
    return V.scored(spark, sf).withColumn("zone", F.concat("category", F.lit("/"), "source"))


@query("zone_profile", ["scored"], f"""SELECT {ZONE_SQL} AS zone, count(*) AS n, {med('coin_rate', 'med_coin_rate')}, {med('fav_rate', 'med_fav_rate')}, {med('like_rate', 'med_like_rate')},
  {med('danmaku_rate', 'med_danmaku_rate')}, {med('duration', 'med_duration')} FROM scored GROUP BY zone HAVING count(*) >= 8""")
def zone_profile(spark, sf):
    return A.medians_by(zoned(spark, sf), ["zone"], ["coin_rate", "fav_rate", "like_rate", "danmaku_rate", "duration"], min_n=8)


def mature(spark, sf):
    return V.scored(spark, sf).filter("view >= 3000")


@query("year_quality_matrix", ["scored"], f"SELECT year, {RATE_SQL} FROM scored WHERE view >= 3000 AND year IS NOT NULL GROUP BY year")
def year_quality_matrix(spark, sf):
    return A.rates_by(mature(spark, sf).filter("year is not null"), ["year"])


GROUP_SQL = "CASE WHEN source IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'mined' ELSE 'control' END"


def grouped(df):
    return df.withColumn("grp", F.when(F.col("source").isin("AUTOMOBILE", "BUILDING", "FURNITURE"), "mined").otherwise("control"))


@query("mined_vs_control", ["scored"], f"""SELECT {GROUP_SQL} AS grp, 'all' AS year, {RATE_SQL} FROM scored WHERE view >= 3000 GROUP BY ALL
  UNION ALL SELECT {GROUP_SQL}, CAST(year AS VARCHAR), {RATE_SQL} FROM scored WHERE view >= 3000 GROUP BY ALL""")
def mined_vs_control(spark, sf):
    df = grouped(mature(spark, sf)).select("grp", "tier", "cbi", F.explode(F.array(F.lit("all"), F.col("year").cast("string"))).alias("year"))
    return A.rates_by(df, ["grp", "year"])


SPLIT = f"epoch(TIMESTAMP '{DRIVER.capture_time}') - 5 * 365.25e0 * 86400"


@query("old_vs_new_split", ["scored"], f"SELECT CASE WHEN epoch(pub_ts) < {SPLIT} THEN 'old' ELSE 'new' END AS era, {RATE_SQL} FROM scored WHERE view >= 3000 GROUP BY era")
def old_vs_new_split(spark, sf):
    cutoff = F.unix_timestamp(F.lit(DRIVER.capture_time).cast("timestamp")) - 5 * 365.25 * 86400
    return A.rates_by(mature(spark, sf).withColumn("era", F.when(F.unix_timestamp("pub_ts") < cutoff, "old").otherwise("new")), ["era"])


shared_sql("edge_items", ["edges", "scored"], "SELECT edges.user_id, edges.arm, scored.* FROM edges JOIN scored USING (item_id)")


def edge_items(spark, sf):
    return A.user_frame(V.edges(spark, sf), V.scored(spark, sf))


@query("collector_consistency", ["edge_items"], f"""SELECT * FROM (SELECT user_id, {RATE_SQL} FROM edge_items GROUP BY user_id HAVING count(*) >= 5)
  ORDER BY good_rate DESC, n DESC, user_id LIMIT 15""")
def collector_consistency(spark, sf):
    return A.rates_by(edge_items(spark, sf), ["user_id"], 5).orderBy(F.desc(F.round("good_rate", 6)), F.desc("n"), "user_id").limit(15)


@query("stars_topk", ["scored"], "SELECT item_id, title, round(cbi, 6) AS cbi, view FROM scored WHERE tier = 'high' ORDER BY scored.cbi DESC, item_id LIMIT 20")
def stars_topk(spark, sf):
    return V.scored(spark, sf).filter(A.is_high()).orderBy(F.desc("cbi"), "item_id").limit(20).select("item_id", "title", "cbi", "view")


shared_sql("user_arm", ["edge_items"], f"SELECT arm, user_id, {RATE_SQL}, {upper('cbi', 'upper_index')} FROM edge_items WHERE view >= 3000 GROUP BY arm, user_id HAVING count(*) >= 5")


def user_arm(spark, sf):
    """Per (arm, user) rates and upper-median index of users with at least five items."""
    df = edge_items(spark, sf).filter("view >= 3000")
    mid = A.medians_by(df, ["arm", "user_id"], {"index": "cbi"}, 5, "upper", "upper").drop("n")
    return A.rates_by(df, ["arm", "user_id"], 5).join(mid, ["arm", "user_id"])


@query("user_rates_per_arm", ["user_arm"], "SELECT * FROM user_arm")
def user_rates_per_arm(spark, sf):
    return user_arm(spark, sf)


@query("arm_metric_means", ["user_arm"], """SELECT arm, count(*) AS users, round(avg(high * 1e0 / n), 6) AS high_rate, round(avg(good * 1e0 / n), 6) AS good_rate,
  round(avg(mean_index), 4) AS mean_index, round(avg(upper_index), 4) AS upper_index FROM user_arm GROUP BY arm""")
def arm_metric_means(spark, sf):
    return user_arm(spark, sf).groupBy("arm").agg(
        F.count("*").alias("users"), F.avg("high_rate").alias("high_rate"), F.avg("good_rate").alias("good_rate"),
        F.round(F.avg("mean_index"), 4).alias("mean_index"), F.round(F.avg("upper_index"), 4).alias("upper_index"))


BEHAVIOURS = ("coin", "fav", "like", "danmaku", "share")
PAIRS = [(a, b) for i, a in enumerate(BEHAVIOURS) for b in BEHAVIOURS[i + 1:]]


@query("yearly_behaviour_correlations", ["scored"], "SELECT year, count(*) AS n, " + ", ".join(
    f"round(corr(greatest({a}_rate, 1e-6), greatest({b}_rate, 1e-6)), 6) + 0e0 AS {a}_{b}" for a, b in PAIRS) + " FROM scored WHERE view >= 3000 GROUP BY year HAVING count(*) >= 80")
def yearly_behaviour_correlations(spark, sf):
    def floored(c):
        return F.greatest(F.col(f"{c}_rate"), F.lit(1e-6))
    return mature(spark, sf).groupBy("year").agg(F.count("*").alias("n"), *[F.corr(floored(a), floored(b)).alias(f"{a}_{b}") for a, b in PAIRS]).filter("n >= 80")


@query("yearly_morphology", ["scored"], f"""SELECT year, count(*) AS n, round(avg(cbi), 6) AS mean, round((avg(cbi*cbi*cbi) - 3 * avg(cbi) * avg(cbi*cbi) + 2 * avg(cbi)*avg(cbi)*avg(cbi)) / pow(var_pop(cbi), 1.5e0), 4) AS skew,
  {upper('cbi', 'p90', '0.9e0')}, round(avg(CASE WHEN {HIGH} THEN 1e0 ELSE 0e0 END), 6) AS high_rate FROM scored WHERE view >= 3000 GROUP BY year HAVING count(*) >= 80""")
def yearly_morphology(spark, sf):
    df = mature(spark, sf)
    p90 = O.quantiles(df, ["year"], {"cbi": "cbi"}, {"p90": 0.9}, method="upper").select("year", F.col("p90_cbi").alias("p90"))
    return df.groupBy("year").agg(
        F.count("*").alias("n"), F.avg("cbi").alias("mean"), F.round(F.when(F.count("*") >= 30, F.skewness("cbi")), 4).alias("skew"),
        A.share(A.is_high()).alias("high_rate")).filter("n >= 80").join(p90, "year")


RANGES = ((3e3, 3e6, "small"), (3e6, 3e7, "middle"), (3e7, 1e9, "large"))
RANGE_SQL = "CASE WHEN view >= 3e3 AND view < 3e6 THEN 'small' WHEN view >= 3e6 AND view < 3e7 THEN 'middle' WHEN view >= 3e7 AND view < 1e9 THEN 'large' END"


@query("survivorship_bands", ["scored"], f"""SELECT band, count(*) FILTER (g = 'mined') AS mined_n, count(*) FILTER (g = 'control') AS control_n,
  round(avg(cbi) FILTER (g = 'mined'), 6) AS mined_mean, round(avg(cbi) FILTER (g = 'control'), 6) AS control_mean,
  round(avg(CASE WHEN cbi >= 3 THEN 1e0 ELSE 0e0 END) FILTER (g = 'mined'), 6) AS mined_high, round(avg(CASE WHEN cbi >= 3 THEN 1e0 ELSE 0e0 END) FILTER (g = 'control'), 6) AS control_high,
  round(avg(cbi) FILTER (g = 'mined') - avg(cbi) FILTER (g = 'control'), 6) AS gap
  FROM (SELECT *, {GROUP_SQL} AS g, {RANGE_SQL} AS band FROM scored) WHERE band IS NOT NULL GROUP BY band HAVING count(*) FILTER (g = 'mined') >= 50 AND count(*) FILTER (g = 'control') >= 20""")
def survivorship_bands(spark, sf):
    def of(g, x):
        return F.when(F.col("grp") == g, x)
    top = (F.col("cbi") >= 3).cast("double")
    out = grouped(V.scored(spark, sf)).withColumn("band", A.bands(F.col("view"), RANGES)).filter("band is not null").groupBy("band").agg(
        *[F.count(of(g, F.lit(1))).alias(f"{g}_n") for g in ("mined", "control")], *[F.avg(of(g, F.col("cbi"))).alias(f"{g}_mean") for g in ("mined", "control")],
        *[F.avg(of(g, top)).alias(f"{g}_high") for g in ("mined", "control")])
    return out.filter("mined_n >= 50 and control_n >= 20").withColumn("gap", F.col("mined_mean") - F.col("control_mean"))


@query("archaeology_index", ["scored"], f"""SELECT zone, n, round(o, 6) AS old_high, round(w, 6) AS new_high, round(o / greatest(w, 0.02e0), 6) AS idx FROM (
  SELECT {ZONE_SQL} AS zone, count(*) AS n, avg(CASE WHEN {HIGH} THEN 1e0 ELSE 0e0 END) FILTER (year <= 1997) AS o, avg(CASE WHEN {HIGH} THEN 1e0 ELSE 0e0 END) FILTER (year > 1997) AS w
  FROM scored WHERE view >= 3000 GROUP BY zone HAVING count(*) >= 40 AND count(*) FILTER (year <= 1997) >= 15 AND count(*) FILTER (year > 1997) >= 15)
  ORDER BY round(o / greatest(w, 0.02e0), 6) DESC, zone LIMIT 10""")
def archaeology_index(spark, sf):
    old, top = F.col("year") <= 1997, A.is_high().cast("double")
    z = zoned(spark, sf).filter("view >= 3000").groupBy("zone").agg(
        F.count("*").alias("n"), F.count_if(old).alias("old_n"), F.avg(F.when(old, top)).alias("old_high"), F.avg(F.when(~old, top)).alias("new_high"))
    return z.filter("n >= 40 and old_n >= 15 and n - old_n >= 15").withColumn(
        "idx", F.round(F.col("old_high") / F.greatest("new_high", F.lit(0.02)), 6)).orderBy(F.desc("idx"), "zone").limit(10).drop("old_n")


@query("treasure_creators", ["scored"], f"""SELECT owner_id, count(*) AS n, count(*) FILTER ({HIGH}) AS high, round(count(*) FILTER ({HIGH}) * 1e0 / count(*), 6) AS high_rate
  FROM scored WHERE view >= 3000 GROUP BY owner_id HAVING count(*) >= 5 ORDER BY high DESC, n DESC, owner_id LIMIT 12""")
def treasure_creators(spark, sf):
    return A.rates_by(mature(spark, sf), ["owner_id"], 5).orderBy(F.desc("high"), F.desc("n"), "owner_id").limit(12).select("owner_id", "n", "high", "high_rate")


@query("aging_by_zone", ["scored"], f"""SELECT side, zone, n, r FROM (SELECT *, row_number() OVER (ORDER BY r, zone) AS a, row_number() OVER (ORDER BY r DESC, zone) AS d FROM (
  SELECT {ZONE_SQL} AS zone, count(*) AS n, round(corr(log10(age), cbi), 6) + 0e0 AS r FROM scored WHERE view >= 3000 GROUP BY zone HAVING count(*) >= 60)),
  (SELECT unnest(['lowest', 'highest']) AS side) WHERE (side = 'lowest' AND a <= 5) OR (side = 'highest' AND d <= 5)""")
def aging_by_zone(spark, sf):
    r = zoned(spark, sf).filter("view >= 3000").groupBy("zone").agg(F.count("*").alias("n"), F.round(F.corr(F.log10("age"), "cbi"), 6).alias("r")).filter("n >= 60")
    low = r.orderBy("r", "zone").limit(5).withColumn("side", F.lit("lowest"))
    return low.unionByName(r.orderBy(F.desc("r"), "zone").limit(5).withColumn("side", F.lit("highest")))


shared_sql("curve_rows", ["scored"], f"""SELECT 'all' AS scope, * FROM (SELECT *, CAST(round_even(lv / 0.25e0, 0) AS BIGINT) AS bucket FROM scored WHERE view >= 3000)
  UNION ALL SELECT CAST(year AS VARCHAR), * FROM (SELECT *, CAST(round_even(lv / 0.25e0, 0) AS BIGINT) AS bucket FROM scored WHERE view >= 3000)
  WHERE year IN (SELECT year FROM scored WHERE view >= 3000 GROUP BY year HAVING count(*) >= 30)""")
shared_sql("bucket_curve", ["curve_rows"], f"SELECT scope, bucket, count(*) AS n, {upper('f7', 'med_f7')} FROM curve_rows GROUP BY scope, bucket HAVING count(*) >= 6")


def curve_rows(spark, sf):
    """Each row under 'all' and, for years with 30 rows, under its year."""
    df = mature(spark, sf).withColumn("bucket", S.band("lv", NEIGHBOUR_WIDTH))
    years = df.groupBy("year").agg(F.count("*").alias("year_n")).filter("year_n >= 30")
    return df.join(years, "year", "left").withColumn(
        "scope", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("year_n").isNotNull(), F.col("year").cast("string"))))))


def bucket_curve(spark, sf):
    return A.medians_by(curve_rows(spark, sf), ["scope", "bucket"], ["f7"], 6, "upper")


@query("bucket_median_curve", ["bucket_curve"], "SELECT * FROM bucket_curve")
def bucket_median_curve(spark, sf):
    return bucket_curve(spark, sf)


@query("year_behaviour_profile", ["scored"], f"SELECT year, count(*) AS n, {upper('coin_rate', 'med_coin_rate')}, {upper('fav_rate', 'med_fav_rate')}, {upper('like_rate', 'med_like_rate')}, {upper('f7', 'med_f7')} FROM scored WHERE view >= 3000 GROUP BY year")
def year_behaviour_profile(spark, sf):
    return A.medians_by(mature(spark, sf), ["year"], ["coin_rate", "fav_rate", "like_rate", "f7"], 1, "upper")


AGE_BANDS = ((0, 365, "<1y"), (365, 1000, "1-3y"), (1000, 1825, "3-5y"), (1825, 3650, ">5y"))
AGE_SQL = "CASE WHEN age < 365 THEN '<1y' WHEN age < 1000 THEN '1-3y' WHEN age < 1825 THEN '3-5y' WHEN age < 3650 THEN '>5y' END"


def midrank_sql(col, part=""):
    p = f"PARTITION BY {part} " if part else ""
    pe = f"PARTITION BY {part}, {col}" if part else f"PARTITION BY {col}"
    return f"(rank() OVER ({p}ORDER BY {col}) + (count(*) OVER ({pe}) - 1) / 2e0)"


@query("age_bands", ["scored"], f"""SELECT band, count(*) AS n, {med('cbi', 'med_cbi')}, floor(quantile_cont(view::DOUBLE, 0.5e0)) AS med_view,
  (SELECT round(corr(a, b), 6) FROM (SELECT {midrank_sql('age')} AS a, {midrank_sql('cbi')} AS b FROM scored WHERE source = 'FURNITURE')) AS spearman
  FROM (SELECT *, {AGE_SQL} AS band FROM scored WHERE source = 'FURNITURE') WHERE band IS NOT NULL GROUP BY band HAVING count(*) >= 5""")
def age_bands(spark, sf):
    df = V.scored(spark, sf).filter("source = 'FURNITURE'")
    ranked = O.midranks(O.midranks(df.select("item_id", "age", "cbi"), [], "age", "item_id", "ra").drop("group_n"), [], "cbi", "item_id", "rb")
    meds = A.medians_by(df.withColumn("band", A.bands(F.col("age"), AGE_BANDS)).filter("band is not null"), ["band"], ["cbi", "view"], 5)
    return meds.withColumn("med_view", F.floor("med_view").cast("double")).withColumn("spearman", ranked.agg(F.corr("ra", "rb").alias("r")).scalar())


DURATIONS = ((0, 60, "<1m"), (60, 180, "1-3m"), (180, 600, "3-10m"), (600, 1800, "10-30m"), (1800, 86400, "<1d"), (86400, 10**9, ">1d"))
DUR_SQL = "CASE WHEN duration < 60 THEN '<1m' WHEN duration < 180 THEN '1-3m' WHEN duration < 600 THEN '3-10m' WHEN duration < 1800 THEN '10-30m' WHEN duration < 86400 THEN '<1d' ELSE '>1d' END"


@query("duration_year_layer_tables", ["scored"], f"""SELECT kind, label, count(*) AS n, {med('f7', 'med_f7')}, {med('cbi', 'med_cbi')}, {med('view', 'med_view')} FROM (
  SELECT 'duration' AS kind, {DUR_SQL} AS label, f7, cbi, view, 30 AS least_n FROM scored
  UNION ALL SELECT 'year', CAST(year AS VARCHAR), f7, cbi, view, 50 FROM scored WHERE source = 'MACHINERY'
  UNION ALL SELECT 'layer', source, f7, cbi, view, 30 FROM scored) GROUP BY kind, label, least_n HAVING count(*) >= least_n""")
def duration_year_layer_tables(spark, sf):
    def tag(kind, label):
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"))
    keys = F.array_compact(F.array(
        tag("duration", A.bands(F.col("duration"), DURATIONS)), F.when(F.col("source") == "MACHINERY", tag("year", F.col("year").cast("string"))), tag("layer", F.col("source"))))
    df = V.scored(spark, sf).select("item_id", "f7", "cbi", "view", F.explode(keys).alias("k")).select("*", "k.kind", "k.label")
    return A.medians_by(df, ["kind", "label"], ["f7", "cbi", "view"]).filter(F.col("n") >= F.when(F.col("kind") == "year", 50).otherwise(30))


@query("cut_simulation", ["scored"], f"""SELECT count(*) AS n, round(avg(CASE WHEN cut THEN 1e0 ELSE 0e0 END), 6) AS cut_share, round(sum(view) FILTER (cut) * 1e0 / sum(view), 6) AS cut_view_share,
  count(*) FILTER (low) AS low_index, count(*) FILTER (brief) AS short, count(*) FILTER (tall) AS portrait,
  round(quantile_cont(view::DOUBLE, 0.5e0) FILTER (cut), 6) AS cut_med_view, round(quantile_cont(view::DOUBLE, 0.5e0) FILTER (NOT cut), 6) AS kept_med_view
  FROM (SELECT *, low OR brief OR tall AS cut FROM (SELECT *, cbi < 0.5e0 AS low, duration > 0 AND duration <= 75 AS brief, coalesce({PORTRAIT_SQL}, FALSE) AS tall FROM scored WHERE source = 'FURNITURE'))""")
def cut_simulation(spark, sf):
    df = V.scored(spark, sf).filter("source = 'FURNITURE'").withColumn("low", F.col("cbi") < 0.5).withColumn(
        "brief", F.col("duration").between(1, 75)).withColumn("tall", F.coalesce(S.portrait(), F.lit(False)))
    df = df.withColumn("cut", F.col("low") | F.col("brief") | F.col("tall"))
    meds = A.medians_by(df, ["cut"], ["view"]).agg(F.max(F.when(F.col("cut"), F.col("med_view"))).alias("c"), F.max(F.when(~F.col("cut"), F.col("med_view"))).alias("k"))
    out = df.agg(F.count("*").alias("n"), A.share(F.col("cut")).alias("cut_share"),
                 A.ratio(F.sum(F.when(F.col("cut"), F.col("view")).otherwise(0)), F.sum("view")).alias("cut_view_share"),
                 F.count_if("low").alias("low_index"), F.count_if("brief").alias("short"), F.count_if("tall").alias("portrait"))
    return out.withColumn("cut_med_view", meds.select("c").scalar()).withColumn("kept_med_view", meds.select("k").scalar())


CUT_REASONS = ("short", "signature", "portrait", "low_views", "index", "tier")


@query("verdict_layer_report", ["verdicts"], """SELECT source, count(*) AS n, count(*) FILTER (hide) AS cut, round(count(*) FILTER (hide) * 1e0 / count(*), 6) AS cut_share,
  round(coalesce(sum(view) FILTER (hide), 0) * 1e0 / sum(view), 6) AS cut_view_share, count(*) FILTER (tag) AS tagged, count(*) FILTER (NOT hide AND verdict_index >= 2) AS gems, """ + ", ".join(
    f"count(*) FILTER (first_reason = '{r}') AS by_{r}" for r in CUT_REASONS) + " FROM verdicts GROUP BY source")
def verdict_layer_report(spark, sf):
    df = verdicts(spark, sf)
    return df.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("hide").alias("cut"), A.share(F.col("hide")).alias("cut_share"),
        A.ratio(F.sum(F.when(F.col("hide"), F.col("view")).otherwise(0)), F.sum("view")).alias("cut_view_share"), F.count_if("tag").alias("tagged"),
        F.count_if(~F.col("hide") & (F.col("verdict_index") >= 2)).alias("gems"),
        *[F.count_if(F.col("first_reason") == r).alias(f"by_{r}") for r in CUT_REASONS])


@query("verdict_reason_samples", ["verdicts"], """SELECT first_reason, rn, item_id, view, title FROM (SELECT *, row_number() OVER (PARTITION BY first_reason ORDER BY view DESC, item_id) AS rn FROM verdicts WHERE hide) WHERE rn <= 5""")
def verdict_reason_samples(spark, sf):
    return O.top_per_group(verdicts(spark, sf).filter("hide"), ["first_reason"], [F.desc("view"), "item_id"], 5).select("first_reason", "rn", "item_id", "view", "title")


@query("band_inventory", ["banded"], f"""SELECT band, count(*) AS n, round(count(*) * 1e0 / (SELECT count(*) FROM banded WHERE view >= 3000), 6) AS share, {upper('coin_rate', 'med')}, {upper('coin_rate', 'p10', '0.1e0')}, {upper('coin_rate', 'p90', '0.9e0')},
  count(*) < 50 AS thin, count(*) FILTER ({HOT_SQL}) AS home, count(*) FILTER (NOT {HOT_SQL}) AS mine FROM banded WHERE view >= 3000 GROUP BY band""")
def band_inventory(spark, sf):
    df = V.banded(spark, sf).filter("view >= 3000")
    q = O.quantiles(df, ["band"], {"c": "coin_rate"}, {"med": 0.5, "p10": 0.1, "p90": 0.9}, method="upper").select(
        "band", *[F.col(f"{p}_c").alias(p) for p in ("med", "p10", "p90")])
    hot = F.col("source").isin(*HOT)
    counts = df.groupBy("band").agg(F.count("*").alias("n"), F.count_if(hot).alias("home"), F.count_if(~hot).alias("mine"))
    total = df.agg(F.count("*").alias("t")).scalar()
    return counts.join(q, "band").withColumn("share", A.ratio(F.col("n"), total)).withColumn("thin", F.col("n") < 50)


shared_sql("inflow", ["edges"], "SELECT item_id, count(DISTINCT user_id) AS collectors FROM edges GROUP BY item_id")


def inflow(spark, sf):
    return A.shared_by(V.edges(spark, sf))


@query("inflow_distribution", ["inflow", "scored"], f"""SELECT CAST(least(collectors, 6) AS BIGINT) AS k, count(*) AS n, count(*) FILTER ({HIGH}) AS high,
  (SELECT count(*) FROM inflow WHERE collectors >= 2) AS with_two FROM inflow JOIN scored USING (item_id) GROUP BY 1""")
def inflow_distribution(spark, sf):
    flow = inflow(spark, sf)
    two = flow.agg(F.count_if(F.col("collectors") >= 2).alias("t")).scalar()
    return flow.join(V.scored(spark, sf), "item_id").groupBy(F.least("collectors", F.lit(6)).alias("k")).agg(
        F.count("*").alias("n"), F.count_if(A.is_high()).alias("high")).withColumn("with_two", two)


STRENGTHS = ((3, 4, "[3,4)"), (4, 6, "[4,6)"), (6, 9, "[6,9)"), (9, 12, "[9,12)"), (12, 1e9, "[12,inf)"))


@query("seeding_response", ["edge_items"], f"""SELECT band, count(*) AS users, CAST(sum(n) AS BIGINT) AS items, round(sum(h) * 1e0 / sum(n), 6) AS high_rate FROM (
  SELECT n, h, CASE WHEN s >= 12 THEN '[12,inf)' WHEN s >= 9 THEN '[9,12)' WHEN s >= 6 THEN '[6,9)' WHEN s >= 4 THEN '[4,6)' WHEN s >= 3 THEN '[3,4)' END AS band FROM (
    SELECT user_id, arm, count(*) AS n, count(*) FILTER ({HIGH}) AS h, max(cbi) / 2 AS s FROM edge_items WHERE view >= 3000 GROUP BY user_id, arm)) WHERE band IS NOT NULL GROUP BY band""")
def seeding_response(spark, sf):
    users = edge_items(spark, sf).filter("view >= 3000").groupBy("user_id", "arm").agg(
        F.count("*").alias("n"), F.count_if(A.is_high()).alias("h"), (F.max("cbi") / 2).alias("s"))
    return users.withColumn("band", A.bands(F.col("s"), STRENGTHS)).filter("band is not null").groupBy("band").agg(
        F.count("*").alias("users"), F.sum("n").alias("items"), A.ratio(F.sum("h"), F.sum("n")).alias("high_rate"))


@query("probe_anatomy", ["edge_items"], f"""SELECT user_id, n, high, round(high * 1e0 / n, 6) AS rate, round((SELECT sum(high) * 1e0 / sum(n) FROM p WHERE user_id <> (SELECT user_id FROM p ORDER BY n DESC, user_id LIMIT 1)), 6) AS rate_without_largest FROM p"""
       .replace("FROM p WHERE", "FROM (SELECT user_id, count(*) AS n, count(*) FILTER (tier = 'high') AS high FROM edge_items WHERE arm = 'N' AND view >= 3000 GROUP BY user_id) p WHERE")
       .replace("FROM p ORDER", "FROM (SELECT user_id, count(*) AS n FROM edge_items WHERE arm = 'N' AND view >= 3000 GROUP BY user_id) p ORDER")
       .replace("AS rate_without_largest FROM p", "AS rate_without_largest FROM (SELECT user_id, count(*) AS n, count(*) FILTER (tier = 'high') AS high FROM edge_items WHERE arm = 'N' AND view >= 3000 GROUP BY user_id) p"))
def probe_anatomy(spark, sf):
    users = edge_items(spark, sf).filter("arm = 'N' and view >= 3000").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(A.is_high()).alias("high"))
    totals = users.agg(F.sum("n").alias("n"), F.sum("high").alias("h"),
                       F.max(F.struct("n", (-F.col("user_id")).alias("u"), "high")).alias("big"))
    rest = totals.select(A.ratio(F.col("h") - F.col("big.high"), F.col("n") - F.col("big.n")).alias("r")).scalar()
    return users.withColumn("rate", A.ratio(F.col("high"), F.col("n"))).withColumn("rate_without_largest", rest)


@query("arm_efficiency", ["edges", "banded"], """WITH_X SELECT arm, count(*) AS finds, any_value(requests) AS requests, round(count(*) * 1e0 / any_value(requests), 6) AS finds_per_request, count(*) FILTER (arms = 1) AS unique_finds,
  count(*) FILTER (arms = 2) AS shared_2, count(*) FILTER (arms = 3) AS shared_3, count(*) FILTER (pct >= 0.98e0) AS high_finds, any_value(top_category) AS top_category
  FROM (SELECT DISTINCT arm, item_id FROM edges) JOIN (SELECT item_id, count(DISTINCT arm) AS arms FROM edges GROUP BY item_id) USING (item_id) JOIN banded USING (item_id)
  JOIN (SELECT arm, count(DISTINCT user_id) AS requests FROM edges GROUP BY arm) USING (arm)
  JOIN (SELECT arm, category AS top_category FROM (SELECT arm, category, row_number() OVER (PARTITION BY arm ORDER BY count(*) DESC, category) AS rn
     FROM (SELECT DISTINCT arm, item_id FROM edges) JOIN banded USING (item_id) GROUP BY arm, category) WHERE rn = 1) USING (arm) GROUP BY arm""".replace("WITH_X ", ""))
def arm_efficiency(spark, sf):
    edges = V.edges(spark, sf)
    arms = edges.groupBy("item_id").agg(F.collect_set("arm").alias("arms"))  # as many elements as there are arms
    finds = arms.join(V.banded(spark, sf).select("item_id", "category", "pct"), "item_id").withColumn("k", F.size("arms")).withColumn("arm", F.explode("arms"))
    tops = finds.groupBy("arm", "category").agg(F.count("*").alias("c")).groupBy("arm").agg(
        F.min_by("category", F.struct(-F.col("c"), "category")).alias("top_category"))
    requests = edges.groupBy("arm").agg(F.countDistinct("user_id").alias("requests"))
    out = finds.groupBy("arm").agg(
        F.count("*").alias("finds"), F.count_if(F.col("k") == 1).alias("unique_finds"), F.count_if(F.col("k") == 2).alias("shared_2"),
        F.count_if(F.col("k") == 3).alias("shared_3"), F.count_if(F.col("pct") >= 0.98).alias("high_finds"))
    return out.join(requests, "arm").join(tops, "arm").withColumn("finds_per_request", A.ratio(F.col("finds"), F.col("requests")))


shared_sql("discovered", ["edge_items"], f"""SELECT user_id, row_number() OVER (ORDER BY first_seen, user_id) AS discovered_at, n, req, high, good FROM (SELECT user_id, min(pub_ts) AS first_seen, count(*) AS n, CAST(ceil(count(*) / 20e0) AS BIGINT) AS req,
  count(*) FILTER ({HIGH}) AS high, count(*) FILTER ({GOOD}) AS good FROM edge_items WHERE arm <> 'N' AND view >= 3000 GROUP BY user_id)""")


def discovered(spark, sf):
    """Main-chain users in discovery order with running totals; probes (arm N) stay out."""
    users = edge_items(spark, sf).filter("arm <> 'N' and view >= 3000").groupBy("user_id").agg(
        F.min("pub_ts").alias("first_seen"), F.count("*").alias("n"), F.ceil(F.count("*") / 20.0).alias("req"),
        F.count_if(A.is_high()).alias("high"), F.count_if(A.is_good()).alias("good"))
    return O.positions(users, [], ["first_seen", "user_id"], weights=["n", "req", "high", "good"])


@query("budget_cutoffs", ["discovered"], """SELECT alpha, count(*) AS users, CAST(sum(req) AS BIGINT) AS requests, CAST(sum(high) AS BIGINT) AS high, round(sum(high) * 1e0 / sum(n), 6) AS high_rate, round(sum(good) * 1e0 / sum(n), 6) AS good_rate,
  round(sum(high) * 1e0 / greatest(1, sum(req)), 6) AS efficiency FROM discovered, (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) AS alpha) WHERE discovered_at <= greatest(1, floor(alpha * (SELECT count(*) FROM discovered))) GROUP BY alpha""")
def budget_cutoffs(spark, sf):
    users = discovered(spark, sf).withColumn("alpha", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))))
    inside = users.filter(F.col("pos") < F.greatest(F.lit(1), F.floor(F.col("alpha") * F.col("group_n"))))
    return inside.groupBy("alpha").agg(F.count("*").alias("users"), F.sum("req").alias("requests"), F.sum("high").alias("high"), A.ratio(F.sum("high"), F.sum("n")).alias("high_rate"),
                                       A.ratio(F.sum("good"), F.sum("n")).alias("good_rate"), A.ratio(F.sum("high"), F.greatest(F.lit(1), F.sum("req"))).alias("efficiency"))


@query("budget_yield_curve", ["discovered"], """SELECT discovered_at, CAST(sum(req) OVER w AS BIGINT) AS requests, CAST(sum(high) OVER w AS BIGINT) AS highs, CAST(sum(good) OVER w AS BIGINT) AS goods FROM discovered
  WINDOW w AS (ORDER BY discovered_at ROWS UNBOUNDED PRECEDING)""")
def budget_yield_curve(spark, sf):
    return discovered(spark, sf).select((F.col("pos") + 1).alias("discovered_at"), *[
        (F.col(f"{c}_before") + F.col(c)).alias(name) for c, name in (("req", "requests"), ("high", "highs"), ("good", "goods"))])


@query("strength_strata", ["edge_items"], f"""SELECT CAST(least(s, 4) AS BIGINT) AS strength, count(*) AS users, round(sum(h) * 1e0 / sum(n), 6) AS high_rate FROM (SELECT user_id, arm, count(*) AS n, count(*) FILTER ({HIGH}) AS h, floor(max(cbi) / 8) AS s
  FROM edge_items WHERE view >= 3000 GROUP BY user_id, arm) GROUP BY 1""")
def strength_strata(spark, sf):
    users = edge_items(spark, sf).filter("view >= 3000").groupBy("user_id", "arm").agg(F.count("*").alias("n"), F.count_if(A.is_high()).alias("h"), F.floor(F.max("cbi") / 8).alias("s"))
    return users.groupBy(F.least("s", F.lit(4)).alias("strength")).agg(F.count("*").alias("users"), A.ratio(F.sum("h"), F.sum("n")).alias("high_rate"))


@query("prune_gain", ["edge_items"], f"""SELECT m AS main_rate, CASE WHEN pn >= 30 THEN p END AS probe_rate, CASE WHEN pn >= 30 AND p > 0 THEN round(m0 / p0, 6) END AS gain FROM (SELECT avg(h) FILTER (arm <> 'N') AS m0, avg(h) FILTER (arm = 'N') AS p0,
  round(avg(h) FILTER (arm <> 'N'), 6) AS m, round(avg(h) FILTER (arm = 'N'), 6) AS p, count(*) FILTER (arm = 'N') AS pn FROM (SELECT arm, CASE WHEN {HIGH} THEN 1e0 ELSE 0e0 END AS h FROM edge_items WHERE view >= 3000))""")
def prune_gain(spark, sf):
    df = edge_items(spark, sf).filter("view >= 3000").withColumn("h", A.is_high().cast("double"))
    probe = F.col("arm") == "N"
    out = df.agg(F.avg(F.when(~probe, F.col("h"))).alias("main_rate"), F.avg(F.when(probe, F.col("h"))).alias("p"), F.count_if(probe).alias("pn"))
    return out.select("main_rate", F.when(F.col("pn") >= 30, F.col("p")).alias("probe_rate")).withColumn("gain", F.try_divide("main_rate", "probe_rate"))


LIKE_RANGES = ((0.0, 0.04, "<4%"), (0.04, 0.08, "4-8%"), (0.08, 0.12, "8-12%"), (0.12, 0.16, "12-16%"), (0.16, 0.20, "16-20%"), (0.20, 9.9, ">20%"))


@query("archive_type_histogram", ["scored"], """SELECT CASE WHEN like_rate < 0.04e0 THEN '<4%' WHEN like_rate < 0.08e0 THEN '4-8%' WHEN like_rate < 0.12e0 THEN '8-12%' WHEN like_rate < 0.16e0 THEN '12-16%' WHEN like_rate < 0.2e0 THEN '16-20%' ELSE '>20%' END AS like_range,
  count(*) AS n FROM scored WHERE coin_rate < 0.02e0 AND fav_rate > 0.1e0 GROUP BY 1""")
def archive_type_histogram(spark, sf):
    return V.scored(spark, sf).filter((F.col("coin_rate") < 0.02) & (F.col("fav_rate") > 0.10)).groupBy(
        A.bands(F.col("like_rate"), LIKE_RANGES).alias("like_range")).agg(F.count("*").alias("n"))


VERDICT_SQL = "CASE WHEN quality = 1 AND toxic = 0 THEN 'innocent' WHEN toxic = 1 THEN 'edge' ELSE 'unsure' END"
shared_sql("judged_items", ["cells", "labels_by_item"], "SELECT cells.*, labels_by_item.verdict, labels_by_item.quality FROM cells JOIN labels_by_item USING (item_id)")
shared_sql("labels_by_item", [], f"SELECT doc_id AS item_id, quality, {VERDICT_SQL} AS verdict FROM labels")


def item_labels(spark, sf):
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "innocent").when(F.col("toxic") == 1, "edge").otherwise("unsure")
    return V.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), "quality", verdict.alias("verdict"))


def judged_items(spark, sf):
    return V.banded(spark, sf).join(item_labels(spark, sf), "item_id").withColumn("cell", R.review_cell())


@query("cell_verdict_crosstab", ["judged_items"], """SELECT cell, count(*) AS n, count(*) FILTER (verdict = 'edge') AS edge, count(*) FILTER (verdict = 'innocent') AS innocent, count(*) FILTER (verdict = 'unsure') AS unsure,
  round(count(*) FILTER (verdict = 'edge') * 1e0 / count(*), 6) AS hit_rate, (SELECT round(count(*) FILTER (verdict = 'edge') * 1e0 / count(*), 6) FROM judged_items WHERE cell IS NOT NULL) AS precision_all,
  (SELECT round(count(*) FILTER (verdict = 'edge' AND cell IS NOT NULL) * 1e0 / count(*) FILTER (verdict = 'edge'), 6) FROM judged_items) AS capture FROM (SELECT * REPLACE (coalesce(cell, 'none') AS cell) FROM judged_items) GROUP BY cell""")
def cell_verdict_crosstab(spark, sf):
    df = judged_items(spark, sf)
    edge, inside = F.col("verdict") == "edge", F.col("cell").isNotNull()
    pooled = df.agg(A.ratio(F.count_if(edge & inside), F.count_if(inside)).alias("p"), A.ratio(F.count_if(edge & inside), F.count_if(edge)).alias("c"))
    kinds = ("edge", "innocent", "unsure")
    return df.groupBy(F.coalesce("cell", F.lit("none")).alias("cell")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds], A.share(edge).alias("hit_rate"),
    ).withColumn("precision_all", pooled.select("p").scalar()).withColumn("capture", pooled.select("c").scalar())


@query("feature_by_verdict", ["judged_items"], "SELECT verdict, count(*) AS n, " + ", ".join(upper(c, f"med_{c}") for c in ("like_rate", "coin_rate", "fav_rate", "view", "duration", "cbi")) + " FROM judged_items WHERE fav_rate > 0.1e0 GROUP BY verdict")
def feature_by_verdict(spark, sf):
    return A.medians_by(judged_items(spark, sf).filter("fav_rate > 0.1"), ["verdict"], ["like_rate", "coin_rate", "fav_rate", "view", "duration", "cbi"], 1, "upper")


shared_sql("rule_pairs", ["draft_ptiers", "ptiers", "labels_by_item"], "SELECT item_id, draft_ptiers.ptier AS old_tier, ptiers.ptier AS new_tier, quality FROM draft_ptiers JOIN ptiers USING (item_id) JOIN labels_by_item USING (item_id)")


@query("rule_change_audit", ["rule_pairs"], """SELECT old_tier, new_tier, count(*) AS n, count(*) FILTER ((old_tier IN ('top', 'fine')) = (quality = 1)) AS old_agrees, count(*) FILTER ((new_tier IN ('top', 'fine')) = (quality = 1)) AS new_agrees,
  count(*) FILTER (((old_tier IN ('top', 'fine')) = (quality = 1)) AND NOT ((new_tier IN ('top', 'fine')) = (quality = 1))) AS conflicts FROM rule_pairs GROUP BY old_tier, new_tier""")
def rule_change_audit(spark, sf):
    df = R.percentile_tier(R.percentile_tier(judged_items(spark, sf), DRAFT_RULES, out="old_tier", fired="f0"), TIERS, out="new_tier", fired="f1")
    wanted = F.col("quality") == 1
    old, new = (F.col(c).isin("top", "fine") == wanted for c in ("old_tier", "new_tier"))
    return df.groupBy("old_tier", "new_tier").agg(F.count("*").alias("n"), F.count_if(old).alias("old_agrees"), F.count_if(new).alias("new_agrees"), F.count_if(old & ~new).alias("conflicts"))


@query("signature_share_by_band", ["banded"], f"""SELECT band, n, high_like, share, p25, p50, p75 FROM (SELECT band, count(*) AS n, count(*) FILTER (like_rate > 0.2e0) AS high_like, round(avg(CASE WHEN like_rate > 0.2e0 THEN 1e0 ELSE 0e0 END), 6) AS share FROM banded WHERE view >= 3000 GROUP BY band)
  LEFT JOIN (SELECT band, {upper('coin_rate', 'p25', '0.25e0')}, {upper('coin_rate', 'p50')}, {upper('coin_rate', 'p75', '0.75e0')} FROM banded WHERE view >= 3000 AND like_rate > 0.2e0 GROUP BY band) USING (band)""")
def signature_share_by_band(spark, sf):
    df = V.banded(spark, sf).filter("view >= 3000")
    hit = F.col("like_rate") > 0.20
    q = O.quantiles(df.filter(hit), ["band"], {"c": "coin_rate"}, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, method="upper").select("band", *[F.col(f"{p}_c").alias(p) for p in ("p25", "p50", "p75")])
    return df.groupBy("band").agg(F.count("*").alias("n"), F.count_if(hit).alias("high_like"), A.share(hit).alias("share")).join(q, "band", "left")


@query("review_arm_precision", ["reviews"], """WITH_X SELECT arm, count(*) AS assigned, count(*) FILTER (status IN ('confirmed', 'not_fit')) AS judged, count(*) FILTER (status = 'confirmed') AS confirmed,
  round(count(*) FILTER (status IN ('confirmed', 'not_fit')) * 1e0 / count(*), 6) AS coverage, round(count(*) FILTER (status = 'confirmed') * 1e0 / nullif(count(*) FILTER (status IN ('confirmed', 'not_fit')), 0), 6) AS precision_among_judged
  FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'recall' WHEN 'fr' THEN 'motive_check' ELSE 'explore' END AS arm FROM documents) LEFT JOIN (SELECT doc_id, STATUS AS status FROM reviews WHERE problem IS NULL) USING (doc_id) GROUP BY arm""".replace("WITH_X ", "")
       .replace("STATUS AS", """CASE WHEN NOT watched THEN 'unreviewed' WHEN trim(evidence) = '' OR reason = '' THEN 'incomplete' WHEN craft >= 2 AND resonance >= 2 AND reason = 'craft_expression' THEN 'confirmed' ELSE 'not_fit' END AS"""))
def review_arm_precision(spark, sf):
    from .projections import reviews
    batch = V.documents(spark, sf).select("doc_id", F.when(F.col("lang") == "en", "recall").when(F.col("lang") == "fr", "motive_check").otherwise("explore").alias("arm"))
    status = reviews(spark, sf).filter("problem is null").select("doc_id", R.review_status().alias("status"))
    judged, ok = F.col("status").isin("confirmed", "not_fit"), F.col("status") == "confirmed"
    return batch.join(status, "doc_id", "left").groupBy("arm").agg(
        F.count("*").alias("assigned"), F.count_if(judged).alias("judged"), F.count_if(ok).alias("confirmed"),
        A.ratio(F.count_if(judged), F.count("*")).alias("coverage"), A.ratio(F.count_if(ok), F.count_if(judged)).alias("precision_among_judged"))


STAGES = ("approved", "short", "long", "series", "not_work", "topic", "small", "kept")


@query("screening_funnel", ["scored"], """SELECT stage, count(*) AS n, count(*) FILTER (strftime(pub_ts, '%Y%m') = '199805') AS fresh FROM (SELECT *, CASE WHEN item_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN 'approved' WHEN duration <= 150 THEN 'short' WHEN duration > 1200 THEN 'long'
  WHEN regexp_matches(title, '^new') THEN 'series' WHEN regexp_matches(title, 'anvil') THEN 'not_work' WHEN regexp_matches(title, 'gizmo') THEN 'topic' WHEN view < 30000 THEN 'small' ELSE 'kept' END AS stage FROM scored) GROUP BY stage""")
def screening_funnel(spark, sf):
    approved = V.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("item_id"), F.lit(True).alias("is_approved"))
    title = F.col("title")
    stage = (F.when(F.col("is_approved"), "approved").when(F.col("duration") <= 150, "short").when(F.col("duration") > 1200, "long")
             .when(title.rlike("^new"), "series").when(title.rlike("anvil"), "not_work").when(title.rlike("gizmo"), "topic").when(F.col("view") < 30_000, "small").otherwise("kept"))
    return V.scored(spark, sf).join(approved, "item_id", "left").groupBy(stage.alias("stage")).agg(
        F.count("*").alias("n"), F.count_if(F.date_format("pub_ts", "yyyyMM") == "199805").alias("fresh"))


@query("group_edge_stats", ["scored"], f"""SELECT grp, n, round(high * 1e0 / n, 6) AS high_rate, round(good * 1e0 / n, 6) AS good_rate, round(coin_rate, 6) AS coin_rate, round(fav_rate, 6) AS fav_rate, round(like_rate, 6) AS like_rate, round(dom * 1e0 / nullif(high, 0), 6) AS fav_dominant FROM (
  SELECT *, count(*) OVER g AS n, count(*) FILTER ({HIGH}) OVER g AS high, count(*) FILTER ({GOOD}) OVER g AS good, count(*) FILTER ({HIGH} AND fav > coin) OVER g AS dom, row_number() OVER (PARTITION BY grp ORDER BY fav_rate, item_id) - 1 AS pos
  FROM (SELECT unnest(CASE WHEN regexp_matches(title, 'bolt|gear') THEN ['all', 'candidate'] ELSE ['all'] END) AS grp, * FROM scored) WINDOW g AS (PARTITION BY grp)) WHERE pos = n // 2""")
def group_edge_stats(spark, sf):
    df = V.scored(spark, sf).withColumn("grp", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("title").rlike("bolt|gear"), "candidate")))))
    mid = A.row_at_median(df, ["grp"], "fav_rate").select("grp", "coin_rate", "fav_rate", "like_rate")
    dom = A.is_high() & (F.col("fav") > F.col("coin"))
    stats = df.groupBy("grp").agg(F.count("*").alias("n"), A.share(A.is_high()).alias("high_rate"), A.share(A.is_good()).alias("good_rate"),
                                  A.ratio(F.count_if(dom), F.count_if(A.is_high())).alias("fav_dominant"))
    return stats.join(mid, "grp")


@query("independent_medians", ["scored"], f"""SELECT m.source, med_coin_rate, med_fav_rate, med_like_rate, row_coin_rate, row_fav_rate, row_like_rate FROM (SELECT source, {upper('coin_rate', 'med_coin_rate')}, {upper('fav_rate', 'med_fav_rate')}, {upper('like_rate', 'med_like_rate')} FROM scored GROUP BY source) m
  JOIN (SELECT source, round(coin_rate, 6) AS row_coin_rate, round(fav_rate, 6) AS row_fav_rate, round(like_rate, 6) AS row_like_rate FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fav_rate, item_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM scored) WHERE pos = n // 2) r ON m.source = r.source""")
def independent_medians(spark, sf):
    df = V.scored(spark, sf)
    cols = ("coin_rate", "fav_rate", "like_rate")
    row = A.row_at_median(df, ["source"], "fav_rate").select("source", *[F.col(c).alias(f"row_{c}") for c in cols])
    return A.medians_by(df, ["source"], list(cols), 1, "upper").drop("n").join(row, "source")


@query("collector_folder_summary", ["edge_items"], f"""SELECT user_id, arm, count(*) AS n, count(*) FILTER (pub_ts < TIMESTAMP '{DRIVER.reference_cutoff}') AS in_old_snapshot, {med('view', 'med_view')}, {med('fav_rate', 'med_fav_rate')},
  array_to_string(list(CAST(item_id AS VARCHAR) ORDER BY cbi DESC, item_id)[1:3], ';') AS best FROM edge_items GROUP BY user_id, arm""")
def collector_folder_summary(spark, sf):
    df = edge_items(spark, sf)
    old = V.items(spark, sf).filter(F.col("pub_ts") < F.lit(DRIVER.reference_cutoff).cast("timestamp")).select("item_id", F.lit(1).alias("old"))
    counts = df.select("user_id", "arm", "item_id").join(old, "item_id", "left").groupBy("user_id", "arm").agg(F.count("old").alias("in_old_snapshot"))
    best = O.top_per_group(df.select("user_id", "arm", "item_id", "cbi"), ["user_id", "arm"], [F.desc("cbi"), "item_id"], 3).groupBy("user_id", "arm").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "item_id"))), lambda x: x["item_id"].cast("string")), ";").alias("best"))
    return A.medians_by(df, ["user_id", "arm"], ["view", "fav_rate"]).join(counts, ["user_id", "arm"]).join(best, ["user_id", "arm"])
