"""Statistics and fitted models over the scored items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import scores as S
from ..functions import stats as ST
from ..operators import aggregates as A
from ..operators import bootstrap as BS
from ..operators import fits as M
from ..params import DENOMINATORS, WEIGHT_SUBSETS
from ..session import drop_stage, shared_table, stage
from ..sources import views as V
from .aggregations import bucket_curve, curve_rows, edge_items, item_labels, mature, med, midrank_sql, upper, user_arm, inflow
from .registry import query, shared_sql
from .windows import h

GRID = dict(start=3.0, stop=8.4, step=0.1)  # the driver's views reach 2.5e8


def erfc_sql(x):
    poly = "0e0"
    for a in reversed(ST.ERFC_A):
        poly = f"(({poly} + {a}e0) * t)"
    return f"(SELECT CASE WHEN x >= 0 THEN e ELSE 2e0 - e END FROM (SELECT x, {poly} * exp(-x * x) AS e FROM (SELECT x, 1e0 / (1e0 + {ST.ERFC_P}e0 * abs(x)) AS t FROM (SELECT {x} AS x))))"


def rank_sum_sql(source, groups, value, is_x):
    """Per group: n_x, n_y, z, p_greater, p_two from mid-ranks."""
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    partv = f"PARTITION BY {g}{value}"
    by = f"GROUP BY {groups}" if groups else ""
    return f"""SELECT {g}n_x, n_y, round(z, 6) AS z, round(0.5e0 * {erfc_sql('z / sqrt(2e0)')}, 6) AS p_greater, round({erfc_sql('z2 / sqrt(2e0)')}, 6) AS p_two FROM (
  SELECT *, CASE WHEN n_x >= 5 AND n_y >= 5 THEN (u - mu) / sqrt(n_x * n_y * (n_x + n_y + 1) / 12e0) END AS z,
    CASE WHEN n_x >= 5 AND n_y >= 5 THEN greatest(abs(u - mu) - 0.5e0, 0e0) / sqrt(n_x * n_y / 12e0 * ((n_x + n_y + 1) - ties / ((n_x + n_y) * (n_x + n_y - 1e0)))) END AS z2 FROM (
    SELECT {g}count(*) FILTER ({is_x}) AS n_x, count(*) FILTER (NOT {is_x}) AS n_y, coalesce(sum(r) FILTER ({is_x}), 0) - count(*) FILTER ({is_x}) * (count(*) FILTER ({is_x}) + 1) / 2e0 AS u,
      count(*) FILTER ({is_x}) * count(*) FILTER (NOT {is_x}) / 2e0 AS mu, sum(t * t - 1) AS ties
    FROM (SELECT *, (rank() OVER ({part}ORDER BY {value}) + (count(*) OVER ({partv}) - 1) / 2e0) AS r, count(*) OVER ({partv}) * 1e0 AS t FROM {source} WHERE {value} IS NOT NULL) {by}))"""


shared_sql("fit_curve", ["scored"], """SELECT i, 3e0 + i * 0.1e0 AS g, count(*) AS n, round(quantile_cont(f7, 0.5e0), 4) AS p50, round(quantile_cont(f7, 0.25e0), 4) AS p25
  FROM scored JOIN (SELECT unnest(generate_series(0, 54)) AS i) ON lv >= 3e0 + i * 0.1e0 - 0.35e0 AND lv <= 3e0 + i * 0.1e0 + 0.35e0 GROUP BY i HAVING count(*) >= 25""")
shared_sql("fitted", ["fit_curve", "scored"], """SELECT s.*, e AS expected, f7 / e AS fit_index FROM (SELECT scored.*, CASE WHEN lv <= (SELECT min(g) FROM fit_curve) THEN (SELECT arg_min(p50, g) FROM fit_curve)
    WHEN lv >= (SELECT max(g) FROM fit_curve) THEN (SELECT arg_max(p50, g) FROM fit_curve) ELSE a.p50 + (lv - a.g) / (a.g1 - a.g) * (a.q1 - a.p50) END AS e
  FROM scored LEFT JOIN (SELECT g, p50, lead(g) OVER (ORDER BY g) AS g1, lead(p50) OVER (ORDER BY g) AS q1 FROM fit_curve) a ON lv >= a.g AND lv < a.g1) s""")


def fit_curve(spark, sf):
    return M.window_curve(V.scored(spark, sf), **GRID)


def fitted(spark, sf):
    return M.fitted_index(V.scored(spark, sf), fit_curve(spark, sf), **GRID)


@query("fit_baseline_curve", ["fit_curve"], "SELECT round(g, 6) AS g, n, p50, p25 FROM fit_curve")
def fit_baseline_curve(spark, sf):
    return fit_curve(spark, sf).select("g", "n", "p50", "p25")


@query("fitted_index", ["fitted"], "SELECT item_id, round(expected, 6) AS expected, round(fit_index, 5) AS fit_index FROM fitted")
def fitted_index(spark, sf):
    return fitted(spark, sf).select("item_id", "expected", F.round("fit_index", 5).alias("fit_index"))


@query("verdict_confusion", ["fitted"], f"""SELECT both_low, global_only, index_only, healthy, round(global_only * 1e0 / greatest(both_low + global_only, 1), 6) AS pardoned, round(chi, 4) AS chi2, round({erfc_sql('sqrt(chi / 2e0)')}, 6) AS p FROM (
  SELECT *, n * pow(greatest(abs(both_low * 1e0 * healthy - global_only * 1e0 * index_only) - n / 2e0, 0), 2) / ((both_low + global_only) * 1e0 * (index_only + healthy) * (both_low + index_only) * (global_only + healthy)) AS chi FROM (
  SELECT count(*) AS n, count(*) FILTER (a AND b) AS both_low, count(*) FILTER (a AND NOT b) AS global_only, count(*) FILTER (NOT a AND b) AS index_only, count(*) FILTER (NOT a AND NOT b) AS healthy
  FROM (SELECT f7 < (SELECT quantile_cont(f7, 0.25e0) FROM scored) AS a, fit_index < 0.5e0 AS b FROM fitted WHERE view >= 50000)))""")
def verdict_confusion(spark, sf):
    p25 = O.quantiles(V.scored(spark, sf), [], {"f7": "f7"}, {"p25": 0.25}).select("p25_f7").scalar()
    a, b = F.col("f7") < p25, F.col("fit_index") < 0.5
    cells = fitted(spark, sf).filter("view >= 50000").agg(
        F.count_if(a & b).alias("both_low"), F.count_if(a & ~b).alias("global_only"), F.count_if(~a & b).alias("index_only"), F.count_if(~a & ~b).alias("healthy"))
    c = [F.col(x) for x in ("both_low", "global_only", "index_only", "healthy")]
    return cells.withColumn("pardoned", A.ratio(c[1], F.greatest(c[0] + c[1], F.lit(1)))).withColumn("chi", M.chi_square_2x2(*c)).withColumn(
        "chi2", F.round("chi", 4)).withColumn("p", ST.erfc(F.sqrt(F.col("chi") / 2))).drop("chi")


PC = ("f7", "lv", "la", "ld")
shared_sql("logs", ["scored"], "SELECT *, log10(age) AS la, log10(greatest(duration, 1)) AS ld FROM scored")
shared_sql("zone_logs", ["logs"], "SELECT " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY category) AS {c}" for c in PC) + " FROM logs WHERE source = 'MACHINERY'")


def corr_row_sql(source):
    return "SELECT " + ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for i, a in enumerate(PC) for b in PC[i + 1:]) + f" FROM {source}"


def partial_sql(y, x, given):
    if not given:
        a, b = sorted((y, x), key=PC.index)
        return f"r_{a}_{b}"
    *rest, c = given
    ab, ac, bc = partial_sql(y, x, rest), partial_sql(y, c, rest), partial_sql(x, c, rest)
    return f"(({ab} - {ac} * {bc}) / sqrt((1 - {ac} * {ac}) * (1 - {bc} * {bc})))"


@query("partial_correlation", ["zone_logs"], f"""SELECT round({partial_sql('f7', 'lv', [])}, 6) AS raw, round({partial_sql('f7', 'lv', ['la'])}, 6) AS ctrl_age, round({partial_sql('f7', 'lv', ['la', 'ld'])}, 6) AS ctrl_age_duration,
  z.layer_all AS layer_all, z.duration_all AS duration_all FROM ({corr_row_sql('logs')}) , (SELECT round({partial_sql('f7', 'lv', ['la', 'ld'])}, 6) AS layer_all, round({partial_sql('f7', 'ld', ['la'])}, 6) AS duration_all FROM ({corr_row_sql('zone_logs')})) z""")
def partial_correlation(spark, sf):
    df = V.scored(spark, sf).withColumn("la", F.log10("age")).withColumn("ld", F.log10(F.greatest("duration", F.lit(1))))
    whole = ST.within_correlations(df, PC)
    inner = ST.within_correlations(df.filter("source = 'MACHINERY'"), PC, "category")

    def pc(y, x, controls):
        return ST.partial_from(whole, y, x, controls, PC)

    side = inner.select(pc("f7", "lv", ["la", "ld"]).alias("a"), pc("f7", "ld", ["la"]).alias("b"))
    return whole.select(pc("f7", "lv", []).alias("raw"), pc("f7", "lv", ["la"]).alias("ctrl_age"), pc("f7", "lv", ["la", "ld"]).alias("ctrl_age_duration"),
                        side.select("a").scalar().alias("layer_all"), side.select("b").scalar().alias("duration_all"))


@query("pearson_spearman", ["scored"], f"""SELECT source, count(*) AS n, round(corr(f7, lv), 6) + 0e0 AS pearson, round(corr(a, b), 6) + 0e0 AS spearman FROM (SELECT source, f7, lv, {midrank_sql('f7', 'source')} AS a, {midrank_sql('lv', 'source')} AS b FROM scored) GROUP BY source""")
def pearson_spearman(spark, sf):
    df = V.scored(spark, sf).select("item_id", "source", "f7", "lv")
    ranked = O.midranks(O.midranks(df, ["source"], "f7", "item_id", "ra").drop("group_n"), ["source"], "lv", "item_id", "rb")
    enough = F.count("*") >= 3
    return ranked.groupBy("source").agg(F.count("*").alias("n"), F.when(enough, F.corr("f7", "lv")).alias("pearson"), F.when(enough, F.corr("ra", "rb")).alias("spearman"))


SIGNALS = ("like", "coin", "fav", "danmaku", "share", "reply")
SPAIRS = [(a, b) for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1:]]


def rank_columns(df, measures):
    """Mid-ranks of several measures in one range pass, pivoted back per item: r_<measure>."""
    long = df.select("item_id", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).cast("double").alias("v")) for m, c in measures.items()])).alias("x")).select("item_id", "x.m", "x.v")
    ranked = O.midranks(long, ["m"], "v", "item_id")
    return ranked.groupBy("item_id").agg(*[F.max(F.when(F.col("m") == m, F.col("midrank"))).alias(f"r_{m}") for m in measures])


@query("signal_rank_matrix", ["rate_ranks"], " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(r_{a}, r_{b}), 6) + 0e0 AS rho FROM rate_ranks" for a, b in SPAIRS))
def signal_rank_matrix(spark, sf):
    ranks = rank_columns(V.scored(spark, sf), {s: f"{s}_rate" for s in SIGNALS})
    row = ranks.agg(*[F.corr(f"r_{a}", f"r_{b}").alias(f"{a}_{b}") for a, b in SPAIRS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("rho")) for a, b in SPAIRS])).alias("x")).select("x.a", "x.b", "x.rho")


shared_sql("rate_ranks", ["scored"], "SELECT item_id, source, f7, fav, coin, like_cnt, view, " + ", ".join(f"{midrank_sql(s + '_rate')} AS r_{s}" for s in SIGNALS) + f", {midrank_sql('lv')} AS r_lv, {midrank_sql('social')} AS r_social FROM scored")
WEIGHT_SQL = "(VALUES " + ", ".join(f"('{n}', {f}e0, {c}e0, {l}e0)" for n, f, c, l in WEIGHT_SUBSETS) + ") w(subset, wf, wc, wl)"
shared_sql("formulas", ["rate_ranks"], f"""SELECT *, (wf * fav + wc * coin + wl * like_cnt) / CASE denom WHEN 'view' THEN greatest(view, 1) WHEN 'sqrt' THEN sqrt(greatest(view, 1)) ELSE log10(greatest(view, 10)) END AS score
  FROM rate_ranks, {WEIGHT_SQL}, (SELECT unnest(['view', 'sqrt', 'log']) AS denom)""")


@query("formula_grid", ["formulas"], f"""SELECT subset, denom, round(corr(r, r_lv), 5) + 0e0 AS corr_log_view, round(corr(r, r_social), 5) + 0e0 AS corr_social, round(count(*) FILTER (rn <= 50 AND source <> 'MACHINERY') / 50e0, 6) AS bottom_other
  FROM (SELECT *, {midrank_sql('score', 'subset, denom')} AS r, row_number() OVER (PARTITION BY subset, denom ORDER BY score, item_id) AS rn FROM formulas) GROUP BY subset, denom""")
def formula_grid(spark, sf):
    df = V.scored(spark, sf)
    base = df.select("item_id", "source", "fav", "coin", "like_cnt", "view").join(rank_columns(df, {"lv": "lv", "social": "social"}), "item_id")
    base, found = stage(base, "formula-rows"), None
    for n, (f, c, l) in [(w[0], w[1:]) for w in WEIGHT_SUBSETS]:  # one subset's orders lie on disk at a time
        grid = [F.struct(F.lit(n).alias("subset"), F.lit(d).alias("denom"), S.weighted_ratio(d, (f, c, l)).alias("score")) for d in DENOMINATORS]
        long = base.select("item_id", "source", "r_lv", "r_social", F.explode(F.array(*grid)).alias("x")).select("item_id", "source", "r_lv", "r_social", "x.*")
        ranked = O.positions(long, ["subset", "denom"], ["score", "item_id"], ties=["score"])
        mid = (F.col("tie_first") + F.col("tie_last")) / 2.0 + 1
        part = stage(ranked.groupBy("subset", "denom").agg(
            F.round(F.corr(mid, "r_lv"), 5).alias("corr_log_view"), F.round(F.corr(mid, "r_social"), 5).alias("corr_social"),
            (F.count_if((F.col("pos") < 50) & (F.col("source") != "MACHINERY")) / 50.0).alias("bottom_other")), "formulas")
        drop_stage(ranked)
        found = part if found is None else found.unionByName(part)
    drop_stage(base)
    return found


RS_COLS = ("n_x", "n_y", "z", "p_greater", "p_two")


@query("mann_whitney", ["scored"], rank_sum_sql("(SELECT *, source = 'MACHINERY' AS is_x FROM scored)", "category", "f7", "is_x"))
def mann_whitney(spark, sf):
    return ST.rank_sum(V.scored(spark, sf).withColumn("is_x", F.col("source") == "MACHINERY"), ["category"], "f7", "is_x")


WORD_FEATURES = {"hot": "hot", "cold": "cold", "large": "large", "ring": "ring", "gizmo": "gizmo", "two_words_b": "^b.* b", "ends_t": "t$", "long": ".{10,}"}
FEATURE_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS feature, regexp_matches(title, '{p}') AS hit, f7, cbi, view::DOUBLE AS view, item_id FROM scored" for n, p in WORD_FEATURES.items())
shared_sql("feature_rows", ["scored"], f"SELECT feature, 'f7' AS measure, hit, f7 AS v, item_id FROM ({FEATURE_ROWS}) UNION ALL SELECT 'handmade', unnest(['cbi', 'view']), regexp_matches(title, 'bolt|rod'), unnest([cbi, view::DOUBLE]), item_id FROM scored")


@query("title_feature_tests", ["feature_rows"], f"""SELECT r.*, m.med_v, m.rest_v FROM ({rank_sum_sql('feature_rows', 'feature, measure', 'v', 'hit')}) r JOIN (SELECT feature, measure, round(quantile_cont(v, 0.5e0) FILTER (hit), 6) AS med_v, round(quantile_cont(v, 0.5e0) FILTER (NOT hit), 6) AS rest_v
  FROM feature_rows GROUP BY feature, measure) m USING (feature, measure) WHERE n_x >= 15""")
def title_feature_tests(spark, sf):
    df = V.scored(spark, sf)
    handmade = F.col("title").rlike("bolt|rod")
    flags = {n: F.col("title").rlike(p) for n, p in WORD_FEATURES.items()}
    # A measure's ranks do not depend on the feature, so rank once per measure and sum ranks per feature.
    long = df.select("item_id", "title", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in ("f7", "cbi", "view")])).alias("x")).select("item_id", "title", "x.*")
    ranked = O.positions(long, ["measure"], ["v", "item_id"], ties=["v"])
    tests = F.array_compact(F.array(
        *[F.when(F.col("measure") == "f7", F.struct(F.lit(n).alias("feature"), c.alias("hit"))) for n, c in flags.items()],
        F.when(F.col("measure") != "f7", F.struct(F.lit("handmade").alias("feature"), handmade.alias("hit")))))
    rows = ranked.withColumn("t", F.explode(tests)).select("*", "t.feature", "t.hit")
    run = F.col("tie_last") - F.col("tie_first") + 1
    sums = rows.groupBy("feature", "measure").agg(
        F.count_if("hit").alias("n_x"), F.count_if(~F.col("hit")).alias("n_y"),
        F.sum(F.when(F.col("hit"), (F.col("tie_first") + F.col("tie_last")) / 2.0 + 1)).alias("_r"), F.sum(run * run - 1).alias("_ties"))
    meds = A.medians_by(rows.select("item_id", "feature", "measure", "hit", "v"), ["feature", "measure", "hit"], ["v"])
    wide = meds.groupBy("feature", "measure").agg(F.max(F.when(F.col("hit"), F.col("med_v"))).alias("med_v"), F.max(F.when(~F.col("hit"), F.col("med_v"))).alias("rest_v"))
    return ST.rank_sum_test(sums).filter("n_x >= 15").join(wide, ["feature", "measure"])


ARM_PAIRS = (("A", "N"), ("A", "R"), ("N", "R"))
METRICS = ("high_rate", "good_rate", "mean_index", "upper_index")
PAIR_SQL = "(VALUES " + ", ".join(f"('{a}>{b}', '{a}', '{b}')" for a, b in ARM_PAIRS) + ") p(pair, a, b)"
METRIC_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS metric, arm, user_id, {m} AS v FROM user_arm" for m in METRICS)
shared_sql("arm_rows", ["user_arm"], f"SELECT pair, metric, arm = a AS is_x, round(v, 6) AS v, user_id FROM ({METRIC_ROWS}), {PAIR_SQL} WHERE arm IN (a, b)")


@query("arm_comparison", ["arm_rows"], f"""SELECT r.*, m.mean_ratio, p_greater < 0.05e0 AND m.mean_ratio >= 1.3e0 AS better FROM ({rank_sum_sql('arm_rows', 'pair, metric', 'v', 'is_x')}) r
  JOIN (SELECT pair, metric, round(avg(v) FILTER (is_x) / avg(v) FILTER (NOT is_x), 5) AS mean_ratio FROM arm_rows GROUP BY pair, metric) m USING (pair, metric)""")
def arm_comparison(spark, sf):
    users = user_arm(spark, sf)
    metric = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m), 6).alias("v")) for m in METRICS])).alias("x")
    pairs = F.explode(F.array_compact(F.array(*[
        F.when(F.col("arm").isin(a, b), F.struct(F.lit(f"{a}>{b}").alias("pair"), (F.col("arm") == a).alias("is_x"))) for a, b in ARM_PAIRS]))).alias("p")
    rows = users.select("user_id", "arm", metric).select("user_id", "arm", "x.*").select("user_id", "metric", "v", pairs).select("user_id", "metric", "v", "p.*")
    means = rows.groupBy("pair", "metric").agg(F.round(F.try_divide(F.avg(F.when(F.col("is_x"), F.col("v"))), F.avg(F.when(~F.col("is_x"), F.col("v")))), 5).alias("mean_ratio"))
    return ST.rank_sum(rows, ["pair", "metric"], "v", "is_x", ("user_id",)).join(means, ["pair", "metric"]).withColumn(
        "better", (F.round("p_greater", 6) < 0.05) & (F.col("mean_ratio") >= 1.3))


REPLICATES = 4000


def draws_sql(clusters, keys, replicates):
    """DuckDB text of (keys, idx, b, times) from clusters (keys, idx, total): the draws of operators.bootstrap."""
    named, text = ", ".join(keys), " || ':' || ".join(keys)
    mean = f"greatest(0e0, 1e0 - {BS.SPARE}e0 / sqrt(total::DOUBLE))"
    p = below = "exp(-mean)"
    limits = []
    for k in range(1, BS.COUNTS + 1):
        limits.append(f"printf('%08x', least(floor(({below}) * 4294967296e0)::BIGINT, 4294967295))")
        p = f"{p} * mean / {k}e0"
        below = f"{below} + {p}"
    count = " ".join(f"WHEN s < t[{k + 1}] THEN {k}" for k in range(BS.COUNTS))
    return f"""(WITH limits AS (SELECT *, [{", ".join(limits)}] AS t FROM (SELECT {named}, idx, total, {mean} AS mean FROM {clusters})),
  hashed AS (SELECT {named}, idx, total, t, q, md5({text} || ':' || idx || ':' || q) AS m FROM limits, (SELECT unnest(range({replicates // BS.PER_HASH})) AS q)),
  first AS MATERIALIZED (SELECT {named}, idx, total, q * {BS.PER_HASH} + i AS b, CASE {count} ELSE {BS.COUNTS} END AS times
    FROM (SELECT *, substr(m, 8 * i::INT + 1, 8) AS s FROM hashed, (SELECT unnest(range({BS.PER_HASH})) AS i))),
  lacking AS (SELECT {named}, total, b, unnest(range(greatest(0, total - draws))) AS d FROM (SELECT {named}, any_value(total) AS total, b, sum(times)::BIGINT AS draws FROM first GROUP BY {named}, b))
  SELECT {named}, idx, b, sum(times)::BIGINT AS times FROM (SELECT {named}, idx, b, times FROM first WHERE times > 0
    UNION ALL SELECT {named}, {h(f"{text} || ':' || b || ':+:' || d", "total")} AS idx, b, 1 AS times FROM lacking) GROUP BY {named}, idx, b)"""


shared_sql("clusters", ["edge_items"], """SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY user_id) - 1 AS idx, n, g, count(*) OVER (PARTITION BY arm) AS total
  FROM (SELECT arm, user_id, count(*) AS n, count(*) FILTER (tier = 'high') AS g FROM edge_items WHERE view >= 3000 GROUP BY arm, user_id)""")
shared_sql("boot", ["clusters"], f"""SELECT arm, list_sort(list(rate)) AS rates FROM (SELECT arm, b, sum(g * times) * 1e0 / greatest(1, sum(n * times)) AS rate
  FROM {draws_sql("clusters", ["arm"], REPLICATES)} d JOIN clusters c USING (arm, idx) GROUP BY arm, b) GROUP BY arm""")
BOOT_SQL = f"round(list_avg(rates), 6) AS mean, round(rates[{int(0.025 * REPLICATES) + 1}], 6) AS lo, round(rates[{int(0.975 * REPLICATES)}], 6) AS hi"


def bootstrap(spark, sf):
    """Interval of each arm, computed once for all queries that read it."""
    return shared_table(spark, sf, "bootstrap", lambda: resampled(spark, sf))


def resampled(spark, sf):
    """Whole users drawn with replacement per arm; the shuffle carries one total per task, arm and replicate."""
    users = edge_items(spark, sf).filter("view >= 3000").groupBy("arm", "user_id").agg(F.count("*").alias("n"), F.count_if(A.is_high()).alias("g"))
    clusters = stage(O.positions(users, ["arm"], ["user_id"]), "clusters")
    reps = BS.replicate_sums(clusters, ["arm"], ["n", "g"], REPLICATES).select("arm", A.ratio(F.col("g"), F.greatest(F.lit(1), F.col("n"))).alias("rate"))
    return BS.interval(reps, ["arm"], "rate", int(0.025 * REPLICATES), int(0.975 * REPLICATES) - 1)


@query("cluster_bootstrap_rate", ["boot"], f"SELECT arm, {BOOT_SQL} FROM boot")
def cluster_bootstrap_rate(spark, sf):
    return bootstrap(spark, sf)


@query("noise_interval_check", ["boot"], f"SELECT hop, rate, lo, hi, rate BETWEEN lo AND hi AS inside FROM (SELECT c.arm AS hop, round(sum(g) * 1e0 / sum(n), 6) AS rate FROM clusters c GROUP BY c.arm) JOIN (SELECT {BOOT_SQL} FROM boot WHERE arm = 'N') ON TRUE")
def noise_interval_check(spark, sf):
    boot = bootstrap(spark, sf).filter("arm = 'N'")
    rates = edge_items(spark, sf).filter("view >= 3000").groupBy(F.col("arm").alias("hop")).agg(F.round(A.share(A.is_high()), 6).alias("rate"))
    lo, hi = boot.select(F.round("lo", 6)).scalar(), boot.select(F.round("hi", 6)).scalar()
    return rates.withColumn("lo", lo).withColumn("hi", hi).withColumn("inside", F.col("rate").between(F.col("lo"), F.col("hi")))


@query("wald_interval", ["edge_items"], """SELECT arm, n, round(p, 6) AS rate, round(greatest(p - w, 0), 6) AS lo, round(least(p + w, 1), 6) AS hi, main BETWEEN greatest(p - w, 0) AND least(p + w, 1) AS main_inside FROM (SELECT arm, n, p, 1.96e0 * sqrt(p * (1 - p) / n) AS w,
  (SELECT avg(CASE WHEN tier = 'high' THEN 1e0 ELSE 0e0 END) FROM edge_items WHERE view >= 3000) AS main FROM (SELECT arm, count(*) AS n, avg(CASE WHEN tier = 'high' THEN 1e0 ELSE 0e0 END) AS p FROM edge_items WHERE view >= 3000 GROUP BY arm))""")
def wald_interval(spark, sf):
    df = edge_items(spark, sf).filter("view >= 3000")
    p, w = F.col("rate"), 1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    main = df.agg(A.share(A.is_high()).alias("m")).scalar()
    return df.groupBy("arm").agg(F.count("*").alias("n"), A.share(A.is_high()).alias("rate")).withColumn("lo", F.greatest(p - w, F.lit(0.0))).withColumn(
        "hi", F.least(p + w, F.lit(1.0))).withColumn("main_inside", main.between(F.col("lo"), F.col("hi")))


shared_sql("scopes", ["scored"], "SELECT 'all' AS scope, * FROM scored UNION ALL SELECT source, * FROM scored WHERE source IN ('MACHINERY', 'FURNITURE')")
shared_sql("ranked_views", ["scopes"], "SELECT *, row_number() OVER w AS r, sum(view) OVER w AS running, count(*) OVER (PARTITION BY scope) AS n, sum(view) OVER (PARTITION BY scope) AS total FROM scopes WINDOW w AS (PARTITION BY scope ORDER BY view DESC, item_id ROWS UNBOUNDED PRECEDING)")


@query("lorenz_gini_zipf", ["ranked_views"], """SELECT scope, 'gini' AS metric, 0 AS point, round(1 - 2e0 / (any_value(n) - 1) * (sum((total - running + view) * 1e0 / total) - (min(view) * 1e0 / any_value(total) + 1) / 2), 6) AS value FROM ranked_views GROUP BY scope
UNION ALL SELECT scope, 'top_1', 0, round(sum(view) FILTER (r <= greatest(1, n // 100)) * 1e0 / any_value(total), 6) FROM ranked_views GROUP BY scope
UNION ALL SELECT scope, 'top_10', 0, round(sum(view) FILTER (r <= greatest(1, n // 10)) * 1e0 / any_value(total), 6) FROM ranked_views GROUP BY scope
UNION ALL SELECT scope, 'zipf', 0, round(regr_slope(log10(view), log10(r)), 6) FROM ranked_views WHERE r >= 10 AND r <= n // 2 GROUP BY scope
UNION ALL SELECT scope, 'curve', i, round(running * 1e0 / total, 6) FROM ranked_views, (SELECT unnest(generate_series(0, 40)) AS i) WHERE r - 1 = floor(i * ((n - 1) / 40e0))""")
def lorenz_gini_zipf(spark, sf):
    df = V.scored(spark, sf).select("item_id", "view", F.explode(F.array_compact(F.array(
        F.lit("all"), F.when(F.col("source").isin("MACHINERY", "FURNITURE"), F.col("source"))))).alias("scope"))
    r = M.lorenz(df, "scope", "view")
    n, total, view, rank = F.col("group_n"), F.col("total"), F.col("view"), F.col("rank")
    first = F.min("view") / F.max("total")
    rising = F.sum((total - F.col("running") + view) / total)  # cumulative share counted from the smallest
    inside = F.when((rank >= 10) & (rank <= F.floor(n / 2)), F.log10(view))
    wide = r.groupBy("scope").agg(
        (1 - 2.0 / (F.max(n) - 1) * (rising - (first + 1) / 2)).alias("gini"),
        (F.sum(F.when(rank <= F.greatest(F.lit(1), F.floor(n / 100)), view)) / F.max(total)).alias("top_1"),
        (F.sum(F.when(rank <= F.greatest(F.lit(1), F.floor(n / 10)), view)) / F.max(total)).alias("top_10"),
        F.regr_slope(inside, F.log10(rank)).alias("zipf"))
    scalars = wide.select("scope", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("gini", "top_1", "top_10", "zipf")])).alias("x")).select("scope", "x.metric", F.lit(0).cast("long").alias("point"), "x.value")
    sizes = r.groupBy("scope").agg(F.max("group_n").alias("m"))
    wanted = sizes.select("scope", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.floor(i * ((F.col("m") - 1) / F.lit(40.0))))).alias("point", "pos"))
    curve = r.join(wanted, ["scope", "pos"]).select("scope", F.lit("curve").alias("metric"), F.col("point").cast("long").alias("point"), (F.col("running") / total).alias("value"))
    return scalars.unionByName(curve)


shared_sql("power_fits", ["curve_rows"], "SELECT scope, count(*) AS n, regr_intercept(log10(greatest(f7, 1e-6)), lv) AS a, regr_slope(log10(greatest(f7, 1e-6)), lv) AS b FROM curve_rows GROUP BY scope HAVING count(*) >= 10")


@query("power_law_baseline", ["power_fits"], """SELECT scope, any_value(f.n) AS n, round(any_value(a), 5) AS a, round(any_value(b), 6) + 0e0 AS b, round(avg(pow(log10(greatest(f7, 1e-6)) - (a + b * lv), 2)), 6) AS mse,
  round(avg(f7 / pow(10, a + b * lv)), 5) AS mean_index FROM curve_rows JOIN power_fits f USING (scope) GROUP BY scope""")
def power_law_baseline(spark, sf):
    rows = curve_rows(spark, sf)
    fits = M.power_law(rows, ["scope"])
    means = rows.join(fits.select("scope", "a", "b"), "scope").groupBy("scope").agg(F.round(F.avg(F.col("f7") / F.pow(F.lit(10.0), F.col("a") + F.col("b") * F.col("lv"))), 5).alias("mean_index"))
    return fits.withColumn("a", F.round("a", 5)).join(means, "scope")


shared_sql("leaf_rows", ["power_fits", "bucket_curve"], """SELECT r.item_id, r.year, r.f7, r.lv, g.med_f7 AS global_med, l.med_f7 AS leaf_med, gf.a + gf.b * r.lv AS global_log, lf.a + lf.b * r.lv AS leaf_log, lf.scope IS NOT NULL AS has_leaf
  FROM curve_rows r LEFT JOIN bucket_curve g ON g.scope = 'all' AND g.bucket = r.bucket LEFT JOIN bucket_curve l ON l.scope = CAST(r.year AS VARCHAR) AND l.bucket = r.bucket
  JOIN power_fits gf ON gf.scope = 'all' LEFT JOIN power_fits lf ON lf.scope = CAST(r.year AS VARCHAR) WHERE r.scope = 'all'""")


def leaf_rows(spark, sf):
    """Items with the global and their year's bucket median and power-law prediction."""
    rows = curve_rows(spark, sf)
    curve = bucket_curve(spark, sf).withColumn("med_f7", F.round("med_f7", 6))
    fits = M.power_law(rows, ["scope"])
    base = rows.filter("scope = 'all'").withColumn("leaf", F.col("year").cast("string")).select("item_id", "year", "f7", "lv", "bucket", "leaf")
    whole, leaf = curve.filter("scope = 'all'"), curve.filter("scope <> 'all'")
    ga, gb = (fits.filter("scope = 'all'").select(c).scalar() for c in ("a", "b"))
    return (base.join(whole.select("bucket", F.col("med_f7").alias("global_med")), "bucket", "left")
            .join(leaf.select(F.col("scope").alias("leaf"), "bucket", F.col("med_f7").alias("leaf_med")), ["leaf", "bucket"], "left")
            .join(fits.filter("scope <> 'all'").select(F.col("scope").alias("leaf"), F.col("a").alias("la"), F.col("b").alias("lb")), "leaf", "left")
            .withColumn("global_log", ga + gb * F.col("lv")).withColumn("leaf_log", F.col("la") + F.col("lb") * F.col("lv")).withColumn("has_leaf", F.col("la").isNotNull()))


def flip_sql(leaf, whole):
    return f"""(SELECT count(*) FROM (SELECT item_id, row_number() OVER (ORDER BY round({leaf}, 9) DESC, item_id) AS a, row_number() OVER (ORDER BY round({whole}, 9) DESC, item_id) AS b FROM leaf_rows WHERE year BETWEEN 1996 AND 1999) WHERE (a <= 20) <> (b <= 20))"""


LEAF_I, GLOB_I = "coalesce(f7 / CASE WHEN has_leaf THEN leaf_med ELSE global_med END, 0)", "coalesce(f7 / global_med, 0)"
LEAF_R, GLOB_R = "f7 / pow(10, coalesce(leaf_log, global_log))", "f7 / pow(10, global_log)"


@query("baseline_rank_flips", ["leaf_rows"], f"SELECT kind, flips, round(flips / 20e0, 6) AS flip_rate FROM (SELECT 'bucket' AS kind, {flip_sql(LEAF_I, GLOB_I)} AS flips UNION ALL SELECT 'regression', {flip_sql(LEAF_R, GLOB_R)})")
def baseline_rank_flips(spark, sf):
    rows = leaf_rows(spark, sf).filter("year between 1996 and 1999")
    f7 = F.col("f7")
    scores = {
        ("bucket", "leaf"): F.coalesce(f7 / F.when(F.col("has_leaf"), F.col("leaf_med")).otherwise(F.col("global_med")), F.lit(0.0)),
        ("bucket", "global"): F.coalesce(f7 / F.col("global_med"), F.lit(0.0)),
        ("regression", "leaf"): f7 / F.pow(F.lit(10.0), F.coalesce("leaf_log", "global_log")),
        ("regression", "global"): f7 / F.pow(F.lit(10.0), F.col("global_log"))}
    long = rows.select("item_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("base"), F.round(s, 9).alias("s")) for (k, b), s in scores.items()])).alias("x")).select("item_id", "x.*")
    top = O.top_per_group(long, ["kind", "base"], [F.desc("s"), "item_id"], 20)
    both = top.groupBy("kind", "item_id").agg(F.count("*").alias("c"))
    return both.groupBy("kind").agg(F.count_if(F.col("c") == 1).alias("flips")).withColumn("flip_rate", F.col("flips") / 20.0)


@query("baseline_residual_ratio", ["leaf_rows"], """SELECT round(sum(el * n) / sum(n), 5) AS mse_leaf, round(sum(eg * n) / sum(n), 5) AS mse_global, round(sum(el * n) / sum(eg * n), 5) AS ratio, round(sum(rl * n) / sum(n), 5) AS mse_leaf_reg, round(sum(rg * n) / sum(n), 5) AS mse_global_reg,
  round(sum(rl * n) / sum(rg * n), 5) AS ratio_reg, round(max(abs(gi - 1)), 5) AS max_dev FROM (SELECT year, count(*) AS n, avg(pow(ln(greatest(f7, 1e-6)) - CASE WHEN leaf_med IS NOT NULL THEN ln(greatest(leaf_med, 1e-6)) END, 2)) AS el, avg(pow(ln(greatest(f7, 1e-6)) - CASE WHEN global_med IS NOT NULL THEN ln(greatest(global_med, 1e-6)) END, 2)) AS eg,
  avg(pow(log10(greatest(f7, 1e-6)) - leaf_log, 2)) AS rl, avg(pow(log10(greatest(f7, 1e-6)) - global_log, 2)) AS rg, avg(f7 / pow(10, global_log)) AS gi FROM leaf_rows WHERE has_leaf GROUP BY year)""")
def baseline_residual_ratio(spark, sf):
    def sq(x, y):
        return F.avg(F.pow(x - y, F.lit(2)))
    f7 = F.greatest("f7", F.lit(1e-6))
    years = leaf_rows(spark, sf).filter("has_leaf").groupBy("year").agg(
        F.count("*").alias("n"), sq(F.log(f7), F.when(F.col("leaf_med").isNotNull(), F.log(F.greatest("leaf_med", F.lit(1e-6))))).alias("el"),
        sq(F.log(f7), F.when(F.col("global_med").isNotNull(), F.log(F.greatest("global_med", F.lit(1e-6))))).alias("eg"),
        sq(F.log10(f7), F.col("leaf_log")).alias("rl"), sq(F.log10(f7), F.col("global_log")).alias("rg"), F.avg(F.col("f7") / F.pow(F.lit(10.0), F.col("global_log"))).alias("gi"))

    def w(c):
        return F.sum(F.col(c) * F.col("n"))
    n = F.sum("n")
    cols = {"mse_leaf": w("el") / n, "mse_global": w("eg") / n, "ratio": w("el") / w("eg"), "mse_leaf_reg": w("rl") / n, "mse_global_reg": w("rg") / n,
            "ratio_reg": w("rl") / w("rg"), "max_dev": F.max(F.abs(F.col("gi") - 1))}
    return years.agg(*[F.round(c, 5).alias(name) for name, c in cols.items()])


VEC = ("coin", "fav", "like", "danmaku", "share")
shared_sql("vectors", ["scored"], "SELECT *, CAST(round_even(lv / 0.25e0, 0) AS BIGINT) AS bucket, " + ", ".join(f"ln({v}_rate + 1e-4) AS x_{v}" for v in VEC) + " FROM scored WHERE view >= 3000")
NB = "source, bucket, year"


def vectors(spark, sf):
    return mature(spark, sf).withColumn("bucket", S.band("lv", 0.25)).withColumns({f"x_{v}": F.log(F.col(f"{v}_rate") + F.lit(1e-4)) for v in VEC})


@query("conditional_residual", ["vectors"], f"""SELECT item_id, round(residual, 5) + 0e0 AS residual FROM (SELECT item_id, n, (x_coin - mc) - b1 * (x_fav - mf) - b2 * (x_like - ml) AS residual FROM (SELECT *, CASE WHEN det > 1e-12 THEN (yu * vv - yv * uv) / det END AS b1, CASE WHEN det > 1e-12 THEN (yv * uu - yu * uv) / det END AS b2
  FROM (SELECT *, uu * vv - uv * uv AS det FROM (SELECT item_id, x_coin, x_fav, x_like, count(*) OVER w AS n, avg(x_coin) OVER w AS mc, avg(x_fav) OVER w AS mf, avg(x_like) OVER w AS ml, var_pop(x_fav) OVER w AS uu, var_pop(x_like) OVER w AS vv, covar_pop(x_fav, x_like) OVER w AS uv,
    covar_pop(x_coin, x_fav) OVER w AS yu, covar_pop(x_coin, x_like) OVER w AS yv FROM vectors WINDOW w AS (PARTITION BY {NB}))))) WHERE n >= 16""")
def conditional_residual(spark, sf):
    out = M.conditional_residual(vectors(spark, sf), ["source", "bucket", "year"], "x_coin", "x_fav", "x_like")
    return out.filter("cell_n >= 16").select("item_id", F.round("residual", 5).alias("residual"))


@query("certification_effect", ["edge_items", "inflow"], rank_sum_sql("(SELECT scored.item_id, cbi, collectors >= 2 AS is_x FROM scored JOIN inflow USING (item_id) WHERE tier = 'high' AND view >= 3000)", "", "cbi", "is_x"))
def certification_effect(spark, sf):
    highs = mature(spark, sf).filter(A.is_high()).join(inflow(spark, sf), "item_id").withColumn("is_x", F.col("collectors") >= 2)
    return ST.rank_sum(highs, [], "cbi", "is_x")


DUELS = (("q1t0", "q0t0"), ("q1t0", "q1t1"), ("q1t1", "q0t0"), ("q1t0", "q0t1"))
DUEL_SQL = "(VALUES " + ", ".join(f"('{a}>{b}', '{a}', '{b}')" for a, b in DUELS) + ") p(pair, a, b)"
shared_sql("label_scores", ["banded"], "SELECT item_id, 'q' || quality || 't' || toxic AS grp, unnest(['pct', 'cbi', 'f7']) AS score, unnest([pct, cbi, f7]) AS v FROM banded JOIN labels ON doc_id = item_id WHERE pct IS NOT NULL")
shared_sql("duel_rows", ["label_scores"], f"SELECT pair, score, grp = a AS is_x, v, item_id FROM label_scores, {DUEL_SQL} WHERE grp IN (a, b)")


@query("separation_duel", ["duel_rows"], f"""SELECT r.*, x.med_v AS med_x, y.med_v AS med_y FROM ({rank_sum_sql('duel_rows', 'pair, score', 'v', 'is_x')}) r
  LEFT JOIN (SELECT grp, score, {upper('v', 'med_v')} FROM label_scores GROUP BY grp, score) x ON x.grp = split_part(pair, '>', 1) AND x.score = r.score
  LEFT JOIN (SELECT grp, score, {upper('v', 'med_v')} FROM label_scores GROUP BY grp, score) y ON y.grp = split_part(pair, '>', 2) AND y.score = r.score""")
def separation_duel(spark, sf):
    labels = V.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("grp"))
    rows = V.banded(spark, sf).filter("pct is not null").join(labels, "item_id").select(
        "item_id", "grp", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("v")) for s in ("pct", "cbi", "f7")])).alias("x")).select("item_id", "grp", "x.*")
    pairs = F.explode(F.array_compact(F.array(*[F.when(F.col("grp").isin(a, b), F.struct(F.lit(f"{a}>{b}").alias("pair"), (F.col("grp") == a).alias("is_x"))) for a, b in DUELS]))).alias("p")
    tests = ST.rank_sum(rows.select("item_id", "score", "v", pairs).select("item_id", "score", "v", "p.*"), ["pair", "score"], "v", "is_x")
    meds = A.medians_by(rows, ["grp", "score"], ["v"], 1, "upper").drop("n")
    side = lambda i, name: meds.select(F.col("grp").alias(f"g{i}"), "score", F.col("med_v").alias(name))
    return (tests.withColumn("g1", F.split_part("pair", F.lit(">"), F.lit(1))).withColumn("g2", F.split_part("pair", F.lit(">"), F.lit(2)))
            .join(side(1, "med_x"), ["g1", "score"], "left").join(side(2, "med_y"), ["g2", "score"], "left").drop("g1", "g2"))
