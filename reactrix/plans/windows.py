"""Ranks, snapshots, picks and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import scores as S
from ..functions.stats import draw
from ..operators import aggregates as A
from ..operators import captures as C
from ..operators import rules as R
from ..operators import sampling as SM
from ..params import NAMED_FORMULAS, PICK_ROWS
from ..sources import views as V
from .aggregations import item_labels
from .projections import CUES_SQL, FLAGS_SQL, FORM_SQL, FORMS, NEAR, SIG, flagged
from .registry import query, shared_sql


def h(key, n=1 << 31):
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {n})"


@query("band_percentile", ["banded"], "SELECT item_id, band, round(pct, 6) AS pct, ref_n FROM banded")
def band_percentile(spark, sf):
    return V.banded(spark, sf).select("item_id", "band", "pct", "ref_n")


@query("percent_rank_variant", ["scored"], "SELECT item_id, round((row_number() OVER (ORDER BY f7, item_id) - 1) * 1e0 / greatest(1, count(*) OVER () - 1), 6) AS p FROM scored")
def percent_rank_variant(spark, sf):
    placed = O.positions(V.scored(spark, sf).select("item_id", "f7"), [], ["f7", "item_id"])
    return placed.select("item_id", (F.col("pos") / F.greatest(F.lit(1), F.col("group_n") - 1)).alias("p"))


@query("strict_below_over_n_minus_1", ["banded"], """SELECT item_id, round(CASE WHEN count(*) OVER b = 1 THEN 0.5e0 ELSE (rank() OVER (PARTITION BY band ORDER BY coin_rate) - 1) * 1e0 / (count(*) OVER b - 1) END, 6) AS p
  FROM banded WHERE view >= 3000 WINDOW b AS (PARTITION BY band)""")
def strict_below_over_n_minus_1(spark, sf):
    df = V.banded(spark, sf).filter("view >= 3000").select("item_id", "band", "coin_rate")
    placed = O.positions(df, ["band"], ["coin_rate", "item_id"], ties=["coin_rate"])
    return placed.select("item_id", F.when(F.col("group_n") == 1, 0.5).otherwise(F.col("tie_first") / (F.col("group_n") - 1)).alias("p"))


shared_sql("snapshots", ["captures"], """SELECT item_id, arg_max(counter, (ts, capture_id)) FILTER (complete) AS counter, arg_max(extra, (ts, capture_id)) FILTER (complete AND extra <> 0) AS extra,
  strftime(min(ts) FILTER (complete), '%Y%m%d') AS first_seen, strftime(max(ts) FILTER (complete), '%Y%m%d') AS last_seen, count(*) FILTER (complete) AS captures FROM captures GROUP BY item_id HAVING count(*) FILTER (complete) > 0""")


@query("latest_snapshot_merge", ["snapshots"], "SELECT item_id, round(counter, 6) AS counter, extra, first_seen, last_seen, captures FROM snapshots")
def latest_snapshot_merge(spark, sf):
    return C.latest_snapshot(V.captures(spark, sf))


@query("last_file_wins_merge", ["captures"], """SELECT item_id, round(arg_max(counter, (strftime(ts, '%Y%m%d'), capture_id)), 6) AS counter, arg_max(event_type, (strftime(ts, '%Y%m%d'), capture_id)) AS event_type, count(DISTINCT event_type) AS kinds FROM captures GROUP BY item_id""")
def last_file_wins_merge(spark, sf):
    key = F.struct(F.date_format("ts", "yyyyMMdd"), "capture_id")
    last = F.max_by(F.struct("counter", "event_type"), key).alias("r")
    return V.captures(spark, sf).groupBy("item_id").agg(last, F.countDistinct("event_type").alias("kinds")).select("item_id", "r.counter", "r.event_type", "kinds")


LAYERS = ("purchase", "signup", "click", "view", "error")
LAYER_SQL = "list_position(['purchase', 'signup', 'click', 'view', 'error'], event_type)"


@query("layered_best_record", ["captures"], f"SELECT item_id, CAST(min({LAYER_SQL}) AS BIGINT) AS layer, arg_min(capture_id, ({LAYER_SQL}, ts, capture_id)) AS capture_id FROM captures GROUP BY item_id")
def layered_best_record(spark, sf):
    layer = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("event_type"))
    return V.captures(spark, sf).withColumn("layer", layer).groupBy("item_id").agg(
        F.min("layer").alias("layer"), F.min_by("capture_id", F.struct("layer", "ts", "capture_id")).alias("capture_id"))


shared_sql("pick_pool", ["scored"], f"""SELECT item_id, owner_id, {FORM_SQL} AS form, CASE WHEN contains(source, 'AUTO') THEN 0 WHEN contains(source, 'BUILD') THEN 1 WHEN contains(source, 'FURN') THEN 2 ELSE 3 END AS src_rank,
  contains(title, 'hot') AS cue, -coin * 1e0 / view AS neg_ratio FROM scored WHERE duration > 150 AND view >= 30000""")
PICK_ORDER = ("src_rank", "cue", "neg_ratio")


def pick_steps(count=5, per_form=2):
    """The greedy written as one CTE per pick."""
    steps = []
    for i in range(1, count + 1):
        prior = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, i))
        guard = f"WHERE owner_id NOT IN (SELECT owner_id FROM ({prior})) AND form NOT IN (SELECT form FROM ({prior}) GROUP BY form HAVING count(*) >= {per_form})" if prior else ""
        steps.append(f"p{i} AS MATERIALIZED (SELECT item_id, form, owner_id, {i} AS slot FROM pick_pool {guard} ORDER BY src_rank, cue, neg_ratio, item_id LIMIT 1)")
    return ", " + ", ".join(steps) + "\n" + " UNION ALL ".join(f"SELECT item_id, form, owner_id, CAST(slot AS BIGINT) AS slot FROM p{i}" for i in range(1, count + 1))


@query("greedy_diverse_picks", ["pick_pool"], pick_steps())
def greedy_diverse_picks(spark, sf):
    src = F.col("source")
    rank = F.when(src.contains("AUTO"), 0).when(src.contains("BUILD"), 1).when(src.contains("FURN"), 2).otherwise(3)
    pool = V.scored(spark, sf).filter("duration > 150 and view >= 30000").select(
        "item_id", "owner_id", R.first_pattern("title", FORMS, "other").alias("form"), rank.alias("src_rank"),
        F.col("title").contains("hot").alias("cue"), (-F.col("coin") / F.col("view")).alias("neg_ratio"))
    return SM.greedy_picks(pool, PICK_ORDER)


@query("creator_round_robin", ["banded"], """WITH_X SELECT item_id, owner_id, CAST(least(rn, 3) AS BIGINT) AS round, row_number() OVER (ORDER BY least(rn, 3), CASE WHEN rn <= 2 THEN first_pos ELSE pos END) AS slot FROM (
  SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY pos) AS rn, min(pos) OVER (PARTITION BY owner_id) AS first_pos FROM (SELECT item_id, owner_id, row_number() OVER (ORDER BY round(pct, 6) DESC, item_id) AS pos FROM banded WHERE pct >= 0.85e0))""".replace("WITH_X ", ""))
def creator_round_robin(spark, sf):
    df = V.banded(spark, sf).filter("pct >= 0.85").select("item_id", "owner_id", (-F.round("pct", 6)).alias("neg"))
    return SM.round_robin(df, ["neg"])


shared_sql("stream_rows", ["flagged"], """SELECT *, strftime(pub_ts, '%Y%m%d') AS day, flags = '' AS eligible FROM flagged""")


@query("daily_streams", ["stream_rows"], """WITH_X SELECT stream, count(*) AS n, arg_min(item_id, (k, item_id)) AS first_item FROM (
  SELECT 'daily' AS stream, item_id, -view AS k FROM stream_rows WHERE eligible AND day = (SELECT max(day) FROM stream_rows)
  UNION ALL SELECT 'archive', item_id, item_id FROM stream_rows UNION ALL SELECT 'day:' || day, item_id, -view FROM stream_rows WHERE eligible
  UNION ALL SELECT * FROM (SELECT 'picks', item_id, round(-pct, 6) FROM stream_rows WHERE eligible AND pct >= 0.85e0 AND ref_n >= 30 ORDER BY round(-pct, 6), item_id LIMIT 600)) GROUP BY stream""".replace("WITH_X ", ""))
def daily_streams(spark, sf):
    df = flagged(spark, sf).withColumn("day", F.date_format("pub_ts", "yyyyMMdd")).withColumn("eligible", F.size("screen_flags") == 0)
    latest = df.agg(F.max("day").alias("d")).scalar()
    view = (-F.col("view")).cast("double")
    tags = F.array_compact(F.array(
        F.when(F.col("eligible") & (F.col("day") == latest), F.struct(F.lit("daily").alias("stream"), view.alias("k"))),
        F.struct(F.lit("archive").alias("stream"), F.col("item_id").cast("double").alias("k")),
        F.when(F.col("eligible"), F.struct(F.concat(F.lit("day:"), "day").alias("stream"), view.alias("k")))))
    rows = df.select("item_id", F.explode(tags).alias("t")).select("item_id", "t.*")
    picks = df.filter("eligible and pct >= 0.85 and ref_n >= 30").select("item_id", F.lit("picks").alias("stream"), F.round(-F.col("pct"), 6).alias("k")).orderBy("k", "item_id").limit(PICK_ROWS)
    return rows.unionByName(picks).groupBy("stream").agg(F.count("*").alias("n"), F.min_by("item_id", F.struct("k", "item_id")).alias("first_item"))


shared_sql("approvals", [], "SELECT l_orderkey AS item_id, l_linenumber AS seq, strftime(l_shipdate, '%Y%m%d') AS admitted_on, l_linestatus AS note, l_linenumber % 2 = 0 AS number_checked FROM lineitem WHERE l_returnflag = 'A'")
shared_sql("approved_rows", ["approvals", "flagged"], """SELECT item_id, admitted_on, note FROM (SELECT a.*, row_number() OVER (PARTITION BY item_id ORDER BY seq, admitted_on, note) AS rn FROM approvals a JOIN flagged USING (item_id)
  WHERE duration > 150 AND (flags = '' OR (flags = 'interaction_review' AND number_checked))) WHERE rn = 1""")


@query("approved_streams", ["approved_rows"], "SELECT item_id, admitted_on, note, item_id IN (SELECT item_id FROM approved_rows ORDER BY admitted_on DESC, item_id LIMIT 9) AS latest FROM approved_rows")
def approved_streams(spark, sf):
    lines = V.table(spark, sf, "lineitem").filter("l_returnflag = 'A'")
    approvals = lines.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("seq"), F.date_format("l_shipdate", "yyyyMMdd").alias("admitted_on"),
                             F.col("l_linestatus").alias("note"), (F.col("l_linenumber") % 2 == 0).alias("number_checked"))
    rows = flagged(spark, sf).filter("duration > 150").select("item_id", "screen_flags")
    return C.approved_streams(approvals, rows, excused="interaction_review")


@query("systematic_sample", ["scored"], """SELECT item_id, source, CAST(floor(pos / step) + 1 AS BIGINT) AS slot FROM (SELECT *, greatest(1, floor(n / 40e0)) AS step FROM (SELECT item_id, source, row_number() OVER (PARTITION BY source ORDER BY item_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM scored))
  WHERE pos % step = 0 AND floor(pos / step) < 40""")
def systematic_sample(spark, sf):
    return SM.systematic(V.scored(spark, sf), "source", 40)


STRATA = (("anchor_good", "quality = 1", 3), ("anchor_poor", "quality = 0", 2), ("top", "quality IS NULL AND pct >= 0.93e0", 10), ("edge_top", "quality IS NULL AND pct >= 0.85e0 AND pct < 0.93e0", 12),
          ("edge_fine", "quality IS NULL AND pct >= 0.72e0 AND pct < 0.85e0", 10), ("edge_plain", "quality IS NULL AND pct < 0.72e0", 8), ("short_conflict", "quality IS NULL AND pct >= 0.93e0 AND duration < 90", 5),
          ("hoard_conflict", "quality IS NULL AND pct >= 0.93e0 AND fav_rate > 8 * coin_rate AND fav_rate > 0.15e0", 5), ("signature", f"quality IS NULL AND {SIG}", 5),
          ("home", "quality IS NULL AND source = 'AUTOMOBILE'", 8), ("control", "quality IS NULL", 7))
STRATA_SQL = " UNION ALL ".join(
    f"SELECT item_id, {i} AS no, '{n}' AS stratum FROM (SELECT item_id, row_number() OVER (ORDER BY {'-pct' if n == 'top' else h(chr(39) + 'screen:' + n + ':' + chr(39) + ' || item_id')}, item_id) AS rn FROM with_labels WHERE pct IS NOT NULL AND {c}) WHERE rn <= {q}"
    for i, (n, c, q) in enumerate(STRATA))
shared_sql("with_labels", ["banded"], "SELECT banded.*, quality FROM banded LEFT JOIN labels ON doc_id = item_id")


@query("stratified_screen_sample", ["with_labels"], f"SELECT item_id, arg_min(stratum, no) AS stratum FROM ({STRATA_SQL}) GROUP BY item_id")
def stratified_screen_sample(spark, sf):
    labels = V.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    df = V.banded(spark, sf).filter("pct is not null").join(labels, "item_id", "left")
    strata = [(n, F.expr(c.replace("e0", "D")), q, -F.col("pct") if n == "top" else None) for n, c, q in STRATA]
    return SM.stratified(df, strata, "screen")


shared_sql("batch_rows", ["flagged"], f"SELECT *, {h(chr(39) + 'a:' + chr(39) + ' || item_id')} AS h, {h(chr(39) + 'b:' + chr(39) + ' || item_id')} AS h2 FROM flagged")


def capped_sql(name, cond, order, count, taken):
    guard = f"AND item_id NOT IN (SELECT item_id FROM ({taken}))" if taken else ""
    room = f"2 - coalesce((SELECT count(*) FROM ({taken}) t WHERE t.owner_id = x.owner_id), 0)" if taken else "2"
    return f"""{name} AS MATERIALIZED (SELECT item_id, owner_id FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY {order}, item_id) AS k FROM batch_rows WHERE {cond} {guard}) x WHERE k <= {room} ORDER BY {order}, item_id LIMIT {count})"""


@query("review_batch", ["batch_rows"], ", " + ", ".join((
    capped_sql("b1", "cues = '' AND flags = '' AND ref_n >= 30 AND pct IS NOT NULL", "pct DESC, h", 12, None),
    capped_sql("b2", "cues <> ''", "pct DESC NULLS LAST, h", 6, "SELECT * FROM b1"),
    capped_sql("b3", "TRUE", "h2", 6, "SELECT * FROM b1 UNION ALL SELECT * FROM b2"))) + " SELECT item_id, owner_id, 'recall' AS arm FROM b1 UNION ALL SELECT item_id, owner_id, 'motive_check' FROM b2 UNION ALL SELECT item_id, owner_id, 'explore' FROM b3")
def review_batch(spark, sf):
    df = flagged(spark, sf).select("item_id", "owner_id", "pct", "ref_n", "motive_cues", "screen_flags",
                                   draw(F.concat(F.lit("a:"), "item_id"), 1 << 31).alias("h"), draw(F.concat(F.lit("b:"), "item_id"), 1 << 31).alias("h2"))
    return SM.review_batch(df)


DUR_BUCKET = "CASE WHEN duration <= 200 THEN 'short' WHEN duration <= 600 THEN 'middle' ELSE 'long' END"
QUOTAS = {"A": 6, "B": 6, "C": 8, "D": 12, "E": 10, "F": 6, "G": 12}
QUOTA_SQL = "CASE cell " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUOTAS.items()) + " END"


@query("cell_quota_sample", ["cells"], f"""SELECT 'sample' AS kind, cell AS grp, item_id FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {h("'blind:' || item_id")}, item_id) AS rn FROM cells WHERE cell IS NOT NULL AND item_id NOT IN (SELECT doc_id FROM labels)) WHERE rn <= {QUOTA_SQL}
  UNION ALL SELECT 'seed', grp, item_id FROM (SELECT item_id, grp, row_number() OVER (PARTITION BY grp ORDER BY sinc, item_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT item_id, coin * 1e0 / fav AS sinc, CASE WHEN {NEAR} = 'signature' THEN {DUR_BUCKET} ELSE {NEAR} END AS grp FROM cells WHERE fav > 0 AND {NEAR} <> 'none')) WHERE pos = n // 2""")
def cell_quota_sample(spark, sf):
    df = V.scored(spark, sf).withColumn("cell", R.review_cell()).withColumn("near", R.near_miss())
    reviewed = V.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    sample = SM.cell_quotas(df.join(reviewed, "item_id", "left_anti"), QUOTAS, "blind").select(F.lit("sample").alias("kind"), F.col("cell").alias("grp"), "item_id")
    bucket = F.when(F.col("duration") <= 200, "short").when(F.col("duration") <= 600, "middle").otherwise("long")
    near = df.filter("fav > 0 and near <> 'none'").select("item_id", F.when(F.col("near") == "signature", bucket).otherwise(F.col("near")).alias("grp"), (F.col("coin") / F.col("fav")).alias("sinc"))
    return sample.unionByName(A.row_at_median(near, ["grp"], "sinc").select(F.lit("seed").alias("kind"), "grp", "item_id"))


shared_sql("seed_pool", ["banded"], f"SELECT item_id, {FORM_SQL} AS form, pct FROM banded JOIN labels ON doc_id = item_id WHERE quality = 1 AND pct IS NOT NULL")


@query("bucket_seed_pick", ["seed_pool"], """, best AS MATERIALIZED (SELECT item_id, form, pct, 1 AS round FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY pct DESC, item_id) AS rn FROM seed_pool) WHERE rn = 1 ORDER BY pct DESC, item_id LIMIT 8)
  SELECT 'refilled' AS variant, item_id, form, round(pct, 6) AS pct, CAST(round AS BIGINT) AS round FROM (SELECT * FROM best UNION ALL SELECT item_id, form, pct, 2 FROM seed_pool WHERE item_id NOT IN (SELECT item_id FROM best) ORDER BY round, pct DESC, item_id LIMIT 8)
  UNION ALL SELECT * FROM (SELECT 'excluding', item_id, form, round(pct, 6), 1 FROM seed_pool WHERE item_id NOT IN (SELECT item_id FROM best) ORDER BY pct DESC, item_id LIMIT 6)""")
def bucket_seed_pick(spark, sf):
    labels = V.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("item_id"))
    pool = V.banded(spark, sf).filter("pct is not null").join(labels, "item_id").select("item_id", R.first_pattern("title", FORMS, "other").alias("form"), "pct")
    seeds = SM.seeds_by_bucket(pool, "form", "pct", 8)
    other = pool.join(seeds.filter("round = 1").select("item_id"), "item_id", "left_anti").orderBy(F.desc("pct"), "item_id").limit(6).withColumn("round", F.lit(1))
    return seeds.withColumn("variant", F.lit("refilled")).unionByName(other.withColumn("variant", F.lit("excluding")))


NAMED_SQL = "(VALUES " + ", ".join(f"('{n}', {f}e0, {c}e0, {l}e0, '{d}')" for n, f, c, l, d in NAMED_FORMULAS) + ") w(formula, wf, wc, wl, denom)"


@query("bottom_k_composition", ["scored"], f"""SELECT formula, source, count(*) AS n, min(rn) AS best_place FROM (SELECT formula, source, row_number() OVER (PARTITION BY formula ORDER BY (wf * fav + wc * coin + wl * like_cnt) / CASE denom WHEN 'view' THEN greatest(view, 1) WHEN 'sqrt' THEN sqrt(greatest(view, 1)) ELSE log10(greatest(view, 10)) END, item_id) AS rn
  FROM scored, {NAMED_SQL}) WHERE rn <= 50 GROUP BY formula, source""")
def bottom_k_composition(spark, sf):
    grid = F.array(*[F.struct(F.lit(n).alias("formula"), S.weighted_ratio(d, (f, c, l)).alias("score")) for n, f, c, l, d in NAMED_FORMULAS])
    long = V.scored(spark, sf).select("item_id", "source", F.explode(grid).alias("x")).select("item_id", "source", "x.*")
    return O.top_per_group(long, ["formula"], ["score", "item_id"], 50).groupBy("formula", "source").agg(F.count("*").alias("n"), F.min("rn").alias("best_place"))


BOOST_SQL = f"{h(chr(39) + 'boost:' + chr(39) + ' || item_id', 5)} = 0"
shared_sql("boosted", ["scored"], f"SELECT *, {BOOST_SQL} AS hit, (3e0 * fav + 2e0 * CASE WHEN {BOOST_SQL} THEN CAST(floor(coin * 1.8e0 + 10) AS BIGINT) ELSE coin END + 0.3e0 * like_cnt) / view / base AS cbi_after FROM scored WHERE view >= 3000")


def boosted(spark, sf):
    """A hash-chosen fifth of the rows gets coin x 1.8 + 10."""
    hit = draw(F.concat(F.lit("boost:"), "item_id"), 5) == 0
    return V.scored(spark, sf).filter("view >= 3000").withColumn("hit", hit).withColumn(
        "coin_after", F.when(hit, F.floor(F.col("coin") * 1.8 + 10)).otherwise(F.col("coin"))).withColumn("cbi_after", S.f7(coin="coin_after") / F.col("base"))


@query("rank_and_rank_gain", ["boosted"], """SELECT item_id, hit, a AS rank_before, b AS rank_after, a - b AS gain FROM (SELECT item_id, hit, row_number() OVER (ORDER BY round(cbi, 9) DESC, item_id) - 1 AS a, row_number() OVER (ORDER BY round(cbi_after, 9) DESC, item_id) - 1 AS b FROM boosted)""")
def rank_and_rank_gain(spark, sf):
    df = boosted(spark, sf).select("item_id", "hit", F.round("cbi", 9).alias("x"), F.round("cbi_after", 9).alias("y"))
    first = O.positions(df, [], [F.desc("x"), "item_id"]).withColumnRenamed("pos", "rank_before").drop("group_n")
    both = O.positions(first, [], [F.desc("y"), "item_id"]).withColumnRenamed("pos", "rank_after")
    return both.select("item_id", "hit", "rank_before", "rank_after", (F.col("rank_before") - F.col("rank_after")).alias("gain"))


shared_sql("chains", ["items"], "SELECT owner_id, epoch(pub_ts) AS t, pub_ts, category, row_number() OVER (PARTITION BY owner_id ORDER BY item_id) AS a, row_number() OVER (PARTITION BY owner_id ORDER BY item_id DESC) AS d, count(*) OVER (PARTITION BY owner_id) AS n FROM items")


@query("chain_drift", ["chains"], """SELECT owner_id, n, round(drift, 6) AS drift_months, CASE WHEN drift < 0 THEN 'back' ELSE 'forward' END AS direction, row_number() OVER (ORDER BY round(drift, 6), owner_id) <= 3 AS most_negative FROM (
  SELECT owner_id, any_value(n) AS n, (median(t) FILTER (d <= 3) - median(t) FILTER (a <= 3)) / 86400e0 / 30e0 AS drift FROM chains WHERE n >= 4 GROUP BY owner_id)""")
def chain_drift(spark, sf):
    df = V.items(spark, sf).select("owner_id", "item_id", F.unix_timestamp("pub_ts").alias("t"))
    n = df.groupBy("owner_id").agg(F.count("*").alias("n")).filter("n >= 4")

    def middle(order):
        return O.top_per_group(df, ["owner_id"], order, 3).groupBy("owner_id").agg(F.percentile("t", 0.5).alias("m"))  # three values

    out = n.join(middle(["item_id"]).withColumnRenamed("m", "head"), "owner_id").join(middle([F.desc("item_id")]).withColumnRenamed("m", "tail"), "owner_id")
    out = out.select("owner_id", "n", F.round((F.col("tail") - F.col("head")) / 86400.0 / 30.0, 6).alias("drift_months"))
    low = out.orderBy("drift_months", "owner_id").limit(3).select("owner_id", F.lit(True).alias("m"))
    return out.join(low, "owner_id", "left").select("owner_id", "n", "drift_months", F.when(F.col("drift_months") < 0, "back").otherwise("forward").alias("direction"), F.coalesce("m", F.lit(False)).alias("most_negative"))


@query("timeline_span", ["items"], """SELECT owner_id, 'chain' AS hop, strftime(min(pub_ts), '%Y-%m') AS first_month, strftime(max(pub_ts), '%Y-%m') AS last_month FROM items GROUP BY owner_id
  UNION ALL SELECT owner_id, category, strftime(min(pub_ts), '%Y-%m'), strftime(max(pub_ts), '%Y-%m') FROM items GROUP BY owner_id, category""")
def timeline_span(spark, sf):
    hops = V.items(spark, sf).groupBy("owner_id", F.col("category").alias("hop")).agg(F.min("pub_ts").alias("a"), F.max("pub_ts").alias("b"))
    chain = hops.groupBy("owner_id").agg(F.lit("chain").alias("hop"), F.min("a").alias("a"), F.max("b").alias("b"))
    return hops.unionByName(chain).select("owner_id", "hop", F.date_format("a", "yyyy-MM").alias("first_month"), F.date_format("b", "yyyy-MM").alias("last_month"))
