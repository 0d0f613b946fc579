"""Joins, set operations and graph flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import stats as ST
from ..functions import titles as T
from ..functions.stats import draw
from ..operators import aggregates as A
from ..operators import catalog as K
from ..operators import graph as G
from ..operators import rules as R
from ..params import CHAIN_SEEDS, DRIVER, MAIN_USERS, PROBES
from ..session import shared_table
from ..sources import views as V
from .aggregations import HIGH, edge_items, inflow, mature, med
from .fits import bootstrap, rank_sum_sql
from .projections import TITLE_FLAG_SQL, CUES_SQL, FLAGS_SQL, NEAR, SCREEN, TIERS, flagged, ptier_sql, ptiers
from .registry import query, shared_sql
from .windows import h

shared_sql("flow", ["inflow", "scored"], "SELECT scored.*, collectors FROM inflow JOIN scored USING (item_id)")


def flow(spark, sf):
    return V.scored(spark, sf).join(inflow(spark, sf), "item_id")


@query("bipartite_edges", ["edge_items"], "SELECT DISTINCT user_id, item_id FROM edge_items WHERE view >= 3000")
def bipartite_edges(spark, sf):
    return V.edges(spark, sf).select("user_id", "item_id").distinct().join(mature(spark, sf).select("item_id"), "item_id", "left_semi")


SEED_SQL = f"SELECT item_id, collectors, cbi FROM flow WHERE {HIGH} AND collectors >= 3 ORDER BY collectors DESC, round(cbi, 6) DESC, item_id LIMIT "
shared_sql("seeds18", ["flow"], SEED_SQL + "18")


def confluence(spark, sf, n: int | None = 18):
    """High items that at least three users collected: the first n, or all of them."""
    found = flow(spark, sf).filter(A.is_high() & (F.col("collectors") >= 3))
    return found if n is None else found.orderBy(F.desc("collectors"), F.desc(F.round("cbi", 6)), "item_id").limit(n)


@query("confluence_seeds", ["seeds18"], "SELECT item_id, collectors, round(cbi, 6) AS cbi FROM seeds18")
def confluence_seeds(spark, sf):
    return confluence(spark, sf).select("item_id", "collectors", "cbi")


def fill_sql(mode, order, cond="TRUE"):
    return f"SELECT * FROM (SELECT '{mode}' AS mode, item_id, round(cbi, 6) AS cbi FROM flow WHERE {HIGH} AND {cond} AND item_id NOT IN (SELECT item_id FROM seeds18) ORDER BY {order}, item_id LIMIT 12)"


@query("seed_fill", ["seeds18"], " UNION ALL ".join((fill_sql("index", "round(cbi, 6) DESC"), fill_sql("random", h("'fill:' || item_id")), fill_sql("mid_band", "round(cbi, 6) DESC", "cbi >= 6 AND cbi < 12"))))
def seed_fill(spark, sf):
    """Fill 18 seeds up to 30: by index, by hash, or by index inside [6, 12)."""
    rest = flow(spark, sf).filter(A.is_high()).join(confluence(spark, sf).select("item_id"), "item_id", "left_anti").select("item_id", "cbi")
    by_index, rnd = F.desc(F.round("cbi", 6)), draw(F.concat(F.lit("fill:"), "item_id"), 1 << 31)
    parts = [("index", rest, by_index), ("random", rest, rnd), ("mid_band", rest.filter("cbi >= 6 and cbi < 12"), by_index)]
    out = [df.orderBy(o, "item_id").limit(12).withColumn("mode", F.lit(m)) for m, df, o in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


shared_sql("strengths", ["flow", "edges"], f"""SELECT user_id, sum(greatest(3, round(cbi, 6))) AS strength, count(*) AS seeds FROM (SELECT DISTINCT user_id, item_id FROM edges WHERE arm = 'N') JOIN (SELECT item_id, cbi FROM flow WHERE {HIGH} AND collectors >= 3) USING (item_id)
  WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY user_id""")


@query("user_flow_strength", ["strengths"], f""", main AS MATERIALIZED (SELECT * FROM strengths ORDER BY round(strength, 6) DESC, user_id LIMIT 20)
  SELECT 'main' AS kind, user_id, round(strength, 6) AS strength, seeds FROM main UNION ALL SELECT * FROM (SELECT 'probe', user_id, round(strength, 6), seeds FROM strengths WHERE user_id NOT IN (SELECT user_id FROM main) ORDER BY {h("'probe:' || user_id")}, user_id LIMIT 7)""")
def user_flow_strength(spark, sf):
    """Seeds meet the users who touched them; strength sums max(3, seed index); mined users are out; probes come from the pruned."""
    seeds = confluence(spark, sf, None).select("item_id", F.greatest(F.lit(3.0), F.round("cbi", 6)).alias("w"))
    mined = V.table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"))
    touched = V.edges(spark, sf).filter("arm = 'N'").select("user_id", "item_id").distinct().join(seeds, "item_id")
    users = touched.join(mined, "user_id", "left_anti").groupBy("user_id").agg(F.sum("w").alias("strength"), F.count("*").alias("seeds"))
    main = users.orderBy(F.desc(F.round("strength", 6)), "user_id").limit(MAIN_USERS)
    probes = users.join(main.select("user_id"), "user_id", "left_anti").orderBy(draw(F.concat(F.lit("probe:"), "user_id"), 1 << 31), "user_id").limit(PROBES)
    return main.withColumn("kind", F.lit("main")).unionByName(probes.withColumn("kind", F.lit("probe")))


shared_sql("quality_rows", ["flow"], f"SELECT item_id, cbi, collectors >= 2 AS is_x FROM flow WHERE {HIGH} AND view >= 3000")


@query("confluence_quality", ["quality_rows"], f"""SELECT r.n_x AS n_many, r.n_y AS n_one, r.z, m.mean_many, m.mean_one FROM ({rank_sum_sql('quality_rows', '', 'cbi', 'is_x')}) r, (SELECT round(avg(cbi) FILTER (is_x), 6) AS mean_many, round(avg(cbi) FILTER (NOT is_x), 6) AS mean_one FROM quality_rows) m""")
def confluence_quality(spark, sf):
    rows = flow(spark, sf).filter(A.is_high() & (F.col("view") >= 3000)).withColumn("is_x", F.col("collectors") >= 2)
    means = rows.agg(F.avg(F.when(F.col("is_x"), F.col("cbi"))).alias("a"), F.avg(F.when(~F.col("is_x"), F.col("cbi"))).alias("b"))
    return ST.rank_sum(rows, [], "cbi", "is_x").select(F.col("n_x").alias("n_many"), F.col("n_y").alias("n_one"), "z", means.select("a").scalar().alias("mean_many"), means.select("b").scalar().alias("mean_one"))


@query("layer_novelty", ["edges"], """SELECT arm, count(*) AS n, count(*) FILTER (first = no) AS novel, round(count(*) FILTER (first = no) * 1e0 / count(*), 6) AS novelty, count(*) FILTER (prev) AS shared_prev, round(count(*) FILTER (prev) * 1e0 / count(*), 6) AS shared_share FROM (
  SELECT arm, no, min(no) OVER (PARTITION BY item_id) AS first, lag(no) OVER (PARTITION BY item_id ORDER BY no) = no - 1 AS prev FROM (SELECT DISTINCT item_id, arm, list_position(['A', 'N', 'R'], arm) AS no FROM edges)) GROUP BY arm""")
def layer_novelty(spark, sf):
    """Layers in order; an item's layers are a set of at most three, so everything is one aggregation per item."""
    no = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("arm"))
    items = V.edges(spark, sf).groupBy("item_id").agg(F.collect_set(no).alias("layers"))
    rows = items.select("layers", F.array_min("layers").alias("first"), F.explode("layers").alias("no"))
    prev = F.array_contains("layers", F.col("no") - 1)
    return rows.groupBy("no").agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("no")).alias("novel"), A.share(F.col("first") == F.col("no")).alias("novelty"),
                                  F.count_if(prev).alias("shared_prev"), A.share(prev).alias("shared_share")).withColumn(
        "arm", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("no").cast("int"))).drop("no")


@query("top_confluence", ["flow"], f"""SELECT * FROM (SELECT 'top' AS kind, item_id, collectors FROM flow WHERE collectors >= 2 ORDER BY collectors DESC, item_id LIMIT 10) UNION ALL SELECT 'keyword', item_id, collectors FROM flow WHERE {HIGH} AND contains(title, 'hot gizmo')""")
def top_confluence(spark, sf):
    df = flow(spark, sf)
    top = df.filter("collectors >= 2").orderBy(F.desc("collectors"), "item_id").limit(10).withColumn("kind", F.lit("top"))
    word = df.filter(A.is_high() & F.col("title").contains("hot gizmo")).withColumn("kind", F.lit("keyword"))
    return top.unionByName(word).select("kind", "item_id", "collectors")


@query("provenance_catalog", ["flow", "edges"], """SELECT f.item_id, a.arms, f.collectors, CASE WHEN fav > coin THEN 'archive' ELSE 'expression' END AS shape, CASE WHEN toxic = 1 THEN 'edge' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END AS verdict,
  f.cbi >= 10 AS ten_fold FROM flow f JOIN (SELECT item_id, string_agg(arm, '+' ORDER BY arm) AS arms FROM (SELECT DISTINCT item_id, arm FROM edges) GROUP BY item_id) a USING (item_id) LEFT JOIN labels ON doc_id = f.item_id""")
def provenance_catalog(spark, sf):
    arms = V.edges(spark, sf).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("arm")), "+").alias("arms"), F.countDistinct("user_id").alias("collectors"))
    verdict = F.when(F.col("toxic") == 1, "edge").when(F.col("quality") == 1, "good").otherwise("poor")
    labels = V.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), verdict.alias("verdict"))
    return V.scored(spark, sf).join(arms, "item_id").join(labels, "item_id", "left").select(
        "item_id", "arms", "collectors", F.when(F.col("fav") > F.col("coin"), "archive").otherwise("expression").alias("shape"), "verdict", (F.col("cbi") >= 10).alias("ten_fold"))


@query("candidate_pool_overlap", ["edge_items"], """WITH_X SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS shared, round(count(*) * 1e0 / (SELECT count(*) FROM (SELECT DISTINCT arm, user_id FROM edge_items WHERE cbi >= 14) z WHERE z.arm = b.arm), 6) AS share_of_later
  FROM (SELECT DISTINCT arm, user_id FROM edge_items WHERE cbi >= 14) a JOIN (SELECT DISTINCT arm, user_id FROM edge_items WHERE cbi >= 14) b ON a.user_id = b.user_id AND a.arm < b.arm GROUP BY a.arm, b.arm""".replace("WITH_X ", ""))
def candidate_pool_overlap(spark, sf):
    pools = edge_items(spark, sf).filter("cbi >= 14").groupBy("user_id").agg(F.array_sort(F.collect_set("arm")).alias("arms"))
    sizes = pools.select(F.explode("arms").alias("arm_b")).groupBy("arm_b").agg(F.count("*").alias("size"))
    pairs = pools.select("arms", F.explode("arms").alias("arm_a")).select("arm_a", F.explode(F.filter("arms", lambda b: b > F.col("arm_a"))).alias("arm_b"))
    return pairs.groupBy("arm_a", "arm_b").agg(F.count("*").alias("shared")).join(sizes, "arm_b").select("arm_a", "arm_b", "shared", A.ratio(F.col("shared"), F.col("size")).alias("share_of_later"))


shared_sql("seed_types", ["flow"], f"SELECT item_id, cbi, collectors >= 6 AS confluence FROM flow WHERE {HIGH} AND (collectors >= 6 OR cbi >= 13)")


@query("seed_type_stratified_rate", ["seed_types", "edge_items"], f"""SELECT u.grp, u.users, u.high_rate, u.items_per_user, s.seeds, s.mean_index, s.min_index, s.max_index FROM (SELECT grp, count(*) AS users, round(sum(h) * 1e0 / sum(n), 6) AS high_rate, round(avg(n * 1e0), 6) AS items_per_user FROM (
    SELECT user_id, CASE WHEN coalesce(any_value(t.confluence) FILTER (t.confluence), FALSE) THEN 'confluence' WHEN count(t.item_id) > 0 THEN 'filled' END AS grp, count(*) AS n, count(*) FILTER ({HIGH}) AS h FROM edge_items e LEFT JOIN seed_types t USING (item_id) WHERE arm = 'R' AND view >= 3000 GROUP BY user_id) WHERE grp IS NOT NULL GROUP BY grp) u
  JOIN (SELECT CASE WHEN confluence THEN 'confluence' ELSE 'filled' END AS grp, count(*) AS seeds, round(avg(cbi), 6) AS mean_index, round(min(cbi), 6) AS min_index, round(max(cbi), 6) AS max_index FROM seed_types GROUP BY 1) s USING (grp)""")
def seed_type_stratified_rate(spark, sf):
    seeds = flow(spark, sf).filter(A.is_high() & ((F.col("collectors") >= 6) | (F.col("cbi") >= 13))).select("item_id", "cbi", (F.col("collectors") >= 6).alias("confluence"))
    users = edge_items(spark, sf).filter("arm = 'R' and view >= 3000").join(seeds.select("item_id", "confluence"), "item_id", "left").groupBy("user_id").agg(
        F.when(F.max("confluence"), "confluence").when(F.count("confluence") > 0, "filled").alias("grp"), F.count("*").alias("n"), F.count_if(A.is_high()).alias("h")).filter("grp is not null")
    types = seeds.groupBy(F.when(F.col("confluence"), "confluence").otherwise("filled").alias("grp")).agg(
        F.count("*").alias("seeds"), F.avg("cbi").alias("mean_index"), F.min("cbi").alias("min_index"), F.max("cbi").alias("max_index"))
    return users.groupBy("grp").agg(F.count("*").alias("users"), A.ratio(F.sum("h"), F.sum("n")).alias("high_rate"), F.avg("n").alias("items_per_user")).join(types, "grp")


CUT = f"TIMESTAMP '{DRIVER.reference_cutoff}'"
shared_sql("neighbours", ["related", "banded"], "SELECT r.src, r.dst, t.coin_rate AS target_rate, b.coin_rate, b.pub_ts, b.view FROM related r JOIN banded b ON b.item_id = r.dst JOIN banded t ON t.item_id = r.src")


@query("reference_overlap", ["neighbours"], f"""SELECT src, count(*) AS n, count(*) FILTER (pub_ts >= {CUT}) AS outside, round(count(*) FILTER (pub_ts >= {CUT}) * 1e0 / count(*), 6) AS outside_share, count(*) FILTER (pub_ts >= {CUT} AND view >= 3000) AS outside_mature FROM neighbours GROUP BY src""")
def reference_overlap(spark, sf):
    """Links of an item to items of its parts, and how many lead outside the frozen reference: totals per part, less the item itself."""
    late = F.col("pub_ts") >= F.lit(DRIVER.reference_cutoff).cast("timestamp")
    nodes = V.banded(spark, sf).select(F.col("item_id").alias("item"), late.cast("long").alias("out"), (late & (F.col("view") >= 3000)).cast("long").alias("grown"))
    rows = V.members(spark, sf).join(nodes, "item")
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("out").alias("outs"), F.sum("grown").alias("growns")).filter("n > 1")
    totals = rows.join(parts, "part").groupBy(F.col("item").alias("src")).agg(
        F.sum(F.col("n") - 1).alias("n"), F.sum(F.col("outs") - F.col("out")).alias("outside"), F.sum(F.col("growns") - F.col("grown")).alias("outside_mature"))
    return totals.withColumn("outside_share", F.col("outside") / F.col("n"))


@query("neighbourhood_vs_band_percentile", ["neighbours", "banded"], """SELECT src, n, round(CASE WHEN n = 1 THEN 0.5e0 ELSE below * 1e0 / (n - 1) END, 6) AS local_pct, round(pct, 6) AS band_pct FROM (SELECT src, count(*) AS n, count(*) FILTER (coin_rate < target_rate) AS below FROM neighbours GROUP BY src) JOIN banded ON item_id = src""")
def neighbourhood_vs_band_percentile(spark, sf):
    """Share of an item's links that lead to lower rates: its exact place within each of its parts, added up."""
    nodes = V.banded(spark, sf).select(F.col("item_id").alias("item"), "coin_rate", F.col("pct").alias("band_pct"))
    placed = O.positions(V.members(spark, sf).join(nodes, "item"), ["part"], ["coin_rate", "item"], ties=["coin_rate"])
    local = placed.filter("group_n > 1").groupBy(F.col("item").alias("src")).agg(
        F.sum(F.col("group_n") - 1).alias("n"), F.sum("tie_first").alias("below"), F.first("band_pct").alias("band_pct"))
    return local.select("src", "n", F.when(F.col("n") == 1, 0.5).otherwise(F.col("below") / (F.col("n") - 1)).alias("local_pct"), "band_pct")


shared_sql("pool_rows", ["banded", "walk_nodes"], """
SELECT coalesce(p.item_id, n.item_id) AS item_id, CASE WHEN p.item_id IS NOT NULL THEN 'population' ELSE 'node' END AS origin, coalesce(p.title, n.title) AS title, coalesce(p.view, n.view) AS view, coalesce(p.duration, n.duration) AS duration, coalesce(p.owner_id, n.owner_id) AS owner_id,
  coalesce(p.pub_day, n.pub_day) AS pub_day, CASE WHEN p.category IS NULL OR p.category = 'other' THEN coalesce(n.category, p.category, 'other') ELSE p.category END AS category, least(p.first_seen, n.first_seen) AS first_seen, p.item_id IS NULL AND n.coin IS NULL AS approximate,
  CASE WHEN p.item_id IS NOT NULL THEN p.coin ELSE coalesce(n.coin, CAST(round_even(n.coin_rate * n.view, 0) AS BIGINT)) END AS coin, CASE WHEN p.item_id IS NOT NULL THEN p.fav ELSE coalesce(n.fav, CAST(round_even(n.fav_rate * n.view, 0) AS BIGINT)) END AS fav,
  CASE WHEN p.item_id IS NOT NULL THEN p.like_cnt ELSE coalesce(n.like_cnt, CAST(round_even(n.like_rate * n.view, 0) AS BIGINT)) END AS like_cnt
FROM (SELECT item_id, title, view, duration, owner_id, CASE WHEN rotate = 0 THEN strftime(pub_ts, '%Y%m%d') END AS pub_day, CASE WHEN duration > 900 THEN 'other' ELSE category END AS category, strftime(pub_ts, '%Y%m%d') AS first_seen, coin, fav, like_cnt FROM banded WHERE source IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')) p
FULL OUTER JOIN (SELECT item_id, title, view, duration, owner_id, strftime(pub_ts, '%Y%m%d') AS pub_day, category, '19970101' AS first_seen, CASE WHEN width > height THEN coin END AS coin, CASE WHEN width > height THEN fav END AS fav, CASE WHEN width > height THEN like_cnt END AS like_cnt,
    round(coin_rate, 4) AS coin_rate, round(fav_rate, 4) AS fav_rate, round(like_rate, 4) AS like_rate FROM banded WHERE item_id IN (SELECT item_id FROM walk_nodes)) n ON p.item_id = n.item_id""")
shared_sql("pool_pct", ["pool_rows", "banded"], f"""SELECT * EXCLUDE (is_ref, below), CASE WHEN view >= 3000 AND ref_n >= 3 THEN below::DOUBLE / ref_n END AS pct FROM (SELECT *, CAST(sum(is_ref) OVER (PARTITION BY band) AS BIGINT) AS ref_n,
    CAST(sum(is_ref) OVER (PARTITION BY band ORDER BY coin_rate RANGE UNBOUNDED PRECEDING) - sum(is_ref) OVER (PARTITION BY band, coin_rate) AS BIGINT) AS below
  FROM (SELECT *, coin * 1e0 / greatest(view, 1) AS coin_rate, fav * 1e0 / greatest(view, 1) AS fav_rate, like_cnt * 1e0 / greatest(view, 1) AS like_rate, CAST(round_even(log10(greatest(view, 10)) / 0.2e0, 0) AS BIGINT) AS band, 0 AS is_ref FROM pool_rows
    UNION ALL BY NAME SELECT item_id, view, coin_rate, band, 1 AS is_ref FROM banded WHERE view >= 3000 AND pub_ts < {CUT})) WHERE is_ref = 0""")
shared_sql("pool_tiers", ["pool_pct"], ptier_sql("pool_pct"))


def pool(spark, sf):
    """Population of three layers and graph nodes near it; a node's own counters exist only for some."""
    items = V.banded(spark, sf)
    day = F.date_format("pub_ts", "yyyyMMdd")
    population = items.filter(F.col("source").isin("AUTOMOBILE", "BUILDING", "FURNITURE")).select(
        "item_id", "title", "view", "duration", "owner_id", F.when(F.col("rotate") == 0, day).alias("pub_day"),
        F.when(F.col("duration") > 900, "other").otherwise(F.col("category")).alias("category"), day.alias("first_seen"), "coin", "fav", "like_cnt")
    near = V.walk_nodes(spark, sf)
    exact = F.col("width") > F.col("height")
    nodes = items.join(near, "item_id", "left_semi").select(
        "item_id", "title", "view", "duration", "owner_id", day.alias("pub_day"), "category", F.lit("19970101").alias("first_seen"),
        *[F.when(exact, F.col(c)).alias(c) for c in ("coin", "fav", "like_cnt")], *[F.round(c, 4).alias(c) for c in ("coin_rate", "fav_rate", "like_rate")])
    ref = items.filter((F.col("view") >= 3000) & (F.col("pub_ts") < F.lit(DRIVER.reference_cutoff).cast("timestamp")))
    return K.with_percentile(K.merge_pool(population, nodes), ref)


@query("pool_merge", ["pool_tiers"], "SELECT item_id, origin, pub_day, category, approximate, coin, fav, like_cnt, round(pct, 6) AS pct, ptier FROM pool_tiers WHERE ptier IN ('top', 'fine')")
def pool_merge(spark, sf):
    return R.percentile_tier(pool(spark, sf), TIERS).filter(F.col("ptier").isin("top", "fine")).select(
        "item_id", "origin", "pub_day", "category", "approximate", "coin", "fav", "like_cnt", "pct", "ptier")


@query("catalog_build", ["pool_pct"], f"""SELECT p.item_id, p.first_seen, approximate, round(pct, 6) AS pct, coalesce(ref_n, 0) AS ref_n, {CUES_SQL} AS cues, {FLAGS_SQL} AS flags, lang AS editorial, 'unreviewed' AS status FROM pool_pct p LEFT JOIN documents ON doc_id = p.item_id
  WHERE p.item_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND owner_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND owner_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND regexp_matches(CAST(p.item_id AS VARCHAR), '^[0-9]{{2,}}$')""")
def catalog_build(spark, sf):
    customer = V.table(spark, sf, "customer")
    named = pool(spark, sf).filter(F.col("item_id").cast("string").rlike("^[0-9]{2,}$")).join(
        customer.select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner_name")), "owner_id")
    kept = R.blacklist_filter(
        named, V.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("item_id")),
        customer.filter("c_acctbal < 0").select(F.col("c_name").alias("owner_name")), customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("owner_id")))
    notes = V.documents(spark, sf).select(F.col("doc_id").alias("item_id"), F.col("lang").alias("editorial"))
    return kept.join(notes, "item_id", "left").select(
        "item_id", "first_seen", "approximate", "pct", "ref_n", F.array_join(R.words_found("title", SCREEN.cues), ";").alias("cues"),
        F.array_join(R.screen_flags("title", T.number_flag(F.lower("title")), SCREEN), ";").alias("flags"), "editorial", F.lit("unreviewed").alias("status"))


def walk(spark, sf, depth=None):
    """Six policies from 18 confluence seeds; the walk is kept as a table for the reports on it."""
    return shared_table(spark, sf, f"walk{depth or ''}", lambda: G.frontier_expansion(
        confluence(spark, sf).select("item_id"), V.members(spark, sf), ptiers(spark, sf), G.POLICIES, depth))


POLICY_VALUES = "(VALUES " + ", ".join(f"('{p.name}', {p.width}, {p.least}, {p.second_tier}, '{p.order}', {p.cap})" for p in G.POLICIES) + ") p(policy, width, least_n, two, ord, cap)"


def walk_sql(depth):
    """The same walk unrolled for a fixed depth."""
    pol = POLICY_VALUES
    parts = [f"f0 AS (SELECT policy, width, least_n, two, ord, cap, item_id AS seed, item_id FROM seeds18, {pol})", "v0 AS (SELECT policy, seed, item_id FROM f0)"]
    for i in range(1, depth + 1):
        rnd = h(f"policy || ':' || seed || ':{i}:' || item_id")
        parts.append(f"""n{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY policy, seed ORDER BY in_pool DESC, tier, k, item_id) AS choice, count(*) FILTER (in_pool) OVER (PARTITION BY policy, seed) AS pool_n FROM (
  SELECT x.*, ptier, ptier = 'top' OR (ptier = 'fine' AND two) AS in_pool, CASE WHEN ptier = 'fine' AND ord <> 'random' THEN 1 ELSE 0 END AS tier,
    CASE ord WHEN 'best' THEN CASE WHEN ptier = 'top' THEN -pct ELSE 1e0 + {rnd} END WHEN 'random' THEN {rnd}::DOUBLE ELSE epoch(pub_ts) END AS k
  FROM (SELECT DISTINCT policy, width, least_n, two, ord, cap, seed, dst AS item_id FROM f{i - 1} JOIN related ON src = f{i - 1}.item_id WHERE cap >= {i}) x JOIN ptiers USING (item_id) WHERE NOT EXISTS (SELECT 1 FROM v{i - 1} v WHERE v.policy = x.policy AND v.seed = x.seed AND v.item_id = x.item_id)))""")
        parts.append(f"f{i} AS (SELECT policy, width, least_n, two, ord, cap, seed, item_id FROM n{i} WHERE in_pool AND choice <= width AND pool_n >= least_n)")
        parts.append(f"v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT policy, seed, item_id FROM n{i})")
    body = " UNION ALL ".join(f"SELECT policy, seed, CAST({i} AS BIGINT) AS hop, count(*) AS reached, count(*) FILTER (ptier = 'top') AS tops, count(*) FILTER (ptier = 'fine') AS fines, max(pool_n) AS pool_n, count(*) FILTER (in_pool AND choice <= width AND pool_n >= least_n) AS chosen, min(item_id) FILTER (in_pool AND choice <= width AND pool_n >= least_n) AS least_chosen FROM n{i} GROUP BY policy, seed" for i in range(1, depth + 1))
    return ", " + ", ".join(parts) + " " + body


@query("frontier_expansion", ["seeds18", "related", "ptiers"], walk_sql(25))
def frontier_expansion(spark, sf):
    return G.hop_summary(walk(spark, sf))


@query("frontier_status", ["seeds18", "related", "ptiers"], walk_sql(25).replace(" SELECT policy, seed, CAST(1", """ SELECT policy, seed, depth, tops, nodes, CASE WHEN last = depth AND depth >= cap THEN 'censored_depth' WHEN two THEN 'dry' ELSE 'pruned' END AS status
  FROM (SELECT policy, seed, max(hop) AS depth, CAST(sum(tops) AS BIGINT) AS tops, CAST(sum(reached) AS BIGINT) AS nodes, max(hop) FILTER (chosen > 0) AS last FROM (SELECT policy, seed, CAST(1""", 1)
       + ") GROUP BY policy, seed) JOIN " + POLICY_VALUES + " USING (policy)")
def frontier_status(spark, sf):
    return G.walk_status(walk(spark, sf))


REQUESTS = walk_sql(25).replace(" SELECT policy, seed, CAST(1", ", hops AS MATERIALIZED (SELECT policy, seed, CAST(1", 1) + f"""), requests AS (SELECT policy, seed, hop, requests, coalesce(tops, 0) AS finds FROM (
  SELECT DISTINCT policy, seed, 1::BIGINT AS hop, 1::BIGINT AS requests FROM hops UNION ALL SELECT policy, seed, hop + 1, chosen FROM hops JOIN {POLICY_VALUES} USING (policy) WHERE chosen > 0 AND hop < cap) LEFT JOIN hops USING (policy, seed, hop))"""
YIELD = "CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(finds) AS BIGINT) AS finds, round(sum(finds) * 1e0 / sum(requests), 6) AS finds_per_request"


@query("hop_efficiency", ["seeds18", "related", "ptiers"], f"{REQUESTS} SELECT policy, hop, {YIELD} FROM requests GROUP BY policy, hop")
def hop_efficiency(spark, sf):
    return G.hop_efficiency(G.hop_requests(walk(spark, sf)))


@query("best_flows", ["seeds18", "related", "ptiers"], f"{REQUESTS} SELECT policy, seed, {YIELD} FROM requests GROUP BY policy, seed ORDER BY sum(finds) * 1e0 / sum(requests) DESC, finds DESC, policy, seed LIMIT 8")
def best_flows(spark, sf):
    return G.best_flows(G.hop_requests(walk(spark, sf)))


@query("frontier_three_hops", ["seeds18", "related", "ptiers"], walk_sql(3))
def frontier_three_hops(spark, sf):
    return G.hop_summary(walk(spark, sf, depth=3))


@query("arm_run_totals", ["seeds18", "related", "ptiers"], walk_sql(3).replace(" SELECT policy, seed, CAST(1", " SELECT policy, CAST(sum(reached) AS BIGINT) AS nodes, CAST(sum(tops) AS BIGINT) AS finds, count(*) FILTER (hop = 3 AND chosen > 0) AS alive, count(*) FILTER (chosen = 0) AS dry, max(hop) AS depth, "
       + ", ".join(f"CAST(coalesce(sum(tops) FILTER (hop = {i}), 0) AS BIGINT) AS finds_{i}" for i in (1, 2, 3)) + " FROM (SELECT policy, seed, CAST(1", 1) + ") GROUP BY policy")
def arm_run_totals(spark, sf):
    hops = G.hop_summary(walk(spark, sf, depth=3))
    return hops.groupBy("policy").agg(
        F.sum("reached").alias("nodes"), F.sum("tops").alias("finds"), F.count_if((F.col("hop") == 3) & (F.col("chosen") > 0)).alias("alive"), F.count_if(F.col("chosen") == 0).alias("dry"),
        F.max("hop").alias("depth"), *[F.sum(F.when(F.col("hop") == i, F.col("tops")).otherwise(0)).alias(f"finds_{i}") for i in (1, 2, 3)])


shared_sql("chain_seeds", ["scored"], f"""SELECT * FROM (SELECT 'signature' AS chain, item_id FROM scored WHERE {NEAR} = 'signature' ORDER BY view DESC, item_id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'control', item_id FROM scored WHERE {NEAR} = 'none' ORDER BY view DESC, item_id LIMIT 20)""")


@query("two_level_chain", ["chain_seeds", "related", "scored"], f""", kinds AS (SELECT item_id, like_rate, {NEAR} AS kind FROM scored), one AS (SELECT DISTINCT chain, c.item_id AS seed, dst AS item_id, 1 AS level FROM chain_seeds c JOIN related ON src = c.item_id),
  best AS (SELECT chain, seed, item_id FROM (SELECT *, row_number() OVER (PARTITION BY chain, seed ORDER BY like_rate DESC, item_id) AS rn FROM one JOIN kinds USING (item_id) WHERE kind = 'signature') WHERE rn <= 2),
  two AS (SELECT DISTINCT chain, seed, dst AS item_id, 2 AS level FROM best b JOIN related ON src = b.item_id)
  SELECT chain, CAST(level AS BIGINT) AS level, count(*) AS n, count(*) FILTER (kind = 'signature') AS hits, count(*) FILTER (starts_with(kind, 'near')) AS near_misses, round(avg(CASE WHEN kind = 'signature' THEN 1e0 ELSE 0e0 END), 6) AS hit_rate FROM (SELECT * FROM one UNION ALL SELECT * FROM two) JOIN kinds USING (item_id) GROUP BY chain, level""")
def two_level_chain(spark, sf):
    nodes = V.scored(spark, sf).withColumn("kind", R.near_miss())

    def biggest(kind, chain):
        return nodes.filter(F.col("kind") == kind).orderBy(F.desc("view"), "item_id").limit(CHAIN_SEEDS).select(F.lit(chain).alias("chain"), "item_id")
    return G.two_level_chain(biggest("signature", "signature").unionByName(biggest("none", "control")), V.members(spark, sf), nodes)


shared_sql("year_hops", ["scored"], f"SELECT CAST(year - 1994 AS BIGINT) AS hop, round(avg(CASE WHEN {HIGH} THEN 1e0 ELSE 0e0 END), 6) AS rate, count(*) FILTER ({HIGH}) AS n_seeds FROM scored WHERE view >= 3000 GROUP BY year")


@query("hop_stop_rule", ["year_hops"], """, r AS (SELECT *, rate / lag(rate) OVER (ORDER BY hop) AS rho, first_value(rate) OVER (ORDER BY hop) AS base FROM year_hops), s AS (SELECT hop, rate, n_seeds, rho, CASE WHEN hop > 1 THEN CASE WHEN rho < 0.95e0 THEN 'ratio' WHEN rate < 0.8e0 * base THEN 'floor' WHEN n_seeds < 10 THEN 'seeds' WHEN hop > 6 THEN 'depth' END END AS reason FROM r)
  SELECT hop, rate, n_seeds, round(rho, 6) AS rho, reason FROM s WHERE hop <= coalesce((SELECT min(hop) FROM s WHERE reason IS NOT NULL), 99)""")
def hop_stop_rule(spark, sf):
    hops = mature(spark, sf).groupBy((F.col("year") - 1994).alias("hop")).agg(F.round(A.share(A.is_high()), 6).alias("rate"), F.count_if(A.is_high()).alias("n_seeds"))
    return K.hop_stops(hops, first=1)


@query("pooled_hop_summary", ["boot", "clusters", "edges"], """SELECT arm, n, rate, lo, hi, round(rate / lag(rate) OVER (ORDER BY arm), 6) AS ratio FROM (SELECT arm, CAST(sum(n) AS BIGINT) AS n, round(sum(g) * 1e0 / sum(n), 6) AS rate FROM clusters GROUP BY arm) JOIN (SELECT arm, round(rates[101], 6) AS lo, round(rates[3900], 6) AS hi FROM boot) USING (arm)""")
def pooled_hop_summary(spark, sf):
    rates = edge_items(spark, sf).filter("view >= 3000").groupBy("arm").agg(F.count("*").alias("n"), F.round(A.share(A.is_high()), 6).alias("rate"))
    follows = F.create_map(F.lit("A"), F.lit("N"), F.lit("N"), F.lit("R"))
    prev = rates.select(F.element_at(follows, F.col("arm")).alias("arm"), F.col("rate").alias("prev"))
    return rates.join(bootstrap(spark, sf).drop("mean"), "arm").join(prev, "arm", "left").withColumn("ratio", F.try_divide("rate", "prev")).drop("prev")


@query("user_item_graph_layout_input", ["edge_items", "seeds18", "inflow"], f"""SELECT 'seed' AS kind, 'all' AS hop, item_id AS a, NULL::BIGINT AS b, cbi::DOUBLE AS value FROM (SELECT item_id, round(cbi, 6) AS cbi FROM seeds18)
  UNION ALL SELECT 'user', arm, user_id, NULL, round(avg(CASE WHEN {HIGH} THEN 1e0 ELSE 0e0 END), 6) FROM edge_items WHERE view >= 3000 GROUP BY arm, user_id HAVING count(*) >= 5
  UNION ALL SELECT 'item', 'all', item_id, NULL, collectors::DOUBLE FROM (SELECT DISTINCT item_id FROM edge_items WHERE tier IN ('high', 'good')) JOIN inflow USING (item_id)
  UNION ALL SELECT 'edge', arm, user_id, item_id, NULL FROM edge_items WHERE tier IN ('high', 'good') AND view >= 3000""")
def user_item_graph_layout_input(spark, sf):
    df = edge_items(spark, sf)
    none, nul = F.lit(None).cast("long"), F.lit(None).cast("double")
    seeds = confluence(spark, sf).select(F.lit("seed").alias("kind"), F.lit("all").alias("hop"), F.col("item_id").alias("a"), none.alias("b"), F.col("cbi").alias("value"))
    users = A.rates_by(df.filter("view >= 3000"), ["arm", "user_id"], 5).select(F.lit("user").alias("kind"), F.col("arm").alias("hop"), F.col("user_id").alias("a"), none.alias("b"), F.col("high_rate").alias("value"))
    items = flow(spark, sf).filter(A.is_good()).select(F.lit("item").alias("kind"), F.lit("all").alias("hop"), F.col("item_id").alias("a"), none.alias("b"), F.col("collectors").cast("double").alias("value"))
    edges = df.filter(A.is_good() & (F.col("view") >= 3000)).select(F.lit("edge").alias("kind"), F.col("arm").alias("hop"), F.col("user_id").alias("a"), F.col("item_id").alias("b"), nul.alias("value"))
    return seeds.unionByName(users).unionByName(items).unionByName(edges)


@query("editorial_left_join", ["items"], "SELECT item_id, title, lang AS note FROM items LEFT JOIN documents ON doc_id = item_id")
def editorial_left_join(spark, sf):
    notes = V.documents(spark, sf).select(F.col("doc_id").alias("item_id"), F.col("lang").alias("note"))
    return V.items(spark, sf).select("item_id", "title").join(notes, "item_id", "left")


@query("approve_append", ["items"], """SELECT doc_id AS item_id, outcome, CASE WHEN outcome = 'accepted' THEN CASE WHEN toxic = 1 THEN 'flagged by reader' ELSE substr(title, 1, 80) END END AS note FROM (SELECT l.*, i.title,
  CASE WHEN doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN 'already_approved' WHEN i.item_id IS NULL THEN 'unknown' WHEN i.duration <= 150 THEN 'too_short' ELSE 'accepted' END AS outcome FROM labels l LEFT JOIN items i ON i.item_id = l.doc_id WHERE quality = 1)""")
def approve_append(spark, sf):
    requested = V.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 1, "flagged by reader").otherwise(" ").alias("note"))
    approved = V.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("item_id"))
    return K.approve(requested, approved, V.items(spark, sf))


@query("numeric_review_queue", [], f"SELECT doc_id FROM ({TITLE_FLAG_SQL}) WHERE flag = 'number_review' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY doc_id DESC")
def numeric_review_queue(spark, sf):
    published = V.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    rows = V.documents(spark, sf).select("doc_id", T.number_flag(T.folded("text")).alias("flag")).filter("flag = 'number_review'")
    return rows.join(published, "doc_id", "left_anti").select("doc_id").orderBy(F.desc("doc_id"))


@query("backfill_targets", ["ptiers"], """SELECT item_id, ptier, round(pct, 6) AS pct FROM ptiers WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0) AND rotate = 90 ORDER BY list_position(['top', 'fine', 'plain', 'poor', 'none'], ptier), pct DESC NULLS LAST, item_id""")
def backfill_targets(spark, sf):
    filled = V.table(spark, sf, "labels").filter("toxic = 0").select(F.col("doc_id").alias("item_id"))
    tier = F.array_position(F.array(*[F.lit(t) for t in ("top", "fine", "plain", "poor", "none")]), F.col("ptier"))
    return ptiers(spark, sf).filter("rotate = 90").join(filled, "item_id", "left_anti").orderBy(tier, F.desc_nulls_last("pct"), "item_id").select("item_id", "ptier", "pct")
