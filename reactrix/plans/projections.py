"""Scalar projections and decision tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import scores as S
from ..functions import titles as T
from ..operators import rules as R
from ..params import DRAFT_RULES, DRIVER
from ..sources import views as V
from .registry import query, shared_sql

TIERS = DRIVER.tiers


def likes(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query("weighted_ratio_score", ["items"], """
SELECT item_id, round((3e0*fav + 2e0*coin + 0.3e0*like_cnt) / greatest(view, 1), 6) AS by_view,
  round((3e0*fav + 2e0*coin + 0.3e0*like_cnt) / sqrt(greatest(view, 1)), 6) AS by_sqrt,
  round((3e0*fav + 2e0*coin + 0.3e0*like_cnt) / log10(greatest(view, 10)), 6) AS by_log FROM items""")
def weighted_ratio_score(spark, sf):
    return V.items(spark, sf).select("item_id", *[S.weighted_ratio(m).alias(f"by_{m}") for m in ("view", "sqrt", "log")])


ABS_SQL = """CASE WHEN view < 3000 THEN 'unproven' WHEN f7 >= 0.107e0 THEN 'high' WHEN f7 >= 0.064e0 THEN 'normal'
  WHEN f7 >= 0.042e0 THEN 'low' ELSE 'junk' END"""
PORTRAIT_SQL = """CASE WHEN width = 0 OR height = 0 THEN NULL
  WHEN rotate IN (90, 270) THEN height::DOUBLE / width < 0.9e0 ELSE width::DOUBLE / height < 0.9e0 END"""


@query("absolute_tier", ["scored"], f"SELECT item_id, {ABS_SQL} AS abs_tier FROM scored")
def absolute_tier(spark, sf):
    return V.items(spark, sf).select("item_id", S.absolute_tier(S.f7()).alias("abs_tier"))


@query("orientation_tristate", ["items"], f"SELECT item_id, {PORTRAIT_SQL} AS portrait FROM items")
def orientation_tristate(spark, sf):
    return V.items(spark, sf).select("item_id", S.portrait().alias("portrait"))


KEYWORDS = ("rod", "anvil", "hot")


@query("filter_reasons", ["scored"], f"""
SELECT item_id, round(f7, 4) AS ratio, reasons, reasons <> '' AS filtered FROM (SELECT item_id, f7, concat_ws(';',
  CASE WHEN duration > 0 AND duration <= 75 THEN 'short(' || duration || 's)' END,
  CASE WHEN {PORTRAIT_SQL} THEN 'portrait' END,
  CASE WHEN category = '5-LOW' AND rotate = 90 THEN 'live' END,
  CASE WHEN view < 1000 THEN 'low_views(' || view || ')' END,
  CASE WHEN {likes('title', KEYWORDS)} THEN 'keyword:' || concat_ws('|', {', '.join(f"CASE WHEN contains(title, '{w}') THEN '{w}' END" for w in KEYWORDS)}) END,
  CASE WHEN {ABS_SQL} IN ('junk', 'unproven') THEN 'tier ' || {ABS_SQL} || printf('(%.3f)', f7) END) AS reasons FROM scored)""")
def filter_reasons(spark, sf):
    live = (F.col("category") == "5-LOW") & (F.col("rotate") == 90)
    return R.filter_reasons(V.items(spark, sf), KEYWORDS, live, hide_unproven=True).select(
        "item_id", F.round("ratio", 4).alias("ratio"), F.array_join("reasons", ";").alias("reasons"), "filtered")


@query("f7_rate", ["scored"], "SELECT item_id, round(f7, 6) AS f7 FROM scored")
def f7_rate(spark, sf):
    return V.items(spark, sf).select("item_id", S.f7().alias("f7"))


@query("baseline_interpolate", ["scored"], "SELECT item_id, round(base, 6) AS base FROM scored")
def baseline_interpolate(spark, sf):
    return V.items(spark, sf).select("item_id", S.baseline(S.log_view()).alias("base"))


@query("relative_index", ["scored"], "SELECT item_id, round(cbi, 6) AS cbi FROM scored")
def relative_index(spark, sf):
    return V.items(spark, sf).select("item_id", (S.f7() / S.baseline(S.log_view())).alias("cbi"))


@query("relative_tier", ["scored"], "SELECT item_id, tier FROM scored")
def relative_tier(spark, sf):
    return V.scored(spark, sf).select("item_id", "tier")


RATES = ("like_rate", "coin_rate", "fav_rate", "danmaku_rate", "share_rate", "reply_rate", "social")


@query("single_rates", ["scored"], "SELECT item_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in RATES) + " FROM scored")
def single_rates(spark, sf):
    return V.scored(spark, sf).select("item_id", *RATES)


def verdict_sql(extra_live="FALSE", official="FALSE", hide="('junk')", client=False):
    """Feed cascade in SQL over `scored`."""
    exempt = f"(contains(category, 'URGENT') OR {official})"
    below = f"(view >= 50000 AND NOT {exempt} AND cbi < 0.5e0)"
    weak = f"({ABS_SQL} IN {hide} AND NOT {exempt} AND NOT {below}" + (
        " AND view < 50000 AND view >= 1000)" if client else ")")
    early = f"""CASE WHEN {extra_live} THEN 'live' WHEN duration > 0 AND duration <= 75 THEN 'short'
      WHEN regexp_matches(title, '^red.*(rod|anvil)$') OR regexp_matches(title, '^hot b') THEN 'signature' END"""
    return f"""SELECT *, reasons <> '' AS hide, CASE WHEN reasons <> '' THEN split_part(reasons, ';', 1) END AS first_reason
    FROM (SELECT *, CASE WHEN early IS NOT NULL THEN early ELSE late END AS reasons,
      CASE WHEN early IS NULL AND view >= 50000 AND NOT {exempt} THEN cbi END AS verdict_index,
      early IS NULL AND (regexp_matches(title, 'small .{{0,6}}ring') OR contains(title, 'new g')) AS tag,
      CASE WHEN early IS NULL THEN CASE WHEN {below} THEN 'junk' ELSE {ABS_SQL} END END AS verdict_tier
    FROM (SELECT *, {early} AS early, concat_ws(';', CASE WHEN {PORTRAIT_SQL} THEN 'portrait' END,
        CASE WHEN view < 1000 THEN 'low_views' END, CASE WHEN {below} THEN 'index' END,
        CASE WHEN {weak} THEN 'tier' END) AS late FROM scored))"""


shared_sql("verdicts", ["scored"], verdict_sql())
shared_sql("client_verdicts", ["scored"], verdict_sql(
    "(category = '5-LOW' AND rotate = 90)", "(source = 'BUILDING')", "('junk', 'unproven')", client=True))
OFFLINE = replace(DRIVER.feed, low_view_suppresses_tier=False, index_pass_exempts=False)
CLIENT = replace(DRIVER.feed, live_column="is_live", official_column="official", hide_unproven=True)
VERDICT_COLS = ("item_id", "hide", "verdict_index", "tag", "verdict_tier")
VERDICT_SQL = "SELECT item_id, hide, reasons, round(verdict_index, 6) AS verdict_index, tag, verdict_tier FROM "


def verdicts(spark, sf):
    return R.feed_verdict(V.scored(spark, sf), OFFLINE)


@query("feed_verdict", ["verdicts"], VERDICT_SQL + "verdicts")
def feed_verdict(spark, sf):
    return verdicts(spark, sf).select(*VERDICT_COLS, F.array_join("reasons", ";").alias("reasons"))


@query("feed_verdict_variants", ["client_verdicts"], VERDICT_SQL + "client_verdicts")
def feed_verdict_variants(spark, sf):
    df = V.scored(spark, sf).withColumn("is_live", (F.col("category") == "5-LOW") & (F.col("rotate") == 90)).withColumn(
        "official", F.col("source") == "BUILDING")
    return R.feed_verdict(df, CLIENT).select(*VERDICT_COLS, F.array_join("reasons", ";").alias("reasons"))


def sympathy_sql(title="title", strong=TIERS.strong, weak=TIERS.weak):
    def found(words):
        return "[w FOR w IN [" + ", ".join(f"'{w}'" for w in words) + f"] IF contains({title}, w)]"
    return f"""CASE WHEN len({found(strong)}) > 0 THEN 'strong:' || array_to_string({found(strong)}[1:3], '/')
      WHEN len({found(weak)}) >= 2 THEN 'weak:' || array_to_string({found(weak)}[1:3], '/') END"""


def ptier_sql(source="banded", draft=False):
    """Percentile decision table; the draft differs in four rules."""
    cut = "duration < 90" if draft else "duration <= 150"
    heavy = "(coin_rate <= 1e-6 OR fav_rate / coin_rate > 8e0)" if draft else "fav_rate / greatest(coin_rate, 1e-6) > 8e0"
    note = "NULL" if draft else sympathy_sql()
    support = "FALSE" if draft else "(coin_rate > fav_rate OR coin_rate > like_rate) AND pct >= 0.5e0"
    known = "TRUE" if draft else "pct IS NOT NULL"
    return f"""SELECT * EXCLUDE (l0, l1, l2, short, cut, hoard, edge, note),
      CASE WHEN {known} THEN ['poor', 'plain', 'fine', 'top'][CASE WHEN note IS NOT NULL THEN greatest(l2 - 1, 0) ELSE l2 END + 1] ELSE 'none' END AS ptier,
      CASE WHEN {known} THEN concat_ws(';', CASE WHEN short THEN 'R2a' END, CASE WHEN cut AND l0 = 3 THEN 'R2b' END, CASE WHEN hoard THEN 'R3' END,
        CASE WHEN edge THEN 'R4' END, 'R10 ' || note, CASE WHEN note IS NULL AND {support} THEN 'R9' END) ELSE '' END AS fired
    FROM (SELECT *, CASE WHEN hoard{" OR edge" if draft else ""} THEN least(l1, 2) ELSE l1 END AS l2
    FROM (SELECT *, CASE WHEN short THEN least(l0, 1) WHEN cut AND l0 = 3 THEN 2 ELSE l0 END AS l1
    FROM (SELECT *, CASE WHEN pct >= 0.93e0 THEN 3 WHEN pct >= 0.85e0 THEN 2 WHEN pct < 0.72e0 THEN 0 ELSE 1 END AS l0,
      duration > 0 AND duration < 30 AS short, duration >= 30 AND {cut} AS cut,
      {heavy} AND fav_rate > 0.15e0 AS hoard, like_rate > 0.2e0 AND coin_rate < 0.02e0 AND fav_rate > 0.1e0 AS edge,
      {note} AS note FROM {source})))"""


shared_sql("ptiers", ["banded"], ptier_sql())
shared_sql("draft_ptiers", ["banded"], ptier_sql(draft=True))


def ptiers(spark, sf, rules=TIERS):
    return R.percentile_tier(V.banded(spark, sf), rules)


@query("percentile_tier_table", ["ptiers"], "SELECT item_id, round(pct, 6) AS pct, ptier, fired FROM ptiers")
def percentile_tier_table(spark, sf):
    return ptiers(spark, sf).select("item_id", "pct", "ptier", F.array_join("fired", ";").alias("fired"))


@query("sympathy_title_rule", ["items"], f"SELECT item_id, note IS NOT NULL AS hit, note FROM (SELECT item_id, {sympathy_sql()} AS note FROM items)")
def sympathy_title_rule(spark, sf):
    hit, note = R.sympathy("title", TIERS.strong, TIERS.weak)
    return V.items(spark, sf).select("item_id", hit.alias("hit"), note.alias("note"))


@query("draft_tier_table", ["draft_ptiers"], "SELECT item_id, ptier, fired FROM draft_ptiers")
def draft_tier_table(spark, sf):
    return ptiers(spark, sf, DRAFT_RULES).select("item_id", "ptier", F.array_join("fired", ";").alias("fired"))


SIG = "(like_rate > 0.2e0 AND coin_rate < 0.02e0 AND fav_rate > 0.1e0)"
NEAR = f"""CASE WHEN {SIG} THEN 'signature' WHEN coin_rate < 0.02e0 AND fav_rate > 0.1e0 AND like_rate > 0.12e0 AND like_rate <= 0.2e0 THEN 'near_a'
  WHEN like_rate > 0.2e0 AND coin_rate < 0.02e0 AND fav_rate <= 0.1e0 THEN 'near_b'
  WHEN like_rate > 0.2e0 AND coin_rate >= 0.02e0 AND coin_rate < 0.04e0 AND fav_rate > 0.1e0 THEN 'near_c' ELSE 'none' END"""


@query("signature_and_near_miss", ["scored"], f"""
SELECT item_id, kind, round(least(a, b, c), 6) AS closest_ratio,
  CASE WHEN b <= a AND b <= c THEN 'coin' WHEN c <= a THEN 'fav' ELSE 'like' END AS closest_name
FROM (SELECT item_id, {NEAR} AS kind, like_rate / 0.2e0 AS a, coin_rate / 0.02e0 AS b, fav_rate / 0.1e0 AS c FROM scored)""")
def signature_and_near_miss(spark, sf):
    return V.scored(spark, sf).select("item_id", R.near_miss().alias("kind"), R.closest_line().alias("c")).select(
        "item_id", "kind", F.col("c.ratio").alias("closest_ratio"), F.col("c.name").alias("closest_name"))


CELL_SQL = f"""CASE WHEN {SIG} AND view < 100000 AND duration > 0 AND duration <= 21 THEN 'A'
  WHEN {SIG} AND view < 100000 AND duration > 21 AND duration <= 45 THEN 'B' WHEN {SIG} AND view < 100000 AND duration > 45 THEN 'C'
  WHEN NOT {SIG} AND view >= 300000 AND fav_rate > 0 AND coin_rate / fav_rate <= 0.11e0 THEN 'D'
  WHEN NOT {SIG} AND view >= 300000 AND fav_rate > 0 AND coin_rate / fav_rate <= 0.20e0 THEN 'E'
  WHEN NOT {SIG} AND view < 100000 AND {NEAR} = 'near_a' THEN 'F' WHEN NOT {SIG} AND view < 100000 THEN 'G' END"""
shared_sql("cells", ["scored"], f"SELECT *, {CELL_SQL} AS cell FROM scored")


@query("review_cell_assignment", ["cells"], f"""
SELECT item_id, cell, CASE WHEN {SIG} AND view < 100000 AND duration > 0 AND duration <= 21 AND faces >= 1 THEN 'T1'
  WHEN {SIG} AND view < 100000 AND duration > 0 AND duration <= 21 AND faces = 0 THEN 'T2' WHEN {SIG} AND view < 100000 AND duration > 21 THEN 'T3'
  WHEN NOT {SIG} AND view < 100000 AND faces >= 1 THEN 'C1'
  WHEN NOT {SIG} AND view >= 300000 AND fav_rate > 0 AND coin_rate / fav_rate <= 0.11e0 AND faces >= 1 THEN 'H1'
  WHEN NOT {SIG} AND view < 100000 THEN 'G' END AS face_cell
FROM (SELECT *, CASE WHEN width < height THEN 1 ELSE 0 END AS faces FROM cells)""")
def review_cell_assignment(spark, sf):
    faces = F.when(F.col("width") < F.col("height"), 1).otherwise(0)
    return V.scored(spark, sf).select("item_id", R.review_cell().alias("cell"), R.review_cell_faces(faces).alias("face_cell"))


@query("sincerity_ratio", ["scored"], f"""
SELECT item_id, round(sinc, 6) AS sinc, CASE WHEN sinc IS NULL THEN 'undefined' WHEN sinc < a THEN 'below_p10' WHEN sinc < b THEN 'below_p25'
  WHEN sinc <= c THEN 'middle' ELSE 'above_p75' END AS place, like_cnt > 50 * coin AS like_heavy
FROM (SELECT *, coin::DOUBLE / nullif(fav, 0) AS sinc FROM scored),
  (SELECT quantile_cont(x, 0.1e0) AS a, quantile_cont(x, 0.25e0) AS b, quantile_cont(x, 0.75e0) AS c
   FROM (SELECT coin::DOUBLE / nullif(fav, 0) AS x FROM scored WHERE pub_ts < TIMESTAMP '{DRIVER.reference_cutoff}'))""")
def sincerity_ratio(spark, sf):
    df = V.items(spark, sf).withColumn("sinc", F.try_divide(F.col("coin").cast("double"), F.col("fav").cast("double")))
    ref = df.filter(F.col("pub_ts") < F.lit(DRIVER.reference_cutoff).cast("timestamp"))
    q = O.quantiles(ref, [], {"sinc": "sinc"}, {"p10": 0.1, "p25": 0.25, "p75": 0.75})
    p10, p25, p75 = (q.select(f"{p}_sinc").scalar() for p in ("p10", "p25", "p75"))
    place = (F.when(F.col("sinc").isNull(), "undefined").when(F.col("sinc") < p10, "below_p10")
             .when(F.col("sinc") < p25, "below_p25").when(F.col("sinc") <= p75, "middle").otherwise("above_p75"))
    return df.select("item_id", "sinc", place.alias("place"), (F.col("like_cnt") > 50 * F.col("coin")).alias("like_heavy"))


@query("archive_vs_expression_shape", ["items"], "SELECT item_id, CASE WHEN fav > coin THEN 'archive' ELSE 'expression' END AS shape FROM items")
def archive_vs_expression_shape(spark, sf):
    return V.items(spark, sf).select("item_id", F.when(F.col("fav") > F.col("coin"), "archive").otherwise("expression").alias("shape"))


# Word lists for the driver's invented prose.
VERDICT = {"reject": ("nterthe", "wstra"), "top": ("heand", "queau", "cheung"), "top_negated": ("thewh", "onlé", "enver"),
           "utility": ("entent", "tionr"), "fine": ("ing", "en ", "ción")}
shared_sql("verdict_texts", [], f"""SELECT doc_id, text, quality, toxic, CASE WHEN {likes('text', VERDICT['reject'])} THEN 'reject'
  WHEN {likes('text', VERDICT['top'])} AND NOT {likes('text', VERDICT['top_negated'])} THEN 'top'
  WHEN {likes('text', VERDICT['utility'])} THEN 'utility' WHEN {likes('text', VERDICT['fine'])} THEN 'fine' ELSE 'unclear' END AS verdict
  FROM documents JOIN labels USING (doc_id)""")


def verdict_texts(spark, sf):
    return V.documents(spark, sf).join(V.table(spark, sf, "labels"), "doc_id").withColumn("verdict", R.verdict_group("text", VERDICT))


@query("verdict_text_grouping", ["verdict_texts"], "SELECT doc_id, verdict FROM verdict_texts")
def verdict_text_grouping(spark, sf):
    return verdict_texts(spark, sf).select("doc_id", "verdict")


@query("approved_positive", [], f"SELECT doc_id, contains(text, 'que') AND NOT {likes('text', ('onlé', 'eauque', 'ción'))} AS approved FROM documents")
def approved_positive(spark, sf):
    return V.documents(spark, sf).select("doc_id", R.approved_positive("text", "doc_id", "que", ("onlé", "eauque", "ción")).alias("approved"))


REASON_SQL = """CASE source WHEN 'src1' THEN 'craft_expression' WHEN 'src2' THEN 'effort_only' WHEN 'src3' THEN 'unheard_of'
  WHEN 'src4' THEN '' ELSE 'craft_expression' END"""
shared_sql("raw_reviews", [], f"""SELECT doc_id, quality * 2 + toxic AS craft, CASE WHEN n_chars >= 4000 THEN 4 WHEN n_chars >= 900 THEN 3 ELSE 1 END AS resonance,
  {REASON_SQL} AS reason, toxic = 0 AS watched, CASE WHEN lang = 'de' THEN ' ' ELSE lang END AS evidence FROM documents JOIN labels USING (doc_id)""")
shared_sql("reviews", ["raw_reviews"], """SELECT *, CASE WHEN craft > 3 THEN 'craft' WHEN resonance > 3 THEN 'resonance' WHEN reason = 'unheard_of' THEN 'reason' END AS problem FROM raw_reviews""")


def reviews(spark, sf):
    """Review documents written as JSON, then validated as the review reader does."""
    src = F.col("source")
    reason = F.when(src == "src2", "effort_only").when(src == "src3", "unheard_of").when(src == "src4", "").otherwise("craft_expression")
    raw = V.documents(spark, sf).join(V.table(spark, sf, "labels"), "doc_id").select("doc_id", F.to_json(F.struct(
        (F.col("quality") * 2 + F.col("toxic")).alias("craft"),
        F.when(F.col("n_chars") >= 4000, 4).when(F.col("n_chars") >= 900, 3).otherwise(1).alias("resonance"),
        reason.alias("reason"), (F.col("toxic") == 0).alias("watched"),
        F.when(F.col("lang") == "de", " ").otherwise(F.col("lang")).alias("evidence"),
        F.lit("review-v1").alias("schema"), F.lit("claimed").alias("status"))).alias("payload"))
    return R.validated_reviews(raw, "payload", "review-v1")


@query("review_validation", ["reviews"], "SELECT doc_id, problem, craft::BIGINT AS craft, resonance::BIGINT AS resonance, reason, watched, evidence FROM reviews")
def review_validation(spark, sf):
    return reviews(spark, sf).select("doc_id", "problem", "craft", "resonance", "reason", "watched", "evidence")


STATUS_SQL = """CASE WHEN NOT watched THEN 'unreviewed' WHEN craft NOT BETWEEN 0 AND 3 OR resonance NOT BETWEEN 0 AND 3
  OR reason NOT IN ('craft_expression', 'sentiment_only', 'effort_only', 'utility_only', 'other') OR trim(evidence) = '' THEN 'incomplete'
  WHEN craft >= 2 AND resonance >= 2 AND reason = 'craft_expression' THEN 'confirmed' ELSE 'not_fit' END"""


@query("review_status", ["reviews"], f"SELECT doc_id, {STATUS_SQL} AS status FROM reviews")
def review_status(spark, sf):
    return reviews(spark, sf).select("doc_id", R.review_status().alias("status"))


ZONES = ((("URGENT", "HIGH"), "rush"), (("MEDIUM",), "steady"))
WORDS = (("metal", ("bolt", "rod", "anvil")), ("shape", ("ring", "plate")), ("warm", ("hot", "red")))


@query("category_rules", ["items"], """SELECT item_id, CASE WHEN contains(category, 'URGENT') OR contains(category, 'HIGH') THEN 'rush' WHEN contains(category, 'MEDIUM') THEN 'steady'
  WHEN regexp_matches(title, 'bolt|rod|anvil') THEN 'metal' WHEN regexp_matches(title, 'ring|plate') THEN 'shape' WHEN regexp_matches(title, 'hot|red') THEN 'warm' ELSE 'other' END AS cat,
  CASE WHEN regexp_matches(category, 'URGENT|HIGH|MEDIUM') THEN 'zone' ELSE 'keyword' END AS decided_by FROM items""")
def category_rules(spark, sf):
    cat, src = R.category("category", "title", ZONES, WORDS)
    return V.items(spark, sf).select("item_id", cat.alias("cat"), src.alias("decided_by"))


FORMS = (("fasten", "bolt|rod"), ("smith", "^(hot|red) .*anvil"), ("round", "ring|gear"), ("sheet", "plate"), ("gadget", r"\bgizmo\b"))
FORM_SQL = "CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{n}'" for n, p in FORMS) + " ELSE 'other' END"


@query("work_form", ["items"], f"SELECT item_id, {FORM_SQL} AS form FROM items")
def work_form(spark, sf):
    return V.items(spark, sf).select("item_id", R.first_pattern("title", FORMS, "other").alias("form"))


TITLE_FLAG_SQL = r"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
segs AS (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9.]+[^0-9.]*')) AS seg, generate_subscripts(regexp_extract_all(t, '[0-9.]+[^0-9.]*'), 1) AS k FROM d),
nums AS (SELECT *, regexp_extract(seg, '^[0-9]+') AS n, lead(seg) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM segs),
parts AS (SELECT *, substr(seg, length(n) + 1) AS rest FROM nums WHERE length(n) >= 2),
ok AS (SELECT *, length(n) = 6 AND regexp_matches(n, '^(1[5-9]|2[0-9]|30)[01][0-9][0-3][0-9]$') AND try_strptime('20' || n, '%Y%m%d') IS NOT NULL
   OR length(n) = 8 AND regexp_matches(n, '^20(1[5-9]|2[0-9]|30)[01][0-9][0-3][0-9]$') AND try_strptime(n, '%Y%m%d') IS NOT NULL AS is_day FROM parts
  WHERE NOT regexp_matches(rest, '^\.[0-9]')),
hits AS (SELECT DISTINCT doc_id FROM ok WHERE NOT is_day AND NOT (length(n) = 4 AND n BETWEEN '1900' AND '2099')
  AND NOT regexp_matches(rest, '^\s*(周年|年|月|日|天|小时|分钟|秒|帧|岁|元|万|亿|期货|人|抽|册|块|刀|攻速|公里|千米|米|℃|%|fps\b|hz\b|khz\b|kb\b|mb\b|gb\b|p\b|k\b|×)')
  AND NOT (regexp_matches(rest, '^\s*x\s*$') AND coalesce(regexp_matches(nxt, '^[0-9]'), FALSE))
  AND (length(n) >= 3 OR (nxt IS NULL AND trim(rest, ' 】]）)！!。．.？?') = '')))
SELECT doc_id, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])s\s*\d+\s*e\s*\d+') THEN 'series' WHEN doc_id IN (SELECT doc_id FROM hits) THEN 'number_review' END AS flag FROM d"""


@query("title_number_flag", [], TITLE_FLAG_SQL)
def title_number_flag(spark, sf):
    return V.documents(spark, sf).select("doc_id", T.number_flag(T.folded("text")).alias("flag"))


SCREEN = DRIVER.screen


@query("topic_name_flag", [], f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(SCREEN.topics)}') AS flagged FROM documents")
def topic_name_flag(spark, sf):
    return V.documents(spark, sf).select("doc_id", R.topic_named(T.folded("text"), SCREEN.topics).alias("flagged"))


CUES_SQL = "concat_ws(';', " + ", ".join(f"CASE WHEN contains(title, '{w}') THEN '{w}' END" for w in SCREEN.cues) + ")"
FLAGS_SQL = f"concat_ws(';', CASE WHEN duration <= 150 THEN 'short' END, CASE WHEN {likes('title', SCREEN.title_words)} THEN 'title_review' END, CASE WHEN {SIG} THEN 'interaction_review' END)"
shared_sql("flagged", ["banded"], f"SELECT *, {CUES_SQL} AS cues, {FLAGS_SQL} AS flags FROM banded")


def flagged(spark, sf):
    """Catalogue rows with motive cues and screening flags (arrays)."""
    return V.banded(spark, sf).withColumn("motive_cues", R.words_found("title", SCREEN.cues)).withColumn(
        "screen_flags", R.screen_flags("title", T.number_flag(F.lower("title")), SCREEN))


@query("catalog_flags", ["flagged"], "SELECT item_id, cues, flags FROM flagged")
def catalog_flags(spark, sf):
    return flagged(spark, sf).select("item_id", F.array_join("motive_cues", ";").alias("cues"), F.array_join("screen_flags", ";").alias("flags"))


@query("blacklist_filter", ["items"], """SELECT source, count(*) AS kept, CAST(any_value(total) - count(*) AS BIGINT) AS dropped FROM items JOIN customer ON c_custkey = owner_id
  JOIN (SELECT source, count(*) AS total FROM items GROUP BY source) USING (source)
  WHERE item_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND c_name NOT IN (SELECT c_name FROM customer WHERE c_acctbal < 0)
  AND owner_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY source""")
def blacklist_filter(spark, sf):
    customer = V.table(spark, sf, "customer")
    items = V.items(spark, sf).join(customer.select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner_name")), "owner_id")
    kept = R.blacklist_filter(
        items, V.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("item_id")),
        customer.filter("c_acctbal < 0").select(F.col("c_name").alias("owner_name")),
        customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("owner_id")))
    total = items.groupBy("source").agg(F.count("*").alias("total"))
    return kept.groupBy("source").agg(F.count("*").alias("kept")).join(total, "source").select(
        "source", "kept", (F.col("total") - F.col("kept")).alias("dropped"))


FEATURE_SQL = {name: f"regexp_matches(text, '{p}')" for name, p in T.TITLE_FEATURES} | {
    "exclaims": "len(regexp_extract_all(text, '[！!]')) >= 2", "spaced": r"regexp_matches(text, '\S \S') AND length(text) <= 20", "long": "length(text) >= 25"}


@query("title_features", [], "SELECT doc_id, " + ", ".join(f'{e} AS has_{n}' for n, e in FEATURE_SQL.items()) + ", regexp_matches(text, 'onand|eauai') AS handmade FROM documents")
def title_features(spark, sf):
    return V.documents(spark, sf).select("doc_id", *[c.alias(f"has_{n}") for n, c in T.title_features("text").items()],
                                         F.col("text").rlike("onand|eauai").alias("handmade"))


LABELLED_SOURCE = "CASE source WHEN 'MACHINERY' THEN 'ranking:' || category WHEN 'BUILDING' THEN 'weekly:1998第12期' ELSE source END"


def labelled_source():
    return (F.when(F.col("source") == "MACHINERY", F.concat(F.lit("ranking:"), F.col("category")))
            .when(F.col("source") == "BUILDING", F.lit("weekly:1998第12期")).otherwise(F.col("source")))


@query("derived_features", ["scored"], f"""SELECT item_id, trusted, round(age, 6) AS age, round(lv, 6) AS log_view, round(log10(age), 6) AS log_age,
  round(log10(greatest(duration, 1)), 6) AS log_duration, CASE WHEN starts_with(label, 'ranking:') OR starts_with(label, 'newlist:') THEN split_part(label, ':', 2) ELSE category END AS zone,
  CAST(CASE WHEN regexp_matches(label, '\\d{{4}}第') THEN CAST(regexp_extract(label, '(\\d{{4}})第', 1) AS BIGINT) ELSE year END AS BIGINT) AS year
  FROM (SELECT *, {LABELLED_SOURCE} AS label, view >= 1000 AND (like_cnt > 0 OR coin > 0) AS trusted FROM scored)""")
def derived_features(spark, sf):
    label = F.col("label")
    early = F.regexp_extract(label, r"(\d{4})第", 1)
    return V.scored(spark, sf).withColumn("label", labelled_source()).select(
        "item_id", ((F.col("view") >= 1000) & ((F.col("like_cnt") > 0) | (F.col("coin") > 0))).alias("trusted"),
        "age", F.col("lv").alias("log_view"), F.log10("age").alias("log_age"),
        F.log10(F.greatest(F.col("duration"), F.lit(1))).alias("log_duration"),
        F.when(label.startswith("ranking:") | label.startswith("newlist:"), F.split_part(label, F.lit(":"), F.lit(2))).otherwise(F.col("category")).alias("zone"),
        F.when(early != "", early.try_cast("long")).otherwise(F.col("year")).alias("year"))


@query("comment_fingerprint", [], """SELECT conv_id, count(*) AS comments, round(avg(CASE WHEN regexp_matches(text, 'https?://|www|@|tion') THEN 1e0 ELSE 0e0 END), 6) AS contact_share,
  round(avg(CASE WHEN regexp_matches(text, 'thank|merci|que|gracias') THEN 1e0 ELSE 0e0 END), 6) AS thanks_share FROM conversations GROUP BY conv_id""")
def comment_fingerprint(spark, sf):
    def share(p):
        return F.avg(F.col("text").rlike(p).cast("double"))
    return V.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("comments"), share("https?://|www|@|tion").alias("contact_share"), share("thank|merci|que|gracias").alias("thanks_share"))


@query("recall_priority_blend", ["banded"], "SELECT item_id, round(0.9e0 * pct + 0.1e0 * least(fav_rate, 1), 6) AS priority, round(pct, 6) AS without_taste FROM banded")
def recall_priority_blend(spark, sf):
    taste = F.least(F.col("fav_rate"), F.lit(1.0))
    return V.banded(spark, sf).select("item_id", (0.9 * F.col("pct") + 0.1 * taste).alias("priority"), F.col("pct").alias("without_taste"))


BUCKET_SQL = "CASE WHEN contains(source, 'AUTO') THEN 'search' WHEN contains(source, 'BUILD') THEN 'ranking' WHEN contains(source, 'FURN') THEN 'homefeed' ELSE 'home' END"


@query("source_bucket", ["items"], f"SELECT item_id, {BUCKET_SQL} AS bucket, strftime(pub_ts, '%Y%m%d') = '19980505' AS is_new FROM items")
def source_bucket(spark, sf):
    return V.items(spark, sf).select("item_id", R.source_bucket(F.col("source"), "AUTO", "BUILD", "FURN").alias("bucket"),
                                     (F.date_format("pub_ts", "yyyyMMdd") == "19980505").alias("is_new"))
