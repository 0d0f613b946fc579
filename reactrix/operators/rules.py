"""Decision tables as Column expressions: feed cascade, percentile tiers, signatures, reviews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import scores as S



def strings(*cols: Column) -> Column:
    return F.array_compact(F.array(*cols))


def contains_any(text: Column | str, words: Sequence[str]) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def words_found(text: Column | str, words: Sequence[str]) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    if not words:
        return F.array().cast("array<string>")
    return strings(*[F.when(text.contains(w), F.lit(w)) for w in words])


def matches_any(text: Column | str, patterns: Sequence[str]) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))


def filter_reasons(items: DataFrame, keywords: Sequence[str], live: Column, hide=("junk",), hide_unproven=False) -> DataFrame:
    """Stacked reasons of the batch scorer; literal keywords."""
    ratio = S.weighted_ratio("view")
    tier = S.absolute_tier(ratio)
    hidden = [*hide, "unproven"] if hide_unproven else list(hide)
    dur, view, title = S.zero("duration"), S.zero("view"), F.coalesce(F.col("title"), F.lit(""))
    found = words_found(title, [k for k in keywords if k])
    reasons = strings(
        F.when((dur > 0) & (dur <= 75), F.format_string("short(%ds)", dur)),
        F.when(S.portrait(), F.lit("portrait")),
        F.when(live, F.lit("live")),
        F.when(view < 1000, F.format_string("low_views(%d)", view)),
        F.when(F.size(found) > 0, F.concat(F.lit("keyword:"), F.array_join(found, "|"))),
        F.when(tier.isin(*hidden), F.concat(F.lit("tier "), tier, F.format_string("(%.3f)", ratio))))
    return (items.withColumn("ratio", ratio).withColumn("abs_tier", tier).withColumn("reasons", reasons)
            .withColumn("filtered", F.size("reasons") > 0))


def feed_verdict(scored: DataFrame, rules: P.FeedRules) -> DataFrame:
    """Ordered feed cascade; adds hide, reasons, first_reason, verdict_index, tag, verdict_tier."""
    view, dur, title = F.col("view"), S.zero("duration"), F.coalesce(F.col("title"), F.lit(""))
    live = F.col(rules.live_column) if rules.live_column else F.lit(False)
    exempt = contains_any(F.coalesce(F.col("category"), F.lit("")), rules.whitelist)
    if rules.official_column:
        exempt = exempt | F.col(rules.official_column)
    hidden = [*rules.hide_tiers, "unproven"] if rules.hide_unproven else list(rules.hide_tiers)
    indexed = (view >= rules.index_min_view) & ~exempt
    below = indexed & (F.col("cbi") < rules.index_floor)
    ratio_tier = S.absolute_tier("f7")
    weak = ratio_tier.isin(*hidden) & ~exempt & ~below
    if rules.index_pass_exempts:
        weak = weak & ~indexed
    if rules.low_view_suppresses_tier:
        weak = weak & (view >= rules.min_views)
    early = F.when(live, F.lit("live")).when((dur > 0) & (dur <= rules.short_max), F.lit("short")).when(
        matches_any(title, rules.block), F.lit("signature"))
    late = strings(
        F.when(S.portrait(), F.lit("portrait")),
        F.when(view < rules.min_views, F.lit("low_views")),
        F.when(below, F.lit("index")),
        F.when(weak, F.lit("tier")))
    return (
        scored.withColumn("_early", early)
        .withColumn("reasons", F.when(F.col("_early").isNotNull(), F.array("_early")).otherwise(late))
        .withColumn("hide", F.size("reasons") > 0)
        .withColumn("first_reason", F.when(F.col("hide"), F.element_at("reasons", 1)))
        .withColumn("verdict_index", F.when(F.col("_early").isNull() & indexed, F.col("cbi")))
        .withColumn("tag", F.col("_early").isNull() & matches_any(title, rules.begging))
        .withColumn("verdict_tier", F.when(F.col("_early").isNull(), F.when(below, "junk").otherwise(ratio_tier)))
        .drop("_early"))


def sympathy(title: Column | str, strong: Sequence[str], weak: Sequence[str]) -> tuple[Column, Column]:
    """(hit, note): one strong word, or two distinct weak words; at most three words are named."""
    title = F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))
    s, w = words_found(title, strong), words_found(title, weak)
    note = (F.when(F.size(s) > 0, F.concat(F.lit("strong:"), F.array_join(F.slice(s, 1, 3), "/")))
            .when(F.size(w) >= 2, F.concat(F.lit("weak:"), F.array_join(F.slice(w, 1, 3), "/"))))
    return note.isNotNull(), note


TIER_NAMES = ("poor", "plain", "fine", "top")


def percentile_tier(df: DataFrame, rules: P.TierRules, pct: str = "pct", out: str = "ptier", fired: str = "fired") -> DataFrame:
    """Percentile decision table over an integer level; rule ids that fired are kept in order."""
    p, dur, title = F.col(pct), S.zero("duration"), F.coalesce(F.col("title"), F.lit(""))
    fav, coin, like = F.col("fav_rate"), F.col("coin_rate"), F.col("like_rate")
    base = F.when(p >= rules.top, 3).when(p >= rules.fine, 2).when(p < rules.plain, 0).otherwise(1)
    short = (dur > 0) & (dur < rules.short_cap)
    cut = (dur > 0) & ~short & ((dur <= rules.duration_cut) if rules.duration_cut_inclusive else (dur < rules.duration_cut))
    if rules.coin_floor_infinite:
        heavy = (coin <= 1e-6) | (fav / coin > rules.hoard_ratio)
    else:
        heavy = fav / F.greatest(coin, F.lit(1e-6)) > rules.hoard_ratio
    hoard = heavy & (fav > rules.hoard_fav)
    edge = (like > rules.edge_like) & (coin < rules.edge_coin) & (fav > rules.edge_fav)
    known = F.lit(True) if rules.missing_is_plain else p.isNotNull()
    out_df = df.withColumn("_l0", base)
    out_df = out_df.withColumn("_cut", cut & (F.col("_l0") == 3))
    out_df = out_df.withColumn("_l1", F.when(short, F.least("_l0", F.lit(1))).when(F.col("_cut"), 2).otherwise(F.col("_l0")))
    lowered = hoard | edge if rules.edge_cuts else hoard
    out_df = out_df.withColumn("_l2", F.when(lowered, F.least("_l1", F.lit(2))).otherwise(F.col("_l1")))
    hit, note = sympathy(title, rules.strong, rules.weak)
    support = ((coin > fav) | (coin > like)) & (p >= rules.support_guard) if rules.support else F.lit(False)
    level = F.when(hit, F.greatest(F.col("_l2") - 1, F.lit(0))).otherwise(F.col("_l2"))
    name = F.element_at(F.array(*[F.lit(n) for n in TIER_NAMES]), (level + 1).cast("int"))
    names = strings(
        F.when(short, "R2a"), F.when(F.col("_cut"), "R2b"), F.when(hoard, "R3"), F.when(edge, "R4"),
        F.when(hit, F.concat(F.lit("R10 "), note)), F.when(~hit & support, "R9"))
    return (out_df.withColumn(out, F.when(known, name).otherwise("none"))
            .withColumn(fired, F.when(known, names).otherwise(F.array().cast("array<string>")))
            .drop("_l0", "_l1", "_l2", "_cut"))


def signature(like="like_rate", coin="coin_rate", fav="fav_rate") -> Column:
    return (F.col(like) > 0.20) & (F.col(coin) < 0.02) & (F.col(fav) > 0.10)


def near_miss() -> Column:
    like, coin, fav = F.col("like_rate"), F.col("coin_rate"), F.col("fav_rate")
    return (F.when(signature(), "signature")
            .when((coin < 0.02) & (fav > 0.10) & (like > 0.12) & (like <= 0.20), "near_a")
            .when((like > 0.20) & (coin < 0.02) & (fav <= 0.10), "near_b")
            .when((like > 0.20) & (coin >= 0.02) & (coin < 0.04) & (fav > 0.10), "near_c").otherwise("none"))


def closest_line() -> Column:
    """struct(ratio, name) of the condition nearest to its line."""
    return F.array_min(F.array(*[
        F.struct((F.col(f"{n}_rate") / F.lit(line)).alias("ratio"), F.lit(n).alias("name"))
        for n, line in (("like", 0.20), ("coin", 0.02), ("fav", 0.10))]))


def topic_named(normal: Column, topics: Sequence[str] = P.TOPIC_NAMES) -> Column:
    """Whether a folded title names one of the topics, given as patterns; an empty list names none."""
    return normal.rlike("|".join(f"(?:{t})" for t in topics)) if topics else F.lit(False)


def review_cell() -> Column:
    fired, view, dur = signature(), F.col("view"), S.zero("duration")
    sincerity = F.try_divide(F.col("coin_rate"), F.col("fav_rate"))
    small, large = view < 100_000, view >= 300_000
    return (F.when(fired & small & (dur > 0) & (dur <= 21), "A")
            .when(fired & small & (dur > 21) & (dur <= 45), "B")
            .when(fired & small & (dur > 45), "C")
            .when(~fired & large & (sincerity <= 0.11), "D")
            .when(~fired & large & (sincerity > 0.11) & (sincerity <= 0.20), "E")
            .when(~fired & small & (near_miss() == "near_a"), "F")
            .when(~fired & small, "G"))


def review_cell_faces(faces: Column) -> Column:
    fired, view, dur = signature(), F.col("view"), S.zero("duration")
    small = view < 100_000
    return (F.when(fired & small & (dur > 0) & (dur <= 21) & (faces >= 1), "T1")
            .when(fired & small & (dur > 0) & (dur <= 21) & (faces == 0), "T2")
            .when(fired & small & (dur > 21), "T3")
            .when(~fired & small & (faces >= 1), "C1")
            .when(~fired & (view >= 300_000) & (F.col("fav_rate") > 0)
                  & (F.col("coin_rate") / F.col("fav_rate") <= 0.11) & (faces >= 1), "H1")
            .when(~fired & small, "G"))


def verdict_group(text: Column | str, words=None) -> Column:
    """Free-text verdict to five groups; first match wins, negated praise loses the top group."""
    text = F.col(text) if isinstance(text, str) else text
    words = words or P.VERDICT_WORDS
    return (F.when(contains_any(text, words["reject"]), "reject")
            .when(contains_any(text, words["top"]) & ~contains_any(text, words["top_negated"]), "top")
            .when(contains_any(text, words["utility"]), "utility")
            .when(contains_any(text, words["fine"]), "fine").otherwise("unclear"))


def approved_positive(verdict: Column | str, id_col: str, positive=P.TOP_VERDICT_WORD, negatives=P.APPROVAL_NEGATIVES) -> Column:
    verdict = F.trim(F.coalesce(F.col(verdict) if isinstance(verdict, str) else verdict, F.lit("")))
    return F.col(id_col).isNotNull() & verdict.contains(positive) & ~contains_any(verdict, negatives)


REVIEW_SCHEMA = "craft string, resonance string, reason string, watched string, evidence string, schema string"


def validated_reviews(df: DataFrame, payload: str, schema_name: str) -> DataFrame:
    """Parse review JSON keeping only known fields; `problem` is null for a valid row.

    Fields are read as JSON text, so 1.0, "1" and true are told apart from the integer 1.
    """
    def raw(name):
        return F.get_json_object(payload, f"$.{name}")

    def bad_axis(name):
        return raw(name).isNotNull() & ~F.col(payload).rlike(rf'"{name}"\s*:\s*(?:[0-3]|null)\s*[,}}]')

    def not_bool(name):
        return F.col(payload).rlike(rf'"{name}"\s*:') & ~F.col(payload).rlike(rf'"{name}"\s*:\s*(?:true|false)\s*[,}}]')

    problem = (F.when(raw("schema").isNull() | (raw("schema") != schema_name), "schema")
               .when(bad_axis("craft"), "craft").when(bad_axis("resonance"), "resonance")
               .when(raw("reason").isNotNull() & ~raw("reason").isin("", *P.REVIEW_REASONS), "reason")
               .when(not_bool("watched"), "watched")
               .when(F.col(payload).rlike(r'"evidence"\s*:\s*[^"\s]'), "evidence"))
    return df.withColumn("problem", problem).withColumn("craft", raw("craft").try_cast("int")).withColumn(
        "resonance", raw("resonance").try_cast("int")).withColumn("reason", raw("reason")).withColumn(
        "watched", raw("watched").try_cast("boolean")).withColumn("evidence", raw("evidence"))


def review_status(craft="craft", resonance="resonance", reason="reason", watched="watched", evidence="evidence") -> Column:
    c, r, why = F.col(craft), F.col(resonance), F.col(reason)
    complete = (c.between(0, 3) & r.between(0, 3) & why.isin(*P.REVIEW_REASONS)
                & (F.trim(F.coalesce(F.col(evidence), F.lit(""))) != ""))
    return (F.when(~F.coalesce(F.col(watched), F.lit(False)), "unreviewed")
            .when(~F.coalesce(complete, F.lit(False)), "incomplete")
            .when((c >= 2) & (r >= 2) & (why == "craft_expression"), "confirmed").otherwise("not_fit"))


def category(zone: str, title: str, zone_table, keyword_table, other: str = "other") -> tuple[Column, Column]:
    """(category, provenance) from ordered zone substrings, then ordered title keywords."""
    z, t = F.coalesce(F.col(zone), F.lit("")), F.coalesce(F.col(title), F.lit(""))
    cat, src = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for words, name in zone_table:
        hit = contains_any(z, words)
        cat, src = cat.when(hit, name), src.when(hit, "zone")
    for name, words in keyword_table:
        cat = cat.when(contains_any(t, words), name)
    return cat.otherwise(other), src.otherwise("keyword")


def first_pattern(text: Column | str, table, other: str) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    out = F.when(F.lit(False), "")
    for name, pattern in table:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def screen_flags(title: str, number_flag: Column, rules: P.ScreenRules) -> Column:
    t = F.coalesce(F.col(title), F.lit(""))
    return strings(
        F.when(S.zero("duration") <= rules.short_max, "short"),
        F.when(contains_any(t, rules.title_words), "title_review"),
        F.when(signature(), "interaction_review"), number_flag)


def blacklist_filter(df: DataFrame, ids: DataFrame, owners: DataFrame, owner_ids: DataFrame) -> DataFrame:
    """Three anti joins on single keys (an OR join would become a nested loop); Spark sizes each side."""
    return (df.join(ids, "item_id", "left_anti").join(owners, "owner_name", "left_anti")
            .join(owner_ids, "owner_id", "left_anti"))


def source_bucket(label: Column, search="search", ranking="rank", feed="feed") -> Column:
    return (F.when(label.contains(search), "search").when(label.contains(ranking), "ranking")
            .when(label.contains(feed), "homefeed").otherwise("home"))
