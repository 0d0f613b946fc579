"""Picks, diverse orders and review samples that keep caps per owner, form or stratum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions.stats import draw


def greedy_picks(pool: DataFrame, order: Sequence[str], count: int = 5, per_form: int = 2) -> DataFrame:
    """First `count` rows in order with distinct owners and at most `per_form` of a form.

    A form's next pick is its best row whose owner is free.  At most count-1 owners are taken, so the best
    row per (form, owner), cut to per_form + count - 1 rows per form, always holds the answer.  The walk
    over those forms x (per_form + count - 1) rows is the only sequential step.
    """
    key = ["form", "owner_id"]
    best = O.top_per_group(pool, key, [*order, "item_id"], 1, "_o")
    short = O.top_per_group(best, ["form"], [*order, "item_id"], per_form + count - 1, "_f")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, "item_id"])
        owners, forms, keep = set(), {}, []
        for row in rows.itertuples():
            if row.owner_id in owners or forms.get(row.form, 0) >= per_form or len(keep) == count:
                continue
            owners.add(row.owner_id)
            forms[row.form] = forms.get(row.form, 0) + 1
            keep.append(row.Index)
        out = rows.loc[keep, ["item_id", "form", "owner_id"]].copy()
        out["slot"] = range(1, len(out) + 1)
        return out

    return short.select("item_id", "form", "owner_id", *order).groupBy().applyInPandas(
        walk, "item_id long, form string, owner_id long, slot long")


def round_robin(df: DataFrame, order: Sequence, per_owner: int = 2) -> DataFrame:
    """First two rows of each owner interleaved by the owner's first position, then the rest in order."""
    placed = O.positions(df.select("item_id", "owner_id", *[c for c in order if isinstance(c, str)]) if all(
        isinstance(c, str) for c in order) else df, [], [*order, "item_id"]).select("item_id", "owner_id", "pos")
    heads = O.top_per_group(placed, ["owner_id"], ["pos"], per_owner, "round")
    first = heads.filter("round = 1").select("owner_id", F.col("pos").alias("first_pos"))
    front = heads.join(first, "owner_id").select("item_id", "owner_id", "round", F.col("first_pos").alias("k"))
    rest = placed.join(heads.select("item_id"), "item_id", "left_anti").select(
        "item_id", "owner_id", F.lit(per_owner + 1).alias("round"), F.col("pos").alias("k"))
    return O.positions(front.unionByName(rest), [], ["round", "k"]).select("item_id", "owner_id", "round", (F.col("pos") + 1).alias("slot"))


def systematic(df: DataFrame, layer: str, k: int) -> DataFrame:
    """Every step-th row by id, at most k per layer."""
    placed = O.positions(df.select("item_id", layer), [layer], ["item_id"])
    step = F.greatest(F.lit(1), F.floor(F.col("group_n") / k))
    return placed.filter((F.col("pos") % step == 0) & (F.floor(F.col("pos") / step) < k)).withColumn(
        "slot", F.floor(F.col("pos") / step) + 1).select("item_id", layer, "slot")


def stratified(df: DataFrame, strata: Sequence[tuple[str, Column, int, Column | None]], seed: str) -> DataFrame:
    """Quota per stratum in hash order (or a given order); a row keeps its first stratum."""
    tags = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(i).alias("no"), F.lit(name).alias("stratum"), F.lit(quota).alias("quota"),
                              (key if key is not None else draw(F.concat_ws(":", F.lit(seed), F.lit(name), F.col("item_id")), 1 << 31).cast("double")).alias("key")))
        for i, (name, cond, quota, key) in enumerate(strata)]))
    rows = df.select("item_id", F.explode(tags).alias("t")).select("item_id", "t.*")
    top = O.top_per_group(rows, ["no"], ["key", "item_id"], max(s[2] for s in strata)).filter(F.col("rn") <= F.col("quota"))
    return top.groupBy("item_id").agg(F.min_by("stratum", "no").alias("stratum"))


def owner_capped(candidates: DataFrame, order: Sequence, taken: DataFrame | None, count: int, cap: int = 2) -> DataFrame:
    """First `count` candidates with at most `cap` per owner, counting rows already taken."""
    if taken is None:
        heads = O.top_per_group(candidates, ["owner_id"], [*order, "item_id"], cap, "_k")
    else:
        used = taken.groupBy("owner_id").agg(F.count("*").alias("_used"))
        heads = O.top_per_group(candidates.join(taken.select("item_id"), "item_id", "left_anti"), ["owner_id"], [*order, "item_id"], cap, "_k").join(
            used, "owner_id", "left").filter(F.col("_k") <= cap - F.coalesce("_used", F.lit(0)))
    return heads.orderBy(*O._keys(order), "item_id").limit(count).select("item_id", "owner_id")


def review_batch(rows: DataFrame, size: int = 24) -> DataFrame:
    """Half recall, a quarter cue check, the rest exploration; at most two rows per owner across arms."""
    arms = {
        "recall": ((F.size("motive_cues") == 0) & (F.size("screen_flags") == 0) & (F.col("ref_n") >= 30) & F.col("pct").isNotNull(),
                   [F.desc("pct"), "h"], max(1, size // 2)),
        "motive_check": (F.size("motive_cues") > 0, [F.desc_nulls_last("pct"), "h"], size // 4),
        "explore": (F.lit(True), ["h2"], size - max(1, size // 2) - size // 4),
    }
    taken, out = None, []
    for arm, (cond, order, count) in arms.items():
        got = owner_capped(rows.filter(cond), order, taken, count)
        out.append(got.withColumn("arm", F.lit(arm)))
        taken = got if taken is None else taken.unionByName(got)
    return reduce(DataFrame.unionByName, out)


def cell_quotas(df: DataFrame, quotas: Mapping[str, int], seed: str) -> DataFrame:
    """Hash-ordered quota per cell."""
    quota = F.element_at(F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))]), F.col("cell"))
    rows = df.filter(F.col("cell").isin(*quotas)).withColumn("h", draw(F.concat_ws(":", F.lit(seed), F.col("item_id")), 1 << 31)).withColumn("quota", quota)
    return O.top_per_group(rows, ["cell"], ["h", "item_id"], max(quotas.values())).filter("rn <= quota")


def seeds_by_bucket(df: DataFrame, bucket: str, value: str, count: int) -> DataFrame:
    """Best row of each bucket, buckets by their best value; refilled from all rows by value."""
    best = O.top_per_group(df, [bucket], [F.desc(value), "item_id"], 1).orderBy(F.desc(value), "item_id").limit(count).withColumn("round", F.lit(1))
    rest = df.orderBy(F.desc(value), "item_id").limit(2 * count).join(best.select("item_id"), "item_id", "left_anti").withColumn("round", F.lit(2))
    cols = ["item_id", bucket, value, "round"]
    return best.select(*cols).unionByName(rest.select(*cols)).orderBy("round", F.desc(value), "item_id").limit(count)
