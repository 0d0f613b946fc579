"""Exact positions, ranks, running sums and quantiles without one task per group.

Rows are range partitioned on (group keys, sort keys), so one large group is spread over many
partitions.  A position is the row's index in its partition plus the rows of the partitions before.
At most one group (or one run of equal values) continues across each partition edge, so the tables
of groups and runs that span partitions hold at most one row per partition and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

_IDX_BITS = 33  # layout of monotonically_increasing_id: partition above, row index below


def _keys(order: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def range_layout(df: DataFrame, keys: Sequence, weights: Sequence[str] = ()) -> DataFrame:
    """Sorted, range-partitioned table with `_pid`, global `_pos` and running sums `_cum_<w>` before the row.

    Weights are whole numbers.
    """
    keys = _keys(keys)
    laid = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_pid", F.shiftright("_mid", _IDX_BITS))
    parts = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(w).alias(w) for w in weights])
    rows = {r["_pid"]: r for r in parts.collect()}  # one small row per range partition
    last = max(rows, default=-1)

    def before(name: str) -> tuple[Column, int]:
        """Amount held by earlier partitions, looked up by partition number, and the total."""
        sizes = [int(rows[i][name] or 0) if i in rows else 0 for i in range(last + 1)]
        starts = [0, *accumulate(sizes)]
        return F.expr("array(" + ",".join(f"{v}L" for v in starts[:-1] or [0]) + ")").getItem(F.col("_pid").cast("int")), starts[-1]

    offset, total = before("_rows")
    index = F.col("_mid").bitwiseAND(F.lit((1 << _IDX_BITS) - 1))
    here = F.expr("array(" + ",".join(f"{int(rows[i]['_rows']) if i in rows else 0}L" for i in range(max(last + 1, 1))) + ")").getItem(F.col("_pid").cast("int"))
    laid = laid.withColumns({
        "_pos": offset + index, "_all_rows": F.lit(total).cast("long"), "_edge": (index == 0) | (index == here - 1)})
    local = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    for w in weights:
        offset, total = before(w)
        laid = laid.withColumns({
            f"_cum_{w}": offset + F.coalesce(F.sum(w).over(local), F.lit(0)), f"_all_{w}": F.lit(total).cast("long")})
    return laid


def _spanning(laid: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], prefix: str) -> DataFrame:
    """Aggregates of the keys that continue across a partition edge: at most one row per partition.

    Only the last key of a partition and the first of the next can continue, so those two rows of each partition tell
    which keys to aggregate.
    """
    edge = Window.orderBy("_mid")  # two rows per partition
    ends = laid.filter("_edge").select("_pid", "_mid", *keys, F.struct(*keys).alias("_key"))
    crossing = ends.withColumns({"_before": F.lag("_key").over(edge), "_from": F.lag("_pid").over(edge)}).filter(
        (F.col("_key") == F.col("_before")) & (F.col("_from") < F.col("_pid"))).select(*keys).distinct()
    rows = laid.join(F.broadcast(crossing), list(keys), "left_semi")
    return F.broadcast(rows.groupBy(*keys).agg(*[c.alias(prefix + n) for n, c in aggs.items()]))


def positions(
    df: DataFrame, groups: Sequence[str], order: Sequence, *, ties: Sequence[str] = (), weights: Sequence[str] = ()
) -> DataFrame:
    """Add 0-based `pos` and `group_n`; per weight `<w>_before`/`<w>_total`; with ties `tie_first`/`tie_last`.

    Weights must be non-negative.  With ties, `<w>_below` counts only rows strictly below the tied value.
    Keys inside one partition use local windows, keys that span partitions use the broadcast table.
    """
    groups, ties = list(groups), list(ties)
    laid = range_layout(df, [*groups, *order], weights)
    out = laid
    if groups:
        aggs = {"_start": F.min("_pos"), "group_n": F.count(F.lit(1))}
        for w in weights:
            aggs |= {f"_wstart_{w}": F.min(f"_cum_{w}"), f"{w}_total": F.sum(w)}
        out = out.join(_spanning(laid, groups, aggs, "_g_"), groups, "left")
    else:  # one global group: the partition table already holds its totals
        out = out.withColumns({"_start": F.lit(0), "group_n": F.col("_all_rows")} | {
            k: v for w in weights for k, v in ((f"_wstart_{w}", F.lit(0)), (f"{w}_total", F.col(f"_all_{w}")))})
        aggs = {}
    runs = {}
    if ties:
        runs = {"_first": F.min("_pos"), "_last": F.max("_pos")} | {f"_low_{w}": F.min(f"_cum_{w}") for w in weights}
        out = out.join(_spanning(laid, [*groups, *ties], runs, "_t_"), [*groups, *ties], "left")
    by_group, by_run = Window.partitionBy("_pid", *groups), Window.partitionBy("_pid", *groups, *ties)
    out = out.withColumns(
        {n: F.coalesce(F.col("_g_" + n), c.over(by_group)) for n, c in aggs.items()}
        | {n: F.coalesce(F.col("_t_" + n), c.over(by_run)) for n, c in runs.items()})
    start = F.col("_start")
    final = {"pos": F.col("_pos") - start}
    for w in weights:
        final[f"{w}_before"] = F.col(f"_cum_{w}") - F.col(f"_wstart_{w}")
    if ties:
        final |= {"tie_first": F.col("_first") - start, "tie_last": F.col("_last") - start}
        final |= {f"{w}_below": F.col(f"_low_{w}") - F.col(f"_wstart_{w}") for w in weights}
    totals = ["group_n", *[f"{w}_total" for w in weights]]
    return out.select(*df.columns, *totals, *[c.alias(n) for n, c in final.items()])


def midranks(df: DataFrame, groups: Sequence[str], value: str, tie: str, out: str = "midrank") -> DataFrame:
    """1-based average rank of `value` inside each group; rows with a null value are left out."""
    ranked = positions(df.filter(F.col(value).isNotNull()), groups, [value, tie], ties=[value])
    return ranked.withColumn(out, (F.col("tie_first") + F.col("tie_last")) / 2.0 + 1.0).drop("tie_first", "tie_last", "pos")


def quantiles(
    df: DataFrame, groups: Sequence[str], measures: Mapping[str, Column | str], probs: Mapping[str, float],
    method: str = "linear", accuracy: int = 2000, small: int = 4096,
) -> DataFrame:
    """Exact quantiles, one column `<prob>_<measure>` each, plus `n` (largest non-null count of the group).

    linear: numpy's interpolation at p*(n-1).  upper: the sorted value at index floor(p*n).
    Selection by bracketing: a mergeable sketch of rank error n/accuracy brackets each wanted rank, one counting pass keeps
    values inside a bracket as they are and counts the rows between brackets, and only that histogram is sorted.  Groups of
    up to `small` values are bracketed whole.  A rank that fell between brackets would repeat the selection on all values.
    """
    groups = list(groups)
    flat = df.select(*groups, *[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"_v{i}") for i, c in enumerate(measures.values())])
    margin = 2.0 / accuracy
    cuts = [min(max(p + side, 0.0), 1.0) for p in probs.values() for side in (-margin, margin)]
    sketch = flat.groupBy(*groups).agg(*[c for i in range(len(measures)) for c in (
        F.count(f"_v{i}").alias(f"_n{i}"), F.percentile_approx(f"_v{i}", cuts, accuracy).alias(f"_s{i}"))])
    marked = _beside(flat, stage(sketch, "brackets"), groups)
    picks = _picks(_histogram(marked, groups, list(measures), len(cuts), small), groups, probs, method)
    if not picks.filter("_gap > 0").isEmpty():
        picks = _picks(_histogram(marked, groups, list(measures), 0, small), groups, probs, method)
    solved = picks.groupBy(*groups, "_measure", "_prob").agg(F.sum(F.col("_value") * F.col("_share")).alias("q"), F.max("n").alias("n"))
    return solved.groupBy(*groups).agg(
        F.max("n").alias("n"),
        *[F.max(F.when((F.col("_measure") == m) & (F.col("_prob") == label), F.col("q"))).alias(f"{label}_{m}")
          for m in measures for label in probs])


def _beside(big: DataFrame, small: DataFrame, groups: Sequence[str], limit: int = 200_000) -> DataFrame:
    """Rows with the columns of their group's row in a stored table; null keys meet null keys."""
    if not groups:  # one row
        row = small.first()
        return big.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in small.schema})
    few = small.count() <= limit
    named = small.withColumnsRenamed({g: f"_k_{g}" for g in groups})
    on = [F.col(g).eqNullSafe(F.col(f"_k_{g}")) for g in groups]
    return big.join(F.broadcast(named) if few else named.hint("merge"), on).drop(*[f"_k_{g}" for g in groups])


def _histogram(marked: DataFrame, groups: Sequence[str], names: Sequence[str], cuts: int, small: int) -> DataFrame:
    """(groups, _measure, _value, _gap, _held): values inside a bracket, and one row per gap, placed after the bracket below it.

    Without cuts every value is kept.
    """
    cells = []
    for i, name in enumerate(names):
        v, s = F.col(f"_v{i}"), F.col(f"_s{i}")
        inside, below = F.lit(not cuts) | (F.col(f"_n{i}") <= small), [F.lit(None).cast("double")] * 2
        for j in range(0, cuts, 2):
            inside = inside | ((v >= s[j]) & (v <= s[j + 1]))
            below.append(F.when(v > s[j + 1], s[j + 1]))
        cells.append(F.when(v.isNotNull(), F.struct(
            F.lit(name).alias("_measure"), F.when(inside, v).otherwise(F.greatest(*below)).alias("_value"),
            F.when(inside, F.lit(0)).otherwise(F.lit(1)).alias("_gap"))))
    long = marked.select(*groups, F.explode(F.array(*cells)).alias("_m")).filter(F.col("_m").isNotNull())
    return long.select(*groups, "_m.*").groupBy(*groups, "_measure", "_value", "_gap").agg(F.count(F.lit(1)).alias("_held"))


def _picks(histogram: DataFrame, groups: Sequence[str], probs: Mapping[str, float], method: str) -> DataFrame:
    """(groups, _measure, _prob, n, _value, _gap, _share): the histogram rows that hold the wanted ranks."""
    laid = range_layout(histogram, [*groups, "_measure", "_value", "_gap"], ["_held"])
    keys = [*groups, "_measure"]
    spans = laid.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_cum__held").alias("_start"), F.sum("_held").alias("n"))
    rows = laid.join(spans, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).withColumn("_low", F.col("_cum__held") - F.col("_start"))
    wants = []
    for label, p in probs.items():
        if method == "linear":
            x = F.lit(float(p)) * (F.col("n") - 1)
            lo, hi, frac = F.floor(x), F.ceil(x), x - F.floor(x)
        elif method == "upper":
            lo = hi = F.least(F.floor(F.lit(float(p)) * F.col("n")), F.col("n") - 1)
            frac = F.lit(0.0)
        else:
            raise ValueError(method)
        wants += [F.struct(F.lit(label).alias("_prob"), at.alias("_at"), share.alias("_share")) for at, share in ((lo, 1.0 - frac), (hi, frac))]
    here = F.filter(F.array(*wants), lambda w: (w["_share"] > 0) & (w["_at"] >= F.col("_low")) & (w["_at"] < F.col("_low") + F.col("_held")))
    return stage(rows.select(*groups, "_measure", "n", "_value", "_gap", F.explode(here).alias("_w")).select(
        *groups, "_measure", "n", "_value", "_gap", "_w._prob", "_w._share"), "picks")


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence, k: int, out: str = "rn") -> DataFrame:
    """First k rows per group; Spark prunes each partition to k rows per group before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*_keys(order))
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def join_counted(big: DataFrame, small: DataFrame, on: Sequence[str], limit: int = 200_000) -> DataFrame:
    """Join to a stored side whose rows are counted first: broadcast up to `limit` rows, sort-merge beyond.

    For a big side that grew by explode: the planner does not see the growth and might broadcast that side.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), list(on))
    return big.join(small.hint("merge"), list(on))
