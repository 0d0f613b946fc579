"""Directional depth in a neighbourhood's own behaviour subspace, and vectors of users."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..session import drop_stage, stage

# Number of directions, their seed, kept variance, least norm after projection.
DIRECTIONS, DIRECTION_SEED, KEPT, LEAST_NORM = 38, 20260902, 0.85, 0.3
WHOLE = 1_000_000  # rows of a neighbourhood that one task ranks in memory, about 200 MB


def directions(dims: int) -> np.ndarray:
    """Axes, the even direction, then random unit vectors from the fixed seed."""
    rng = random.Random(DIRECTION_SEED)
    fixed = [*np.eye(dims), np.full(dims, dims ** -0.5)]
    drawn = np.array([[rng.gauss(0, 1) for _ in range(dims)] for _ in range(DIRECTIONS - len(fixed))])
    return np.vstack([fixed, drawn / np.linalg.norm(drawn, axis=1, keepdims=True)])


def subspaces(moments: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Per neighbourhood, from its covariance row: projected directions and the projector.  Rows are tiny and independent."""
    d, dirs = len(xs), directions(len(xs))
    iu = np.triu_indices(d)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.schema.fields if f.name in keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cov = np.zeros((len(batch), d, d))
            flat = batch[[f"c{i}_{j}" for i, j in zip(*iu)]].to_numpy(dtype=float)
            cov[:, iu[0], iu[1]] = flat
            cov[:, iu[1], iu[0]] = flat
            values, vectors = np.linalg.eigh(cov)
            rows = []
            for value, vector in zip(values[:, ::-1], vectors[:, :, ::-1]):
                k = max(2, int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-12), KEPT)) + 1)
                projector = vector[:, :k] @ vector[:, :k].T
                moved = dirs @ projector
                norm = np.linalg.norm(moved, axis=1)
                keep = np.flatnonzero(norm > LEAST_NORM)
                units = [(int(i), (moved[i] / norm[i]).tolist()) for i in keep] or [(0, vector[:, 0].tolist())]
                rows.append((units, projector.ravel().tolist()))
            out = batch[list(keys)].copy()
            out["units"] = [[{"dir": i, "u": u} for i, u in units] for units, _ in rows]
            out["projector"] = [p for _, p in rows]
            yield out

    return moments.mapInPandas(solve, f"{fields}, units array<struct<dir:int,u:array<double>>>, projector array<double>")


def _whole(rows: DataFrame, cells: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Best direction per row of neighbourhoods that one task holds: nine numbers per row are shuffled, no row per direction."""
    d, fields = len(xs), {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def rank(rows: pa.Table, cell: pa.Table) -> pa.Table:
        n = len(rows) if len(cell) else 0
        rows = rows.slice(0, n)
        empty, best = np.zeros(n, dtype=bool), {"d": np.full(n, -1.0), "dir": np.zeros(n, dtype=np.int32), "proj": np.zeros(n)}
        x = [rows[c].to_numpy() for c in xs]
        eligible, orth = pa.nulls(n, pa.bool_()), np.zeros(n)
        if n:
            row = cell.to_pylist()[0]
            for c in xs:  # one null leaves no projection
                empty |= rows[c].is_null().to_numpy()
            x = [np.where(empty, 0.0, v - row[f"m{i}"]) for i, v in enumerate(x)]
            for unit in row["units"]:
                proj = x[0] * unit["u"][0]
                for i in range(1, d):
                    proj = proj + x[i] * unit["u"][i]
                less = np.searchsorted(np.sort(proj[~empty]), proj) + empty.sum()  # rows without one come first
                place = (np.where(empty, 0, less) + 1) / row["cell_n"]
                better = place > best["d"]
                for name, v in (("d", place), ("dir", unit["dir"]), ("proj", proj)):
                    best[name] = np.where(better, v, best[name])
            p = row["projector"]
            for i in range(d):
                inside = x[0] * p[i * d]
                for j in range(1, d):
                    inside = inside + x[j] * p[i * d + j]
                orth = orth + (x[i] - inside) * (x[i] - inside)
            eligible = pc.or_(pc.greater_equal(rows["f7"], pa.scalar(row["p50_f7"], pa.float64())), pc.is_nan(rows["f7"]))  # as Spark orders NaN
        return pa.table({
            "item_id": rows["item_id"], "d": best["d"], "dir": best["dir"].astype(np.int32), "proj": pa.array(best["proj"], mask=empty),
            "eligible": eligible, "orth": pa.array(np.sqrt(orth), mask=empty)})

    held = rows.join(cells.select(*keys), list(keys), "left_semi").withColumns({c: F.col(c).cast("double") for c in ("f7", *xs)})
    return held.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(
        rank, f"item_id {fields['item_id']}, d double, dir int, proj double, eligible boolean, orth double")


def _best(found: DataFrame) -> DataFrame:
    top = found.groupBy("item_id").agg(
        F.max_by(F.struct("d", "dir", "proj"), F.struct("d", -F.col("dir"))).alias("b"),
        F.first("eligible").alias("eligible"), F.first("orth").alias("orth"))
    return top.select("item_id", "b.*", "eligible", "orth")


def _spread(rows: DataFrame, cells: DataFrame, keys: Sequence[str], xs: Sequence[str], block: int) -> DataFrame:
    """Best direction per row of larger neighbourhoods: ranks are positions over (neighbourhood, direction), a few directions
    at a time, and each layout is deleted before the next."""
    d = len(xs)

    def dot(a, b):
        return sum((a[i] * b[i] for i in range(1, d)), a[0] * b[0])

    rows = rows.join(cells, list(keys)).withColumn("x", F.array(*[F.col(x) - F.col(f"m{i}") for i, x in enumerate(xs)]))
    inside = [sum((F.col("x")[j] * F.col("projector")[i * d + j] for j in range(1, d)), F.col("x")[0] * F.col("projector")[i * d]) for i in range(d)]
    orth = F.sqrt(sum(((F.col("x")[i] - inside[i]) * (F.col("x")[i] - inside[i]) for i in range(d)), F.lit(0.0)))
    best = None
    for low in range(0, DIRECTIONS, block):
        units = F.filter("units", lambda u: u["dir"].between(low, low + block - 1))
        long = rows.select("item_id", *keys, "cell_n", (F.col("f7") >= F.col("p50_f7")).alias("eligible"), orth.alias("orth"), "x", F.explode(units).alias("unit")).select(
            "item_id", *keys, "cell_n", "eligible", "orth", F.col("unit.dir").alias("dir"), dot(F.col("x"), F.col("unit.u")).alias("proj"))
        placed = O.positions(long, [*keys, "dir"], ["proj", "item_id"], ties=["proj"])
        found = _best(placed.withColumn("d", (F.col("tie_first") + 1) / F.col("cell_n")))
        both = stage(found if best is None else _best(best.unionByName(found)), "best-directions")
        for done in (placed, *([] if best is None else [best])):
            drop_stage(done)
        best = both
    return best


def directional_depth(df: DataFrame, keys: Sequence[str], xs: Sequence[str], min_n: int = 16, whole: int = WHOLE, block: int = 4) -> DataFrame:
    """item_id, depth (null under the neighbourhood's median rate), best direction and off-subspace norm.

    Neighbourhoods of up to `whole` rows are ranked in one task's memory; larger ones are spread, `block` directions at a time.
    """
    d = len(xs)
    moments = stage(df.groupBy(*keys).agg(
        F.count("*").alias("cell_n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
        *[F.covar_samp(xs[i], xs[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).filter(F.col("cell_n") >= min_n), "moments")
    med = O.quantiles(df, keys, {"f7": "f7"}, {"p50": 0.5}).drop("n")
    cells = stage(subspaces(moments, keys, xs).join(moments.select(*keys, "cell_n", *[f"m{i}" for i in range(d)]), list(keys)).join(med, list(keys)), "cells")
    rows, large = df.select("item_id", *keys, "f7", *xs), cells.filter(F.col("cell_n") > whole)
    best = _whole(rows, cells.filter(F.col("cell_n") <= whole), keys, xs)
    if not large.isEmpty():
        best = best.unionByName(_spread(rows, large, keys, xs, block))
    depth = F.when(F.col("eligible"), F.when(F.col("proj") > 0, F.col("d")).otherwise(0.0))
    return _best(best).select("item_id", depth.alias("depth"), F.when(F.col("eligible"), F.col("dir")).alias("dir"), "orth")


def main_axes(names: Sequence[str]) -> list[str]:
    """Name of the largest component of each direction, with '-' for a negative one."""
    dirs = directions(len(names))
    top = np.abs(dirs).argmax(axis=1)
    return [names[t] + ("+" if dirs[i, t] > 0 else "-") for i, t in enumerate(top)]
