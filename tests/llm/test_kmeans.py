"""Sharded clustering against plain Lloyd rounds."""

import hashlib
import math
import random

import duckdb
import pytest

from reactrix.llm import kmeans
from reactrix.llm.queries import ORACLES, QUERIES
from tools.parity import compare, connect

SMALL = "/root/testdata/sf0.001"


def plain(rows, dims, k, rounds, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, at) if a == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    return sorted(found, key=str), [",".join(map(str, c)) for c in centres]


def vectors(dims, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, [float(rng.gauss(i % 4, 0.7)) for _ in range(dims)]) for i in range(n)]
    same = [0.25] * dims
    rows += [(10_000 + i, same) for i in range(n // 2)]  # a third of the rows are equal
    rows += [(5, rows[5][1]), (None, same), (None, None), (901, None), (902, same[:-1]), (903, [*same, 1.0]), (904, []), (905, [None, *same[1:]]),
             (906, [math.nan, *same[1:]]), (907, [math.inf, *same[1:]]), (908, [-math.inf, *same[1:]]), (909, [-0.01] * dims)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster string, block int, id int")


@pytest.mark.parametrize("dims,k,blocks", [(6, 3, 1), (7, 5, 3), (8, 4, 8)])
def test_matches_plain_rounds(spark, dims, k, blocks, monkeypatch):
    monkeypatch.setattr(kmeans, "ROWS", 17)
    rows = vectors(dims, 120)
    out, centroids = kmeans.cluster(frame(spark, rows), dims=dims, k=k, blocks=blocks)
    want, centres = plain(rows, dims, k, 3)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out.collect()), key=str) == want
    got = {r.cluster: r for r in centroids.collect()}
    assert [got[n].centroid for n in range(len(centres))] == centres
    for n, c in enumerate(centres):
        mine = [d for _, a, d in want if a == n]
        assert (got[n].size, got[n].cluster_inertia) == (len(mine), sum(mine))
        assert got[n].centroid_sha256 == hashlib.sha256(c.encode()).hexdigest()


def test_empty_clusters_stay(spark):
    """Two equal starts: ties go to the smaller number, the other one keeps its place."""
    rows = [(i, [1.0, 2.0]) for i in range(6)] + [(7, [40.0, 40.0])]
    out, centroids = kmeans.cluster(frame(spark, rows), dims=2, k=6, blocks=2)
    want, centres = plain(rows, 2, 6, 3)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out.collect()), key=str) == want
    assert [r.centroid for r in centroids.orderBy("cluster").collect()] == centres
    assert sum(r.size == 0 for r in centroids.collect()) >= 4


def test_fewer_vectors_than_centroids_and_none(spark):
    out, centroids = kmeans.cluster(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])]), dims=2, k=16, blocks=2)
    assert out.count() == 2 and centroids.count() == 2
    out, centroids = kmeans.cluster(frame(spark, [(1, [1.0]), (2, None)]), dims=2, k=16, blocks=2)
    assert out.columns == ["vec_id", "cluster", "distance"] and out.count() == centroids.count() == 0


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="exact distances"):
        kmeans.cluster(frame(spark, [(1, [1e30, 2.0]), (2, [3.0, 4.0])]), dims=2, k=1, blocks=2)


def test_packing_widths():
    import numpy as np

    for top in (3, 300, 70_000, 2**40):
        x = np.array([[-top, top], [0, 1]])
        assert (kmeans.unpacked(kmeans.packed(x), 2, 2) == x).all()


def test_query_matches_duckdb(spark):
    df = QUERIES["op12_sharded_kmeans"](spark, SMALL)
    assert df.count() == duckdb.sql(f"SELECT count(*) AS n FROM '{SMALL}/embeddings.parquet'").fetchall()[0][0]
    assert compare(df.collect(), df.columns, connect(SMALL).sql(ORACLES["op12_sharded_kmeans"])) is None
