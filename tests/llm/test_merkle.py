"""Fingerprints: equality, likeness, places of edits, and successors by id."""

import hashlib

from pyspark.sql import functions as F

from reactrix.llm import merkle

from .brute import awkward, prose, table


def test_successors(spark):
    rows = awkward() + [(50 + 3 * k, prose(k, 30 + k), "en", "s") for k in range(60)]
    order = sorted(((i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), t or "") for i, t, *_ in rows))
    want = [(None if a[0] else a[1], a[3], b[3]) for a, b in zip(order, order[1:] + order[:1])]
    for blocks in (1, 5, 200):
        got = [(r.doc_id, r.text, r.next_text) for r in merkle.with_successor(table(spark, rows), blocks).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_one_row_and_none(spark):
    r = merkle.with_successor(table(spark, [(7, "only one", None, None)])).collect()
    assert [(x.text, x.next_text) for x in r] == [("only one", "only one")]
    assert merkle.with_successor(table(spark, [])).count() == 0


def test_roots_tell_texts_apart(spark):
    texts = ["a b. c", "a b.\nc", "a b. \u0001c", "a b.  c", "", " ", "\n", "a b. c d e f g", "a b. c d e f  g"]
    df = merkle.with_fingerprint(spark.createDataFrame([(t,) for t in texts * 2], "text string"), "text", "tree")
    rows = df.collect()
    assert len({r.tree.split("/")[0] for r in rows}) == len(texts) == len({r.tree for r in rows})


def test_edits_are_located(spark):
    lines = [prose(k, 12) for k in range(6)]
    other = lines[:]
    other[3] = other[3].replace(" ", " new ", 1)
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "x string, y string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "x", "a"), "y", "b")
    r = df.select(merkle.edited_sections("a", "b").alias("e"), merkle.edited_sections("a", "a").alias("same"), merkle.likeness("a", "b").alias("like"),
                  merkle.likeness("a", "a").alias("one")).first()
    assert [s.section for s in r.e] == [3] and r.e[0].leaves and r.same == [] and 0.6 < r.like < 1 and r.one == 1.0


def test_likeness_of_quarter_edits(spark):
    rows = [(k, "\n".join(prose(100 * k + j, 40) for j in range(5)), "en", "s") for k in range(20)]
    got = merkle.with_successor(table(spark, rows))
    cut = F.floor(F.length("text") / 4).cast("int")
    got = got.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)))
    got = merkle.with_fingerprint(got, "edited", "other").select(merkle.likeness("fingerprint", "other").alias("near"), merkle.likeness("fingerprint", "next_fingerprint").alias("far"))
    assert all(0.6 < r.near < 0.9 and r.far < 0.2 for r in got.collect())
