"""Document fingerprints: Merkle trees over sections (lines) and paragraphs (sentences, cut after a few words).

A leaf is the md5 of a paragraph, a section's digest the md5 of its leaves' digests, the root the SHA-256 of the
sections' digests; all digests are over whole values, so equal roots mean equal texts. The written fingerprint is
`root/sections/leaves`, with the digests below the root shortened. Equal sections settle a branch at once; the leaves of
differing ones locate edits. The likeness of two fingerprints is the share of leaves they have in common (Dice).

A text's successor is the next row by id, then text digest. Rows are dealt to blocks of the id range between splitters
(quantiles of the ids), each text moves once, and the row after a block's last one is the first of the next block: one
text per block, found by its id.

Null counts as an empty text, which has one empty paragraph. Null ids come after all others. Repeated rows succeed each
other. A single row is its own successor. Rows that repeat one id stay in one block. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, partitions, query, text_of

MARK = "\u0001"
LEAF_WORDS = 4
BLOCKS_A_PARTITION = 4
MAX_BLOCKS = 4096


def _leaves(text: str, words: int) -> Column:
    """Digests of the paragraphs of each section."""
    def section(s):
        ends = F.regexp_replace(s, r"([.!?|]\s++)", f"$1{MARK}")
        cut = F.regexp_replace(ends, rf"((?:[^\s{MARK}]++\s++){{{words}}})(?=[^\s{MARK}])", f"$1{MARK}")
        return F.transform(F.split(cut, MARK, -1), lambda x: F.md5(x.cast("binary")))

    return F.transform(F.split(text, "\n", -1), section)


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = LEAF_WORDS) -> DataFrame:
    """Adds the fingerprint of a text column as `name`."""
    leaves, sections = f"_{name}_leaves", f"_{name}_sections"
    df = df.withColumn(leaves, _leaves(text, words))
    df = df.withColumn(sections, F.transform(leaves, lambda s: F.md5(F.array_join(s, ",").cast("binary"))))
    short = F.array_join(F.transform(leaves, lambda s: F.array_join(F.transform(s, lambda x: F.left(x, F.lit(6))), ",")), ";")
    tree = F.concat_ws("/", F.sha2(F.array_join(sections, ","), 256), F.array_join(F.transform(sections, lambda s: F.left(s, F.lit(8))), ","), short)
    return df.withColumn(name, tree).drop(leaves, sections)


def likeness(a: str, b: str) -> Column:
    """Share of common leaves of two fingerprint columns; 1 for equal roots."""
    def marks(c):
        return F.array_distinct(F.split(F.split_part(c, F.lit("/"), F.lit(3)), "[,;]"))

    x, y = marks(F.col(a)), marks(F.col(b))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def edited_sections(a: str, b: str) -> Column:
    """Where the fingerprints' trees differ: array of (section, leaves), both numbered from 0 in `a`, of the sections whose
    digest `b` has nowhere, with those of their leaves that `b` has nowhere."""
    def part(c, k):
        return F.split_part(F.col(c), F.lit("/"), F.lit(k))

    other, leaves = F.split(part(b, 2), ","), F.split(part(b, 3), "[,;]")
    groups = F.split(part(a, 3), ";")
    numbered = F.transform(F.split(part(a, 2), ","), lambda s, i: F.struct(i.alias("section"), s.alias("digest")))
    changed = F.filter(numbered, lambda s: ~F.array_contains(other, s["digest"]))

    def lost(s):
        mine = F.split(F.get(groups, s["section"]), ",")
        places = F.filter(F.transform(mine, lambda x, j: F.struct(x.alias("leaf"), j.alias("at"))), lambda x: ~F.array_contains(leaves, x["leaf"]))
        return F.struct(s["section"].alias("section"), F.transform(places, lambda x: x["at"]).alias("leaves"))

    return F.when(F.col(a) == F.col(b), F.transform(F.filter(numbered, lambda s: F.lit(False)), lost)).otherwise(F.transform(changed, lost))


def _block(splitters: list, n: int) -> Column:
    """Number of splitters not above the id, found by 64 comparisons at most; null ids come last."""
    if not splitters:
        return F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    step = 64
    all_of, coarse = F.lit(splitters), F.lit(splitters[step - 1::step]) if len(splitters) >= step else None

    def not_above(values):
        return F.size(F.filter(values, lambda s: s <= F.col("doc_id")))

    whole = not_above(coarse) * step if coarse is not None else F.lit(0)
    return F.when(F.col("doc_id").isNull(), n + 1).otherwise(whole + not_above(F.slice(all_of, whole + 1, step)))


def with_successor(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint) of every row."""
    spark = docs.sparkSession
    n = min(blocks or BLOCKS_A_PARTITION * partitions(spark), MAX_BLOCKS)
    shares = [k / n for k in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * n)).first()[0] if shares else None
    rows = docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", F.md5("text").alias("digest"))
    rows = rows.withColumn("block", _block(sorted(set(found or [])), n))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    firsts = rows.groupBy("block").agg(F.min(key).alias("first"))
    order = W.orderBy("block")  # at most MAX_BLOCKS + 2 rows
    turns = firsts.select("first", F.coalesce(F.lag("block").over(order), F.max("block").over(W.partitionBy())).alias("after"))
    turns = turns.select("after", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))
    heads = rows.join(F.broadcast(turns), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest")))
    heads = with_fingerprint(heads.groupBy("after").agg(F.first("text").alias("head_text")), "head_text", "head_fingerprint")
    line = W.partitionBy("block").orderBy(F.col("doc_id").isNull(), "doc_id", "digest")
    told = with_fingerprint(rows, "text", "fingerprint").select(
        "doc_id", "text", "fingerprint", "block", F.lead("text").over(line).alias("lead_text"), F.lead("fingerprint").over(line).alias("lead_fingerprint"))
    joined = told.join(heads, (F.col("block") == F.col("after")) & F.col("lead_text").isNull(), "left")
    return joined.select("doc_id", "text", "fingerprint", F.coalesce("lead_text", "head_text").alias("next_text"),
                         F.coalesce("lead_fingerprint", "head_fingerprint").alias("next_fingerprint"))


@query("op5_merkle_fingerprints")
def op5_merkle_fingerprints(spark, sf_dir):
    rows = with_successor(documents(spark, sf_dir)).withColumn("n_chars", F.length("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
