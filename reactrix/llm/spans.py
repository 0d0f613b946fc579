"""Places of regular-expression matches in whole texts, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_matches(df: DataFrame, name: str, pattern: str, text: str, gate: Column | None = None) -> DataFrame:
    """Adds `name`: array of (start, end, text, left, right) of the leftmost non-overlapping matches, counted in code
    points, end exclusive; left holds up to 24 characters between the match before and this one, right the next one.

    Texts and gaps alternate, so a match starts after all lengths before it. Prefix sums are taken over blocks of about
    the square root of the number of matches: n matches cost n^1.5 additions. `gate` may rule out texts without any match.
    """
    hits, gaps, sizes, blocks = (f"_{name}_{x}" for x in ("hits", "gaps", "sizes", "blocks"))
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn(hits, found if gate is None else F.when(gate, found).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn(sizes, F.transform(hits, lambda x, i: F.length(x) + F.length(F.get(F.col(gaps), i))))
    width = F.greatest(F.ceil(F.sqrt(F.size(hits))).cast("int"), F.lit(1))

    def total(values):
        return F.aggregate(values, F.lit(0), lambda a, b: a + b)

    sums = F.transform(F.sequence(F.lit(0), width - 1), lambda b: total(F.slice(sizes, b * width + 1, width)))
    df = df.withColumn(blocks, sums)
    df = df.withColumn(blocks, F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b))))

    def place(x, i):
        block = F.floor(i / width).cast("int")
        start = F.get(F.col(blocks), block) + total(F.slice(sizes, block * width + 1, i - block * width)) + F.length(F.get(F.col(gaps), i))
        return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("text"),
                        F.right(F.get(F.col(gaps), i), F.lit(24)).alias("left"), F.left(F.get(F.col(gaps), i + 1), F.lit(1)).alias("right"))

    return df.withColumn(name, F.transform(hits, place)).drop(hits, gaps, sizes, blocks)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn check of a string of digits."""
    def add(total, i):
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def kind_counts(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    """A column n_<kind> for each kind."""
    def of(number):
        return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")

    return [of(k).alias(f"n_{name}") for k, name in enumerate(kinds)]


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """'kind:start:end' of an array of (kind, start, end), by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    name = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart_from(spans: Column, taken: Column, same_kind: bool) -> Column:
    """Those spans that overlap none of `taken` (of their own kind)."""
    def clash(s, t):
        cross = (s["start"] < t["end"]) & (t["start"] < s["end"])
        return cross & (s["kind"] == t["kind"]) if same_kind else cross

    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: clash(s, t)))
