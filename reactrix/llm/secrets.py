"""Secret scans: base patterns, and Markov chains of characters for whatever else looks random.

Two first-order chains over characters, one of random strings and one of ordinary identifiers, are compared by the log
ratio of their likelihoods. Labelled samples train them: values found by the base patterns in all texts, and the longer
words outside them of about `sample` documents drawn by a hash of the id. A token is a secret if its ratio is above that of all but
`false_alarm` of the identifiers as long as a token in all texts and above an even bet. Chains are tables of at most (64 + 1)^2 counts.

The tokens of every text are found in one pass and written to the shared folder; only the chains' counts and the quantile's
sketches, merged before the shuffle, are moved.

Null counts as an empty text, without spans. Without any secret in the texts the random chain is uniform, without
identifiers the other one is. Repeated rows get equal spans. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reactrix.session import stage

from .common import documents, query, text_of
from .spans import apart_from, kind_counts, listed, with_matches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}+"
WORD = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z_]{8,}+(?![A-Za-z0-9+/=-])"
LONG_WORD = WORD.replace("{8,}", "{16,}")  # as long as a token
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
SAMPLE = 2000
FALSE_ALARM = 1e-4
PRIOR = 2.0  # added to each count


def tokens(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Staged (doc_id, base, tokens, drawn, words): base spans with their value, other tokens, whether the row is sampled, and
    its words outside base spans: all of them where it is, those as long as a token elsewhere."""
    total = docs.count()
    rows = docs.select("doc_id", text_of().alias("text"))
    lower = F.lower("text")
    asks = F.contains(lower, F.lit("passw")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | lower.rlike("api_?key")
    rows = with_matches(rows, "assign", ASSIGN, "text", asks)
    rows = with_matches(rows, "access", ACCESS, "text", F.contains("text", F.lit("AKIA")))
    rows = with_matches(rows, "hex", HEX, "text")
    rows = with_matches(rows, "other", TOKEN, "text")

    def spans(column, kind, value, least):
        def one(m):
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), value(m["text"]).alias("value"))
        return F.filter(F.transform(column, one), lambda s: F.length(s["value"]) >= least)

    base = F.concat(spans("assign", 0, lambda t: F.regexp_extract(t, ASSIGN, 1), 12), spans("access", 1, lambda t: t, 18), spans("hex", 2, lambda t: t, 16))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1e6 * min(1.0, sample / max(total, 1))
    rest = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    words = F.regexp_extract_all(rest, F.when(drawn, F.lit(WORD)).otherwise(F.lit(LONG_WORD)), F.lit(0))
    return stage(rows.select("doc_id", base.alias("base"), spans("other", 3, lambda t: t, 16).alias("tokens"), drawn.alias("drawn"), words.alias("words")), "tokens")


def _code(c: Column) -> Column:
    return F.position(c, F.lit(ALPHABET))


def _steps(value: Column) -> Column:
    """Cell of the chain's table for each pair of neighbouring characters; 0 stands for any other character."""
    def step(i):
        return _code(F.substr(value, i, F.lit(1))) * (len(ALPHABET) + 1) + _code(F.substr(value, i + 1, F.lit(1)))

    return F.when(F.length(value) >= 2, F.transform(F.sequence(F.lit(1), F.length(value) - 1), step)).otherwise(F.array().cast("array<int>"))


def _chain(counts: dict[int, int]) -> list[float]:
    """Log probability of each step, smoothed."""
    n = len(ALPHABET) + 1
    out = []
    for a in range(n):
        row = [counts.get(a * n + b, 0) + PRIOR for b in range(n)]
        whole = sum(row)
        out += [math.log(x / whole) for x in row]
    return out


def ratios(found: DataFrame) -> list[float]:
    """Log ratio of the two chains for each step."""
    def counted(values):
        steps = values.select(F.explode(_steps(F.col("value"))).alias("step"))
        return {r.step: r["count"] for r in steps.groupBy("step").count().collect()}

    random = counted(found.select(F.explode("base.value").alias("value")))
    plain = counted(found.filter("drawn").select(F.explode("words").alias("value")))
    return [a - b for a, b in zip(_chain(random), _chain(plain))]


def ratio(value: Column, table: list[float]) -> Column:
    cells = F.lit(table)
    return F.aggregate(_steps(value), F.lit(0.0), lambda a, i: a + F.get(cells, i))


def threshold(found: DataFrame, table: list[float], false_alarm: float = FALSE_ALARM) -> float:
    """The ratio that all but `false_alarm` of the identifiers of all texts stay at or under, and at least an even bet."""
    seen = found.select(F.explode("words").alias("value")).filter(F.length("value") >= 16)
    edge = seen.agg(F.percentile_approx(ratio(F.col("value"), table), 1 - false_alarm, 100_000)).first()[0]
    return max(edge if edge is not None else 0.0, math.log(1000.0))


def secrets(found: DataFrame, table: list[float], false_alarm: float = FALSE_ALARM) -> DataFrame:
    """Per row: doc_id, base and further, arrays of (kind, start, end)."""
    bar = threshold(found, table, false_alarm)

    def short(s):
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    rows = found.select("doc_id", F.transform("base", short).alias("base"),
                        F.transform(F.filter("tokens", lambda s: ratio(s["value"], table) > bar), short).alias("more"))
    return rows.select("doc_id", "base", apart_from(F.col("more"), F.col("base"), same_kind=False).alias("further"))


@query("op8_secret_markov_scan")
def op8_secret_markov_scan(spark, sf_dir):
    found = tokens(documents(spark, sf_dir))
    spans = secrets(found, ratios(found))
    return spans.select("doc_id", *kind_counts("base", KINDS[:3]), F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
                        listed(F.concat("base", "further"), KINDS).alias("spans"))
