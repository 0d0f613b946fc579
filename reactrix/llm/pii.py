"""Personal data: generators propose candidate spans, boosted trees over format and context select more of them.

High-recall generators (plain and obfuscated e-mail addresses, dotted and colon-separated addresses, digit runs, phone
shapes) propose overlapping candidates. Those that pass the checks of their kind under the base patterns are always
redacted. The trees of each kind decide about the rest: they learn to tell base matches from look-alikes of the same kind (handles,
version numbers, dates, plain candidates that fail their check) by format and surroundings. What makes a base match one
(the sign of its pattern, checksum, number ranges) is hidden from them, so that they judge spans written otherwise;
of those, card numbers still have to pass the checksum.

Scores are calibrated on held-out documents. Per kind the threshold is the lowest score at which the precision reaches the
wanted one; the precision counts `PRIOR` pseudo-candidates at the model's own probability beside the held-out ones, so
evidence grows smoothly and no table size switches anything.

The candidates of every text are found in one pass and written to the shared folder; the fit reads counts of category
combinations (bounded by the product of the category sizes), and the trees run as conditions on the stored arrays, so
nothing is shuffled but those counts.

Null counts as an empty text, without spans. A kind without any base match gives no further spans.
Candidates of one kind may tie in score and are then chosen alike; a further span never overlaps a base span of its kind.
Repeated rows get equal spans. Texts of any length are searched whole; patterns are possessive where that cannot change a
match, but a run of n address characters without an end to the address costs up to n * n / 2 steps where the text holds
an @. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reactrix.session import stage

from . import boosting
from .common import documents, query, text_of
from .spans import apart_from, digits, kind_counts, listed, luhn, with_matches

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
ROUNDS = 20  # trees of each kind
PRIOR = 20.0  # pseudo-candidates at the model's own probability
BASE, OTHER, LOOK_ALIKE = "base", "other", "look-alike"

#: Generators: kind, role, pattern (possessive where that cannot change a match), texts it can match. Base patterns give
#: base matches and, where the check fails, look-alikes; the others give spans to decide about.
GENERATORS = (
    (0, BASE, r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",)),
    (1, BASE, r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",)),
    (2, BASE, r"[0-9](?:[\x20-]?[0-9])++", ()),
    (3, BASE, r"\+[0-9][\x20().0-9-]+[0-9]", ("+",)),
    (0, OTHER, r"[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++", ("(at)", "[at]")),
    (1, OTHER, r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])", (":",)),
    (2, OTHER, r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])", (".", "/", "_")),
    (3, OTHER, r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", ()),
    (0, LOOK_ALIKE, r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![A-Za-z0-9-]|\.[A-Za-z0-9-])", ("@",)),
    (1, LOOK_ALIKE, r"(?<![0-9.])[0-9]++\.[0-9]++(?:\.[0-9]++)?(?![0-9]|\.[0-9])", (".",)),
    (3, LOOK_ALIKE, r"(?<![0-9./-])[0-9]{1,4}([./-])[0-9]{1,2}\1[0-9]{2,4}(?![0-9./-])", ()),
)
FEATURES = ("digits", "signs", "left", "right", "word", "shape")


def _char_class(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^\s$"), 3).otherwise(4))


def _candidate(kind: int, role: str, m: Column) -> Column:
    text, number = m["text"], digits(m["text"])
    n = F.length(number)
    octets = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
    checksum = F.when(n.between(12, 19), luhn(number)).otherwise(False)
    base = {0: F.lit(True), 1: text.rlike(octets), 2: checksum, 3: n.between(9, 15)}[kind] if role == BASE else F.lit(False)
    bare = F.regexp_replace(text, r"^\+[0-9]{1,2}", "") if kind == 3 else text  # without the sign and country code of the base pattern
    count = F.length(digits(bare))
    shape = {0: text.rlike(r"^[A-Za-z0-9]"), 1: ~text.rlike(r"[0-9]{5}"), 2: text.rlike("^[3-6]"), 3: bare.rlike(r"[0-9]{4}$")}[kind]
    word = F.lower(m["left"]).rlike("mail|phone|tel|call|fax|card|visa|account|addr|contact|host|server|ip")
    number_of_signs = F.length(F.regexp_replace(bare, r"[A-Za-z0-9@\x20]", ""))
    return F.struct(
        m["start"].alias("start"), m["end"].alias("end"), base.alias("base"), F.lit(role != OTHER).alias("known"),
        (F.lit(role == OTHER) & (checksum if kind == 2 else F.lit(True))).alias("open"), F.lit(kind).alias("kind"),
        F.when(count < 4, 0).when(count < 8, 1).when(count < 12, 2).when(count < 17, 3).otherwise(4).alias("digits"),
        F.least(number_of_signs, F.lit(5)).alias("signs"), _char_class(F.right(m["left"], F.lit(1))).alias("left"), _char_class(m["right"]).alias("right"),
        word.cast("int").alias("word"), shape.cast("int").alias("shape"))


def _candidates_of(kind: int, role: str):
    return lambda m: _candidate(kind, role, m)


def candidates(docs: DataFrame) -> DataFrame:
    """Staged (doc_id, found): the candidates of every row with their categories."""
    rows = docs.select("doc_id", text_of().alias("text"))
    names = []
    for k, (_, _, pattern, signs) in enumerate(GENERATORS):
        gate = None
        for s in signs:
            gate = F.contains("text", F.lit(s)) if gate is None else gate | F.contains("text", F.lit(s))
        rows = with_matches(rows, f"m{k}", pattern, "text", gate)
        names.append(f"m{k}")
    rows = rows.drop("text")
    found = F.concat(*(F.transform(n, _candidates_of(kind, role)) for n, (kind, role, _, _) in zip(names, GENERATORS)))
    return stage(rows.select("doc_id", found.alias("found")), "pii-candidates")


@dataclass
class Model:
    """Per kind the bias, the trees and the least score of a further span (None: no score reaches the precision)."""
    kinds: tuple = ((0.0, (), None),) * len(KINDS)


def fit(found: DataFrame, precision: float = PRECISION, prior: float = PRIOR) -> Model:
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    known = found.select(held.alias("held"), F.explode(F.filter("found", lambda s: s["known"])).alias("c"))
    rows = known.groupBy("held", "c.kind", *(F.col(f"c.{f}").alias(f) for f in FEATURES)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c.base").cast("long")).alias("positives")).collect()
    models = []
    for kind in range(len(KINDS)):
        mine = sorted((r for r in rows if r.kind == kind), key=lambda r: tuple(r)[2:])
        if not mine:
            models.append((0.0, (), None))
            continue
        x = np.array([[r[f] for f in FEATURES] for r in mine])
        n, right = np.array([r.n for r in mine], float), np.array([r.positives for r in mine], float)
        held_out = np.array([r.held for r in mine])
        seen = ~held_out if not held_out.all() else held_out
        bias, trees = boosting.fit(x[seen], right[seen], n[seen], rounds=ROUNDS)
        models.append((bias, trees, threshold(boosting.predict(x, bias, trees), n, right, held_out, precision, prior)))
    return Model(tuple(models))


def threshold(score: np.ndarray, n: np.ndarray, right: np.ndarray, held_out: np.ndarray, precision: float, prior: float) -> float | None:
    """The lowest score of a kind's rows at which (held-out right + prior * p) / (held-out all + prior) reaches the
    precision; p is the model's mean probability of all candidates with at least that score."""
    best = None
    for cut in np.unique(score)[::-1]:
        above = score >= cut
        p = (n[above] / (1 + np.exp(-score[above]))).sum() / n[above].sum()
        tested = above & held_out
        if right[tested].sum() + prior * p >= precision * (n[tested].sum() + prior):
            best = float(cut)
    return best


def redactions(found: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, base and further, arrays of (kind, start, end)."""
    def short(s):
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    def chosen(s):
        enough = F.lit(False)
        for kind, (bias, trees, least) in enumerate(model.kinds):
            if least is not None:
                enough = enough | ((s["kind"] == kind) & (boosting.as_column([s[f] for f in FEATURES], bias, trees) >= least - 1e-9))
        return s["open"] & enough

    base = F.transform(F.filter("found", lambda s: s["base"]), short)
    rows = found.select("doc_id", base.alias("base"), F.transform(F.filter("found", chosen), short).alias("more"))
    return rows.select("doc_id", "base", F.array_distinct(apart_from(F.col("more"), F.col("base"), same_kind=True)).alias("further"))


@query("op2_pii_boosted_candidates")
def op2_pii_boosted_candidates(spark, sf_dir):
    found = candidates(documents(spark, sf_dir))
    spans = redactions(found, fit(found))
    return spans.select("doc_id", *kind_counts("base", KINDS), F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
                        listed(F.concat("base", "further"), KINDS).alias("spans"), F.size(F.concat("base", "further")).cast("long").alias("n_spans"))
