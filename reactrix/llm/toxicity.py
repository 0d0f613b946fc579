"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, accents off, look-alike letters of other scripts and digits that stand for letters
mapped to one form each. Signs that can stand for a letter do so only between letters; at a word's edge they are
punctuation, and become spaces like everything else. The lexicon, whole words and word beginnings with log-odds
weights, is learned from a bounded sample of labelled rows and matched on whole texts by an Aho-Corasick automaton;
matches inside exception phrases do not count. A logistic curve over the total weight and the weight by length, fitted
on the same sample, gives the score.

A feature enters the lexicon if its share among toxic documents is significantly larger than among others (G-squared
above twice the log of the number of features) and it follows at least three different words there, so that texts
copied many times do not fill it.

The lexicon holds every feature that passes; the bound on what is learned from is `max_rows` labelled rows, nothing else.
Texts of any length are matched whole, in time that grows with their length (exception phrases are looked up by place).

Null and empty texts score as a text without matches. Labels of null or for missing documents are not used; of repeated
labels the highest counts. Without labelled rows all scores are the neutral 0. Repeated rows get equal scores. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reactrix.session import stage

from .common import crc32_text, documents, query, slices

MAX_ROWS = 20_000
PREFIXES = (4, 5, 6, 7)
BASE = 200.0  # words; weights of longer texts shrink in proportion in the second feature

#: Characters read as the letter they look like.
LOOK_ALIKE = {
    "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "i": "l",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "l", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "ι": "l", "κ": "k", "ε": "e", "υ": "u", "η": "n", "χ": "x", "ß": "s", "ø": "o", "ł": "l", "đ": "d",
}
#: Signs read as a letter where letters stand on both sides.
SIGNS = {"@": "a", "$": "s", "!": "l", "|": "l"}
#: Harmless phrases that hold words which are insults elsewhere.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "idiot proof", "stupid simple")


class _Fold(dict):
    """Translation table that is filled as characters turn up (bounded by the number of code points)."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKD", chr(code)).lower()
        c = "".join(x for x in c if not unicodedata.combining(x))
        c = "".join(LOOK_ALIKE.get(x, x if x.isalpha() or x in SIGNS else " ") for x in c)
        self[code] = c
        return c


_SIGN = re.compile("[" + re.escape("".join(SIGNS)) + "]")
_INNER = re.compile(rf"(?<=[^\W_]){_SIGN.pattern}+(?=[^\W_])")
_AS_LETTERS = str.maketrans(SIGNS)


def fold(text: str, table: _Fold) -> str:
    folded = text.translate(table)
    if _SIGN.search(folded) is None:
        return folded
    return _SIGN.sub(" ", _INNER.sub(lambda m: m[0].translate(_AS_LETTERS), folded))


@dataclass
class Lexicon:
    terms: dict[str, float]  # " word " or " beginning" -> weight
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS
    fitted: bool = field(default=False)

    def automaton(self):
        import ahocorasick

        table, out = _Fold(), ahocorasick.Automaton()
        for term, weight in self.terms.items():
            out.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            words = f" {' '.join(fold(phrase, table).split())} "
            out.add_word(words, (len(words), None))
        out.make_automaton()
        return out


def features(text: str | None, automaton, table: _Fold) -> tuple[float, float]:
    """(log of the total weight, the same with the weight scaled to a text of BASE words)."""
    words = fold(text or "", table).split()
    if not words:
        return 0.0, 0.0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    spared.sort()
    reach = list(itertools.accumulate((b for _, b in spared), max))

    def is_spared(place: int) -> bool:
        k = bisect.bisect_right(spared, (place, float('inf'))) - 1
        return k >= 0 and place < reach[k]

    total = sum(w for s, w in best.items() if not is_spared(s))
    return float(np.log1p(total)), float(np.log1p(total * BASE / max(len(words), BASE)))


def _counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean, places): documents of either class with the term, and how many words it follows in toxic ones."""
    def work(batches):
        table = _Fold()
        for batch in slices(batches, 2000):
            found: dict[tuple[str, str], list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = fold(text or "", table).split()
                mine = {}
                for before, word in zip(["", *words], words):
                    for term in (f" {word} ", *(f" {word[:k]}" for k in PREFIXES if len(word) >= k)):
                        mine.setdefault(term, before)
                for term, before in mine.items():
                    found.setdefault((term, before if toxic else ""), [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64())],
                ["term", "before", "toxic", "clean"])

    by_place = sample.select("text", "toxic").mapInArrow(work, "term string, before string, toxic long, clean long")
    by_place = by_place.groupBy("term", "before").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return by_place.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum(F.expr("if(toxic > 0, 1, 0)")).alias("places"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, exceptions=EXCEPTIONS) -> Lexicon:
    """Learns from at most `max_rows` labelled rows (lowest hashes of the id) of labels (doc_id, toxic)."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("labelled"), "toxic")
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("text", "toxic"), "labelled")
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Lexicon({}, exceptions=exceptions)
    counted = stage(_counts(sample), "terms")
    bar = 2 * np.log(max(counted.count(), 2))
    share = F.lit(bad / (bad + good))
    n = F.col("toxic") + F.col("clean")
    likelihood = 2 * (F.col("toxic") * F.log(F.col("toxic") / (n * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    strong = counted.filter("toxic >= 3 AND places >= 3").select("term", odds.alias("weight"), likelihood.alias("g"))
    rows = strong.filter((F.col("weight") > 1) & (F.col("g") > float(bar))).collect()  # at most a third of the sample's distinct features
    found = {r.term: r.weight for r in rows}
    terms = {}
    for term in sorted(found, key=len):  # a longer form stays only if it says more than its beginning
        word = term.rstrip(" ")
        before = max((terms.get(word[:k + 1], 0.0) for k in PREFIXES if k < len(word) - 1 + term.endswith(" ")), default=0.0)
        if found[term] > before + 0.5:
            terms[term] = found[term]
    lexicon = Lexicon(terms, exceptions=exceptions, fitted=True)
    data = np.array([tuple(r) for r in _featured(sample, lexicon, ["toxic"]).collect()], float).reshape(-1, 3)
    lexicon.curve = _logistic(data[:, 1:], data[:, 0])
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton steps on at most `max_rows` rows of two features."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _featured(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The kept columns with total and dense weights."""
    def work(batches):
        automaton, table = lexicon.automaton(), _Fold()
        for batch in slices(batches):
            values = [features(t, automaton, table) if len(automaton) else (0.0, 0.0) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array([v[0] for v in values], pa.float64()),
                                              pa.array([v[1] for v in values], pa.float64())], [*keep, "weight", "dense"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("weight", T.DoubleType()), T.StructField("dense", T.DoubleType())])
    return docs.select(*keep, "text").mapInArrow(work, schema)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row: doc_id, score (0 to 1), weight (log of the lexicon weight found)."""
    a, b, c = lexicon.curve
    value = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("weight") + F.lit(c) * F.col("dense"))))
    return _featured(docs, lexicon, ["doc_id"]).select("doc_id", (value if lexicon.fitted else F.lit(0.0)).alias("score"), "weight")


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(crc32_text(F.col("doc_id")), F.lit(5)) == 0
    lexicon = fit(docs, labels.filter(~held))
    return score(docs, lexicon).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
