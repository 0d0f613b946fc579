"""Language of whole texts, and of the spans of mixed ones.

Script ranges narrow the candidates of each word to the languages that write in its script; a word's score in a language
is the mean log probability of its character n-grams; a Viterbi path over the words, with a penalty for each switch,
labels spans. A text's language is the one with most letters on the path.

The model is fitted on a bounded sample of labelled rows: about `per_language` documents of each language, drawn by a
hash of the id (all of them where there are fewer); every n-gram of the sample counts. A constant path is optimal where no other language gains more than
the penalty on any stretch of words; only the other texts need the full recursion.

Whole texts of any length are labelled. Ties between languages go to the more frequent one, then by name; words are those of
the lower-cased text, and spans are given in places of the text itself also where lower case is longer.

Null texts and texts without a letter are 'und' with score 0. A null language is never learned from. Texts in scripts
that no learned language uses get the most frequent language with its share as score. Without any labelled row every
text is 'und'. Repeated rows get equal results. Extra columns are kept by `keep_identified`; an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_text, documents, query, slices

PER_LANGUAGE = 2000
SWITCH = 20.0  # nats; a few words of another language outweigh it
TEXTS_AT_ONCE = 250
WORD_CACHE = 150_000
LETTERS = re.compile(r"[^\W\d_]+")

#: First code point of a range and the script written in it.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
)
_STARTS = [s for s, _ in SCRIPTS]


def script_of(letter: str) -> str:
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(letter)) - 1][1]


def grams_of(word: str) -> list[str]:
    """Letters, pairs and triples of the word with its edges marked."""
    w = f" {word} "
    return [*word, *map(str.__add__, w, w[1:]), *map("".join, zip(w, w[1:], w[2:]))]


def gram_code(gram: str) -> int:
    """Up to three characters as one number."""
    a, b, c = [0] * (3 - len(gram)) + [ord(x) + 1 for x in gram]
    return a << 42 | b << 21 | c


@dataclass
class Model:
    languages: list[str]
    share: np.ndarray
    codes: np.ndarray  # codes of the known grams, ascending
    table: np.ndarray  # log probability of each gram (last row: unknown) by language
    allowed: dict[str, np.ndarray]  # script -> languages written in it


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from the rows of (doc_id, text, lang) given; the caller leaves out what must not be learned from."""
    rows = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    total = sum(counts.values()) or 1
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    limit = F.lit(1.0)
    for name in languages:
        limit = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / counts[name]))).otherwise(limit)

    def count(batches):
        for batch in slices(batches, 5000):
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            lang, gram, n = [], [], []
            for name, words in found.items():
                grams: Counter = Counter()
                for word, times in words.items():
                    grams["#" + script_of(word[0])] += times
                    for g in grams_of(word):
                        grams[g] += times
                lang += [name] * len(grams)
                gram += grams.keys()
                n += grams.values()
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    sample = rows.filter(part < limit).select("text", "lang")
    counted = sample.mapInArrow(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    # a script mark has at least five characters, a gram at most three
    scripts = counted.filter(F.length("gram") > 3).collect()
    by_gram = counted.filter(F.length("gram") <= 3).groupBy("gram").agg(
        F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    kept = by_gram.collect()  # the grams of the bounded sample
    index = {name: k for k, name in enumerate(languages)}
    table = np.zeros((len(kept) + 1, len(languages)))
    for k, r in enumerate(kept):
        for name, n in r.by.items():
            table[k, index[name]] = n
    sizes = np.array([len(r.gram) for r in kept] + [0])
    logs = np.empty_like(table)
    for size in (1, 2, 3):
        rows_of = sizes == size
        mass = table[rows_of].sum(axis=0) + 0.5 * rows_of.sum() + 1
        logs[rows_of] = np.log((table[rows_of] + 0.5) / mass)
        logs[-1] = np.log(0.5 / mass)
    seen: dict[str, np.ndarray] = {}
    for r in scripts:
        seen.setdefault(r.gram[1:], np.zeros(len(languages)))[index[r.lang]] = r.n
    words = sum(seen.values()) if seen else np.zeros(len(languages))
    allowed = {s: n >= 0.01 * np.maximum(words, 1) for s, n in seen.items()}
    codes = np.array([gram_code(r.gram) for r in kept], np.int64)
    order = codes.argsort()
    return Model(languages, np.array([counts[x] / total for x in languages]), codes[order], np.concatenate([logs[order], logs[-1:]]), allowed)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Score of each word in each language, by the codes of all their grams at once."""
    a = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    letter, c = a != 32, a + 1
    sizes = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def summed(codes, at):
        if not len(model.codes):
            return np.zeros((len(at), len(model.languages)))
        found = np.minimum(np.searchsorted(model.codes, codes), len(model.codes) - 1)
        found = np.where(model.codes[found] == codes, found, len(model.codes))
        return np.add.reduceat(model.table[found], at)

    score = summed(c[letter], starts)
    score += summed((c[:-1] << 21 | c[1:]), starts + np.arange(len(words)))
    score += summed((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[letter[1:-1]], starts)
    score /= 2.0
    if len(model.allowed) > 1 or not all(ok.all() for ok in model.allowed.values()) or not letter_range(a):
        nowhere = np.zeros(len(model.languages), bool)
        for k, w in enumerate(words):
            ok = model.allowed.get(script_of(w[0]), nowhere)
            if not ok.all():
                score[k] = np.where(ok, score[k], score[k].min() - 50.0) if ok.any() else 0.0
    return score - score.max(axis=1, keepdims=True)


def letter_range(codes: np.ndarray) -> bool:
    """Whether all characters lie in the first script's range."""
    return bool(codes.max() < SCRIPTS[1][0])


class _Scorer:
    """Per-word scores, remembered up to a fixed number of words."""

    def __init__(self, model: Model):
        self.model, self.rows, self.at = model, np.zeros((1024, len(model.languages))), {}

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The scores of the words of each text."""
        if len(self.at) > WORD_CACHE:
            self.at = {}
        at = self.at
        fresh = list({w for words in texts for w in words}.difference(at))
        if fresh:
            base = len(at)
            at.update(zip(fresh, range(base, base + len(fresh))))
            if len(at) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((len(at) * 2 - len(self.rows), self.rows.shape[1]))])
            self.rows[base:base + len(fresh)] = word_scores(fresh, self.model)
        return [self.rows[[at[w] for w in words]] if words else self.rows[:0] for words in texts]


def best_path(score: np.ndarray, switch: float) -> np.ndarray:
    """The language index of each word on the best path."""
    n = len(score)
    best = int(score.sum(axis=0).argmax())
    gain = np.cumsum(score - score[:, best:best + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
    rise = max(gain[0].max(), (gain[1:] - low[:-1]).max() if n > 1 else 0.0)
    # paths that touch `best` win at most `rise` on each other stretch; those that never do start and end with another language
    if rise <= switch and max(gain.max(), 0.0) + max((gain[-1] - gain).max(), 0.0) <= switch:
        return np.full(n, best)
    now, states = score[0].tolist(), []
    for row in score[1:].tolist():
        states.append(now)
        jump = max(now) - switch
        now = [(a if a >= jump else jump) + r for a, r in zip(now, row)]
    at = now.index(max(now))
    path = [at]
    for before in reversed(states):
        top = max(before)
        if before[at] < top - switch:
            at = before.index(top)
        path.append(at)
    return np.array(path[::-1])


def judge(texts: list[str | None], scorer: _Scorer, switch: float = SWITCH):
    """For each text: language, score and the path over the words (empty where no word was labelled)."""
    model, none = scorer.model, np.empty(0, int)
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        words_of = [LETTERS.findall(t.lower()) if t else [] for t in texts[at:at + TEXTS_AT_ONCE]]
        for words, rows in zip(words_of, scorer.of(words_of) if model.languages else words_of):
            if not words or not model.languages:
                yield "und", 0.0, none
            elif not rows.any():
                top = int(model.share.argmax())
                yield model.languages[top], float(model.share[top]), none
            else:
                path = best_path(rows, switch)
                letters = np.bincount(path, [len(w) for w in words], len(model.languages))
                top = int(letters.argmax())
                total = rows[path == top].sum(axis=0)
                odds = np.exp(np.minimum(total - total[top], 0.0)).sum()
                yield model.languages[top], float(letters[top] / letters.sum() / odds), path


def spans_of(text: str, lang: str, path: np.ndarray, languages: list[str]) -> list[tuple[int, int, str]]:
    """Stretches of one language; a new one begins with its first word."""
    if lang == "und":
        return []
    if not len(path) or not (path != path[0]).any():
        return [(0, len(text), lang)]
    lower = text.lower()
    starts = [m.start() for m in LETTERS.finditer(lower)]
    if len(lower) != len(text):  # some letters have longer lower-case forms: back to the places of the text
        ends = list(itertools.accumulate(len(c.lower()) for c in text))
        starts = [bisect.bisect_right(ends, s) for s in starts]
    cuts = (np.flatnonzero(path[1:] != path[:-1]) + 1).tolist()
    edges = [0, *(starts[c] for c in cuts), len(text)]
    return [(a, b, languages[path[c]]) for a, b, c in zip(edges, edges[1:], [0, *cuts])]


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """Per row: doc_id, lang_pred, score, spans (start, end, lang; code points, end exclusive)."""
    def work(batches):
        scorer = _Scorer(model)
        for batch in slices(batches):
            lang, score, spans = [], [], []
            texts = batch.column(1).to_pylist()
            for text, (found, sure, path) in zip(texts, judge(texts, scorer, switch)):
                lang.append(found)
                score.append(sure)
                spans.append([{"start": a, "end": b, "lang": x} for a, b, x in spans_of(text or "", found, path, model.languages)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(
                spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))], names)

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    names = schema.names
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3, switch: float = SWITCH) -> DataFrame:
    """The rows of `docs`, all columns, whose language is known with at least that score."""
    at = docs.columns.index("text")

    def work(batches):
        scorer = _Scorer(model)
        for batch in slices(batches):
            found = judge(batch.column(at).to_pylist(), scorer, switch)
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def learnable(docs: DataFrame):
    """Rows that the registered query may learn from; the others are held out."""
    return docs.filter(F.pmod(crc32_text(F.col("doc_id")), F.lit(3)) != 1)


@query("op7_language_spans")
def op7_language_spans(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = identify(docs, fit(learnable(docs)))
    held = F.pmod(crc32_text(F.col("doc_id")), F.lit(3)) == 1
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "spans")
