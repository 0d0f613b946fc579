"""Held-out accuracy, optimal paths and awkward rows for the two models."""

import itertools
import random

import numpy as np
import pytest

from reactrix.llm import language, toxicity

from .brute import awkward, table

SYLLABLES = {"aa": ["ba", "ko", "ti", "mu"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["ção", "que", "ão", "lho"]}


def sentence(lang, seed, words=30):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, sentence(lang, k), lang, "s") for k, lang in enumerate(itertools.islice(itertools.cycle(SYLLABLES), 150))]
    rows += [(500 + k, "привет мир как дела сегодня", "ru", "s") for k in range(20)] + [(600, None, "aa", "s"), (601, "x", None, "s")]
    return language.fit(table(spark, rows))


def test_held_out_languages(spark, model):
    rows = [(k, sentence(lang, 1000 + k), lang, "s") for k, lang in enumerate(itertools.islice(itertools.cycle(SYLLABLES), 90))]
    got = {r.doc_id: r.lang_pred for r in language.identify(table(spark, rows), model).collect()}
    assert got == {i: lang for i, _, lang, _ in rows}


def test_spans_of_a_mixed_text(spark, model):
    first, second = sentence("aa", 1, 40), sentence("bb", 2, 60)
    r = language.identify(table(spark, [(1, f"{first} {second}", None, None)]), model).collect()[0]
    assert r.lang_pred == "bb" and [s.lang for s in r.spans] == ["aa", "bb"] and 0.3 < r.score < 1
    assert r.spans[0].start == 0 and r.spans[0].end == r.spans[1].start == len(first) + 1 and r.spans[1].end == len(first) + len(second) + 1


def test_scripts_narrow_candidates(spark, model):
    got = language.identify(table(spark, [(1, "совсем другие слова", None, None), (2, "日本語", None, None), (3, "日本語 " + sentence("aa", 4), None, None)]), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "ru", 2: model.languages[0], 3: "aa"}


def test_awkward_rows(spark, model):
    docs = table(spark, awkward())
    got = language.identify(docs, model).collect()
    assert len(got) == len(awkward())
    by_id = {r.doc_id: r for r in got}
    for i in (2, 3, 6, 13):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].spans) == ("und", 0.0, [])
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.keep_identified(docs, model, least=0.0)
    assert kept.columns == docs.columns and kept.count() == len(awkward()) - 4


def test_without_labels_or_rows(spark, model):
    none = language.fit(table(spark, []))
    assert none.languages == []
    assert {r.lang_pred for r in language.identify(table(spark, awkward()), none).collect()} == {"und"}
    assert language.identify(table(spark, []), model).count() == 0


def test_paths_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        score = -rng.exponential(2.0, (n, m))
        switch = float(rng.uniform(0, 4))
        path = language.best_path(score, switch)

        def value(p):
            return score[np.arange(n), list(p)].sum() - switch * sum(a != b for a, b in zip(p, p[1:]))

        assert value(path) >= max(map(value, itertools.product(range(m), repeat=n))) - 1e-9


def toxic_rows():
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        words = sentence("aa", k, 60).split()
        bad = k % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilefolk", "gruntish", "noxword" + rng.choice(["a", "en", "ish", "o"])]))
        rows.append((k, " ".join(words), "aa", "s"))
        labels.append((k, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def lexicon(spark):
    rows, labels = toxic_rows()
    known = [x for x in labels if x[0] % 3] + [(None, 1), (99_999, 1), (1, None)]
    return toxicity.fit(table(spark, rows), spark.createDataFrame(known, "doc_id long, toxic int"))


def test_held_out_toxicity(spark, lexicon):
    rows, labels = toxic_rows()
    truth = dict(labels)
    got = toxicity.score(table(spark, [r for r in rows if r[0] % 3 == 0]), lexicon).collect()
    assert all((r.score >= 0.5) == bool(truth[r.doc_id]) for r in got)


def test_folding_and_exceptions(spark, lexicon):
    clean = sentence("bb", 1, 40)
    lexicon = toxicity.Lexicon(lexicon.terms, lexicon.curve, ("vilefolk festival",), True)
    rows = [(1, f"V1l3folk vіlefolk GRUNT1SH ríot {clean}", None, None), (2, clean, None, None), (3, f"the vilefolk festival {clean} vilefolk festival", None, None),
            (4, f"the vilefolk gruntish {clean}", None, None)]
    got = {r.doc_id: r for r in toxicity.score(table(spark, rows), lexicon).collect()}
    assert got[1].weight >= got[4].weight > 0 and got[2].weight == got[3].weight == 0


def test_awkward_toxicity(spark, lexicon):
    got = toxicity.score(table(spark, awkward()), lexicon).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    blank = toxicity.fit(table(spark, awkward()), empty)
    assert {r.score for r in toxicity.score(table(spark, awkward()), blank).collect()} == {0.0}
    assert toxicity.score(table(spark, []), lexicon).count() == 0


def test_spans_where_lower_case_is_longer(spark, model):
    """A capital I with dot becomes two code points, which cuts its word in two."""
    first, second = sentence("aa", 5, 40), sentence("bb", 6, 60)
    text = f"\u0130ba {first} \u0130 {second}"
    r = language.identify(table(spark, [(1, text, None, None)]), model).collect()[0]
    assert [s.lang for s in r.spans] == ["aa", "bb"]
    assert r.spans[0].start == 0 and r.spans[0].end == r.spans[1].start and r.spans[1].end == len(text)
    assert abs(r.spans[1].start - text.index(second)) <= 2


def plain_weights(text, terms, exceptions):
    """Total weight by trying every term and phrase at every place."""
    table = toxicity._Fold()
    words = toxicity.fold(text, table).split()
    whole = f" {' '.join(words)} " if words else ""
    spared = set()
    for phrase in exceptions:
        p = f" {' '.join(toxicity.fold(phrase, table).split())} "
        for k in range(len(whole)):
            if whole.startswith(p, k):
                spared |= set(range(k, k + len(p) - 1))
    best = [max([w for t, w in terms.items() if whole.startswith(t, k)], default=0.0) for k in range(len(whole))]
    return sum(w for k, w in enumerate(best) if k not in spared), len(words)


def test_matcher_against_every_place():
    rng = random.Random(9)
    terms = {" trash ": 1.5, " tras": 1.0, " vile": 2.0, " vilefolk ": 2.5, " clown ": 0.7, " ldlot": 3.0, " can ": 0.2}
    pieces = ["trash", "can", "trash can", "class clown", "clown", "VILEfolk!", "v!lefolk", "vile", "idiot proof", "1d10t", "fish", "a$$", "(trash)", "clown fish", "\u0441lown"]
    lexicon = toxicity.Lexicon(terms)
    automaton = lexicon.automaton()
    for k in range(300):
        text = rng.choice([" ", ", ", "! "]).join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 12, 400 if k < 3 else 5])))
        total, words = plain_weights(text, terms, lexicon.exceptions)
        got = toxicity.features(text, automaton, toxicity._Fold())
        assert np.allclose(got, [np.log1p(total), np.log1p(total * toxicity.BASE / max(words, toxicity.BASE))])


def test_signs_are_letters_only_between_letters():
    lexicon = toxicity.Lexicon({" vlleflk ": 1.0, " vllefolk ": 1.0, " ass ": 1.0})
    automaton = lexicon.automaton()

    def weight(text):
        return toxicity.features(text, automaton, toxicity._Fold())[0]

    assert weight("you vilefolk here") == weight("you vilefolk!") == weight("|vilefolk| there") == weight("you v!lefolk") == weight("$vilefolk$.") > 0
    assert weight("a$$ here") == 0.0 and weight("a$s here") > 0
