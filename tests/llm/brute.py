"""Plain versions of the operators for small tables, and a table of awkward rows."""

import hashlib
import random
import re
import string

from pyspark.sql import types as T

FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
#: Names that the operators use inside.
CLASHING = ("size", "rate", "row", "digest", "keys", "node", "bucket", "length", "start", "block", "found", "base", "score", "weight", "covered", "component", "line_total", "line_removed", "copies", "copy_id", "ids", "fp", "cell", "terms")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = r"[^\x20\x09-\x0D]+"


def table(spark, rows, extra=CLASHING):
    """rows: (doc_id, text, lang, source)."""
    schema = T.StructType([T.StructField(n, t) for n, t in FIELDS] + [T.StructField(n, T.StringType()) for n in extra])
    full = [(i, t, lang, s, None if t is None else len(t), *[f"x{i}"] * len(extra)) for i, t, lang, s in rows]
    return spark.createDataFrame(full, schema)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    known = random.Random(7)
    syllables = ["ra", "the", "lo", "mi", "sen", "ta", "or", "el", "vi", "do"]
    vocab = ["".join(known.choice(syllables) for _ in range(known.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(rng.choice(vocab) + ("." if rng.random() < 0.1 else "") for _ in range(words))


def awkward():
    long_text = prose(1, 30_000)
    base = prose(2, 120).split()
    near = base[:]
    near[60] = "changed"
    lines = "\n".join(prose(k, 6) for k in range(12))
    return [
        (1, "Hello World a b c d e f", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, long_text, "en", "s2"),
        (5, "hello world A b c d e f", None, "s1"), (5, "hello world A b c d e f", None, "s1"), (None, "Hello world a b c d e f", "en", None),
        (6, "12 34 56", "de", "s3"), (7, "日本語 テキスト です", "ja", "s3"), (8, " ".join(base), "en", "s1"), (9, " ".join(near), "en", "s1"),
        (10, lines, "en", "s2"), (11, "intro\n" + lines + "\nend", "en", "s2"), (12, long_text + " tail", "en", "s2"), (13, "\n\n\n\n\n", "en", "s4"),
        (14, "a\na\na\na\na", "de", "s4"), (15, "ÉCOLE Ünder straße ÀÉ", "fr", "s4"), (16, "x", "fr", ""),
    ]


def lowered(text):
    return (text or "").translate(LOWER)


def shingles(text, width=5):
    words = re.findall(SPACE, lowered(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + width]) for k in range(max(len(words) - width, 0) + 1))


def near_components(rows, percent=85):
    """{doc_id: smallest id reachable} for rows with distinct ids."""
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def line_dedup(rows, width=3):
    """Texts after removing later windows; rows in their order (null id first, then id, then md5 of the text)."""
    order = sorted({(i is not None, i or 0, hashlib.md5(t.encode()).hexdigest(), t) for i, t, *_ in rows if t is not None})
    first, out = set(), {}
    for some, i, _, text in order:
        lines, drop = text.split("\n"), set()
        for k in range(len(lines) - width + 1):
            window = tuple(lines[k:k + width])
            if window in first:
                drop |= set(range(k, k + width))
            first.add(window)
        out[(i if some else None, text)] = "\n".join(x for k, x in enumerate(lines) if k not in drop)
    return out


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m[0])


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15),
)
SECRETS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
)


def base_spans(text, kinds):
    found = sorted((m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text or "") if ok(m))
    return [f"{kinds[k][0]}:{a}:{b}" for a, k, b in found]
