"""Title and text functions: normal form, number grammar, style features, n-grams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import params as P

EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"
# fixed values: style feature names and patterns
TITLE_FEATURES = (
    ("brackets", r"[【\[]"), ("collection", "合集|一口气"), ("episode", r"第\s*\d+\s*[集话]"),
    ("question", r"[？?]"), ("emoji", EMOJI), ("challenge", "挑战"), ("call", "三连|一键三连|关注|点赞投币"),
)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def folded(text: Column | str) -> Column:
    """NFKC and lower case.  Neither engine has NFKC, so this is the one Arrow function on the text path."""
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(_nfkc(F.coalesce(text, F.lit(""))))


_START, _END = r"(?<![\d.])", r"(?!\d|\.\d)"


def number_flag(normal: Column) -> Column:
    """'series' for episode grammar, 'number_review' for a loose number, else null.  Input is folded text."""
    def loose(array: Column) -> Column:
        def suspicious(n: Column) -> Column:
            year = (F.length(n) == 4) & n.between("1900", "2099")
            full = F.when(F.length(n) == 6, F.concat(F.lit("20"), n)).otherwise(n)
            day = n.rlike(r"^(?:20)?(?:1[5-9]|2[0-9]|30)[0-1][0-9][0-3][0-9]$") & F.try_to_date(full, "yyyyMMdd").isNotNull()
            return ~year & ~day
        return F.exists(array, suspicious)

    long_numbers = F.regexp_extract_all(normal, F.lit(rf"{_START}(\d{{3,}}){_END}(?!\s*(?:{P.NUMBER_UNITS}))"), F.lit(1))
    at_end = F.regexp_extract_all(normal, F.lit(rf"{_START}(\d{{2,}}){_END}(?!\s*(?:{P.NUMBER_UNITS}))[ 】\]）)！!。．.？?]*\z"), F.lit(1))
    return F.when(normal.rlike(P.EPISODE_PATTERN), "series").when(loose(long_numbers) | loose(at_end), "number_review")


def title_features(text: Column | str) -> dict[str, Column]:
    """Ten style features; patterns are fixed values, lengths count characters."""
    text = F.col(text) if isinstance(text, str) else text
    out = {name: text.rlike(pattern) for name, pattern in TITLE_FEATURES}
    out["exclaims"] = F.regexp_count(text, F.lit("[！!]")) >= 2
    out["spaced"] = text.rlike(r"\S \S") & (F.char_length(text) <= 20)
    out["long"] = F.char_length(text) >= 25
    return out


def strip_tags(text: Column | str, tag: str = "em") -> Column:
    return F.regexp_replace(text, rf"</?{tag}[^>]*>", "")
