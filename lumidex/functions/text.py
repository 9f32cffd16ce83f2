"""Text functions that need Unicode folding or difflib: Arrow UDFs around small helpers, native around them."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Annotations that name an edition of a title, not the work.
EDITIONS = (
    "director's cut", "the director's cut", "final cut", "extended cut", "extended edition", "extended version", "unrated", "unrated version",
    "theatrical version", "theatrical cut", "special edition", "collector's edition", "uncut", "remastered", "restored", "restored version",
    "4k", "4k restoration", "4k remaster", "subtitled", "dubbed", "english subtitles",
)
#: Articles that a comparison of titles leaves out at the start.
ARTICLES = ("the", "a", "an", "le", "la", "les", "il", "lo", "der", "die", "das", "el", "los", "las")
#: How strongly a difference in length lowers the similarity with a single word of a name.
LENGTH_EXPONENT = 0.35


@pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Case-folded, decomposed, without combining marks."""

    def fold(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text and text.casefold()
        return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))

    return texts.map(fold, na_action="ignore")


def norm_title(title: Column) -> Column:
    """Letters and digits of a folded title; & reads and, $ reads s, vol reads volume."""
    spelled = F.replace(F.replace(folded(title), F.lit("&"), F.lit(" and ")), F.lit("$"), F.lit("s"))
    return F.regexp_replace(F.regexp_replace(spelled, r"\bvol\b\.?", "volume"), r"[^\p{L}\p{N}]", "")


_EDITION = "(?:the )?(?:" + "|".join(x.replace("'", "'?") for x in EDITIONS) + ")"
_EDITIONS_AT_END = rf"(?i)(?<=\S)(?:\s*(?:\({_EDITION}\)|\[{_EDITION}\]|[–—-]\s+{_EDITION}))+\s*$"


def without_editions(title: Column) -> Column:
    """The title without annotations of editions at its end; never empty."""
    return F.trim(F.regexp_replace(title, _EDITIONS_AT_END, ""))


def has_edition(title: Column) -> Column:
    return title.rlike(_EDITIONS_AT_END)


def embedded_year(title: Column) -> Column:
    """The year in parentheses at the end of a title, editions aside."""
    return F.nullif(F.regexp_extract(without_editions(title), r"\S\s*\(([0-9]{4})\)\s*$", 1), F.lit("")).cast("int")


def clean_title(title: Column) -> Column:
    """The title without years and editions at its end."""
    return F.trim(F.regexp_replace(title, rf"(?i)(?<=\S)(?:\s*(?:\([0-9]{{4}}\)|\({_EDITION}\)|\[{_EDITION}\]|[–—-]\s+{_EDITION}))+\s*$", ""))


def colon_prefix(title: Column) -> Column:
    """What stands before the first colon, if it is two words or more."""
    prefix = F.trim(F.substring_index(title, ":", 1))
    return F.when(F.contains(title, F.lit(":")) & prefix.rlike(r"\S\s+\S"), prefix)


def article_norm(title: Column) -> Column:
    """norm_title without one leading English article."""
    bare = F.regexp_replace(F.trim(title), r"(?i)^(the|an|a)\s+", "")
    return F.coalesce(F.nullif(norm_title(bare), F.lit("")), norm_title(title))


def audit_title(title: Column) -> Column:
    """Words of a folded title without editions and without a leading article."""
    spaced = F.trim(F.regexp_replace(folded(without_editions(title)), "[^0-9a-z]+", " "))
    return F.regexp_replace(spaced, "^(?:" + "|".join(ARTICLES) + ") (?=.)", "")


def surnames(names: Column) -> Column:
    """The last words of the names that commas, & and the word and separate."""
    each = F.transform(F.split(names, ",|&| and "), lambda n: F.element_at(F.split(F.trim(F.regexp_replace(F.lower(n), "[^0-9a-z]+", " ")), " "), -1))
    return F.filter(each, lambda n: n != "")


def name_tokens(names: Column) -> Column:
    parts = F.split(F.replace(folded(F.coalesce(names, F.lit(""))), F.lit("n/a"), F.lit("")), r",| and |&|[\s.\-']+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 3))


def same_director(a: Column, b: Column) -> Column:
    """Whether two credits name one person; null where either names none."""
    x, y = name_tokens(a), name_tokens(b)
    shared = F.size(F.array_intersect(x, y))
    enough = (shared >= 2) | ((shared == 1) & ((F.size(x) <= 2) | (F.size(y) <= 2)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), enough)


def _closeness(a: str, b: str) -> float:
    """1 for strings of one length, less the more the lengths differ."""
    return (min(len(a), len(b)) / max(len(a), len(b), 1)) ** LENGTH_EXPONENT


@pandas_udf(DoubleType())
def similarity(queries: pd.Series, names: pd.Series) -> pd.Series:
    """The best ratio of matching blocks of a query with the whole name, or with one of its words, lowered where lengths differ.

    Names share their words: a batch's distinct pairs of query and string are compared once,
    those that can still win first.
    """
    ratios: dict[tuple[str, str], float] = {}

    def ratio(q: str, text: str) -> float:
        if (q, text) not in ratios:
            ratios[q, text] = SequenceMatcher(None, q, text).ratio()
        return ratios[q, text]

    def best(query: str, name: str) -> float:
        q, whole = query.lower().strip(), name.lower()
        weights = {word: _closeness(q, word) for word in whole.split()} | {whole: 1.0}
        found = 0.0
        for text, weight in sorted(weights.items(), key=lambda x: -x[1]):
            if weight <= found:  # a ratio is at most 1
                break
            found = max(found, weight * ratio(q, text))
        return found

    known = queries.notna() & names.notna()
    return pd.Series([best(q, n) if k else None for q, n, k in zip(queries, names, known, strict=True)], dtype="float64")


def length_bound(query: Column, name: Column) -> Column:
    """An upper bound of similarity from lengths alone, in generated code: what cannot reach a floor never meets the UDF."""
    q = F.length(F.trim(query))
    ratio = lambda n: F.least(q, n) * 2.0 / (q + n)
    per_word = F.transform(F.split(name, r"\s+"), lambda w: ratio(F.length(w)) * F.pow(F.least(q, F.length(w)) / F.greatest(q, F.length(w)), LENGTH_EXPONENT))
    return F.greatest(ratio(F.length(name)), F.array_max(F.filter(per_word, lambda x: x.isNotNull())))


@pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two normalised titles."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
