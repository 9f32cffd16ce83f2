"""English suffix stripping (Porter, 1980) as an Arrow UDF over arrays of words.

Written from the published description: a word's measure m counts its vowel-consonant
sequences; each step has suffixes with a replacement and a condition on what is left.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: Fixed values of steps 2, 3 and 4: suffixes and what they become.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for steps in (STEP_2, STEP_3):
        hits = [(end, new) for end, new in steps if w.endswith(end)]
        if hits:
            end, new = max(hits, key=lambda x: len(x[0]))
            if _measure(w[: -len(end)]) > 0:
                w = w[: -len(end)] + new
    hits = [end for end in STEP_4 if w.endswith(end)]
    if hits:
        end = max(hits, key=len)
        left = w[: -len(end)]
        if _measure(left) > 1 and (end != "ion" or left.endswith(("s", "t"))):
            w = left
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@pandas_udf(ArrayType(StringType()))
def stems(arrays: pd.Series) -> pd.Series:
    """Each word's stem; a batch's words are stemmed once."""
    known: dict[str, str] = {}

    def of(words):
        return None if words is None else [known[w] if w in known else known.setdefault(w, stem(w)) for w in words if w is not None]

    return arrays.map(of)
