"""Porter's suffix stripping of English words (1980), and tokens folded and stemmed for an index."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published suffix lists of steps 2, 3 and 4.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[i - 1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@functools.lru_cache(200_000)
def porter(word: str) -> str:
    """The stem; words of other letters than a-z, or of fewer than 3, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        hit = max((p for p in table if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    end = max((s for s in STEP_4 if w.endswith(s)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if _double(w) and w.endswith("l") and _measure(w) > 1:
        w = w[:-1]
    return w


def index_tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits without their diacritics, stemmed."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    return [porter(t) for t in re.findall(r"[^\W_]+", folded)]


def stemmed(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(index_tokens)

    return run(text)
