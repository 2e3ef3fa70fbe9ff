"""The Porter stemmer (Porter, 1980), and the tokens of a stemmed index."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = set("aeiou")


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    return not (c == "y" and i > 0 and _consonant(w, i - 1))


_FORMS = str.maketrans("abcdefghijklmnopqrstuvwxyz", "".join("v" if c in _VOWELS else "c" for c in "abcdefghijklmnopqrstuvwxyz"))


def _forms(stem: str) -> str:
    """c or v for each letter."""
    if "y" in stem:
        return "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return stem.translate(_FORMS)


def _measure(stem: str) -> int:
    return _forms(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _forms(stem)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


# The suffixes of steps 2, 3 and 4 and what they become.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


_BY_SUFFIX = [(dict(pairs), sorted({len(e) for e, _ in pairs}, reverse=True)) for pairs in (_STEP2, _STEP3, tuple((e, "") for e in _STEP4))]


def _longest(w: str, step: int) -> str | None:
    """The longest suffix of step 2, 3 or 4 that a word ends with."""
    known, lengths = _BY_SUFFIX[step - 2]
    return next((w[-n:] for n in lengths if w[-n:] in known), None)


@lru_cache(200_000)
def stem(w: str) -> str:
    """The stem of a lower-case word; words of fewer than three letters, or with other characters than a-z, stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((len(e) for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), 0)
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for step in (2, 3):
        # the longest suffix that matches decides, whether or not it may go
        found = _longest(w, step)
        if found and _measure(w[: -len(found)]) > 0:
            w = w[: -len(found)] + _BY_SUFFIX[step - 2][0][found]
    found4 = _longest(w, 4)
    if found4:
        base = w[: -len(found4)]
        if _measure(base) > 1 and (found4 != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_TOKEN = re.compile(r"[^\W_]+")


_BEYOND = re.compile(r"[^\x00-\x7f]+")


@lru_cache(100_000)
def _bare(run: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", run) if not unicodedata.combining(c))


def unaccented(text: str | None) -> str:
    """Lower case, without marks on letters."""
    low = (text or "").lower()
    return low if low.isascii() else _BEYOND.sub(lambda m: _bare(m[0]), low)


def tokens_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower case, without accents, stemmed."""
    return [stem(t) for t in _TOKEN.findall(unaccented(text))]


class _Stems(dict):
    """Stems by token. A token that is not there is stemmed; those that are there are never walked through, however many they are."""

    def __missing__(self, token: str) -> str:
        found = self[token] = stem.__wrapped__(token)  # remembered here
        return found


_STEMS = _Stems()
#: Stems that a worker remembers at most.
REMEMBERED = 500_000


def stemmed_tokens_of(text: str | None) -> list[str]:
    """As :func:`tokens_of`; a worker stems a token once while it remembers it."""
    if len(_STEMS) > REMEMBERED:
        _STEMS.clear()
    return [_STEMS[t] for t in _TOKEN.findall(unaccented(text))]


def stemmed_tokens(c: Column) -> Column:
    """Tokens of a text column, by Arrow batches; a worker stems a token once while it remembers it."""

    @F.pandas_udf("array<string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([stemmed_tokens_of(t) for t in part], index=part.index)

    return run(c)
