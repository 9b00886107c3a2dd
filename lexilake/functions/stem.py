"""English stems by Snowball's published rules (Porter, "The English (Porter2) stemming algorithm"), a word at a time.

stem_words runs them over Arrow batches, each distinct word of a batch once; frequent words stay in a bounded cache.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words with a stem of their own, words left alone, and beginnings after which the first region starts.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT_ALONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = ("gener", "commun", "arsen")
# Endings of the steps with what takes their place; longer ones stand before those that end them.
STEP_2 = (
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

VOWELS = "aeiouy"
REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
BEGUN = re.compile("|".join(BEGINNINGS))
SHORT = re.compile(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]\Z|^[aeiouy][^aeiouy]\Z", re.S)
VOWEL = re.compile(f"[{VOWELS}]")


def _regions(word: str) -> tuple[int, int]:
    """Where the regions R1 and R2 begin."""
    first = BEGUN.match(word) or REGION.match(word)
    if not first:
        return len(word), len(word)
    second = REGION.match(word, first.end())
    return first.end(), second.end() if second else len(word)


def _replaced(word: str, endings, start: int, allowed) -> str:
    """The word with the first of endings that it has replaced, if that lies beyond start and the rest is allowed."""
    for ending, to in endings:
        if word.endswith(ending):
            rest = word[: -len(ending)]
            return rest + to if len(rest) >= start and allowed(ending, rest) else word
    return word


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")) or not w.endswith("s"):
        return w
    return w[:-1] if VOWEL.search(w[:-2]) else w


def _past(w: str, r1: int) -> str:
    for ending in ("eedly", "eed"):
        if w.endswith(ending):
            return w[: -len(ending)] + "ee" if len(w) - len(ending) >= r1 else w
    for ending in ("ingly", "edly", "ing", "ed"):
        if w.endswith(ending):
            rest = w[: -len(ending)]
            if not VOWEL.search(rest):
                return w
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if rest[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                return rest[:-1]
            return rest + "e" if len(rest) <= r1 and SHORT.match(rest) else rest
    return w


def _last(w: str, r1: int, r2: int) -> str:
    rest = w[:-1]
    if w.endswith("e") and (len(rest) >= r2 or len(rest) >= r1 and not SHORT.match(rest)):
        return rest
    return rest if w.endswith("ll") and len(rest) >= r2 else w


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.removeprefix("'")
    w = re.sub("([aeiouy])y", r"\1Y", "Y" + w[1:] if w.startswith("y") else w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    w = _plural(w)
    if w in LEFT_ALONE:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _replaced(w, STEP_2, r1, lambda e, rest: e not in ("ogi", "li") or rest.endswith("l" if e == "ogi" else tuple("cdeghkmnrt")))
    w = _replaced(w, STEP_3, r1, lambda e, rest: e != "ative" or len(rest) >= r2)
    w = _replaced(w, ((e, "") for e in STEP_4), r2, lambda e, rest: e != "ion" or rest.endswith(("s", "t")))
    return _last(w, r1, r2).replace("Y", "y")


def stem_words(words: Column) -> Column:
    """The stem of each word of a column; null stays null."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        code, distinct = pd.factorize(column)
        return pd.Series([*map(stem, distinct), None], dtype=object).take(code).reset_index(drop=True)

    return run(words)
