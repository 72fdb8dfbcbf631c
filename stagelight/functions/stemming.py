"""English stems by the Porter2 rules, and the words that a full-text search leaves out.

A stem depends on the word alone, so a corpus is stemmed by its distinct words, which are few, and joined back: see `stems_of`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The stop words of English full-text search.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now
""".split()
#: Words whose stem no rule gives, and words left as they are, at once and after the plural is gone.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = "sky news howe atlas cosmos bias andes".split()
SETTLED = "inning outing canning herring earring proceed exceed succeed".split()
#: Beginnings after which the first region starts.
HEADS = ("gener", "commun", "arsen")
#: Endings and what they become, by step.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_VOWELS = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
#: A short syllable at the end: a vowel between two other letters, the last none of w, x, Y; or a vowel and another letter as all there is.
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has; empty if none."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _marked(word: str) -> str:
    """Y for each y that begins the word or follows a vowel, where it is no vowel."""
    out = ""
    for c in word:
        out += "Y" if c == "y" and (not out or out[-1] in _VOWELS) else c
    return out


def stem(word: str) -> str:
    """The Porter2 stem of a small-letter word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3 or word in INVARIANT:
        return word
    w = _marked(word.removeprefix("'"))
    head = next((h for h in HEADS if w.startswith(h)), "")
    after = _REGION.search(w)
    first = len(head) or (after.end() if after else len(w))
    after = _REGION.search(w, first)
    second = after.end() if after else len(w)

    w = w.removesuffix("'").removesuffix("'s")
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in SETTLED:
        return w

    if e := _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly")):
        base = w[: -len(e)]
        if e.startswith("eed"):
            if len(base) >= first:
                w = base + "ee"
        elif re.search("[aeiouy]", base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _DOUBLE.search(w):
                w = w[:-1]
            elif len(w) <= first and _SHORT.search(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"

    if (e := _ending(w, SECOND)) and len(w) - len(e) >= first:
        base = w[: -len(e)]
        if e == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif e == "li":
            w = base if base[-1:] in tuple("cdeghkmnrt") else w
        else:
            w = base + SECOND[e]
    if (e := _ending(w, THIRD)) and len(w) - len(e) >= (second if e == "ative" else first):
        w = w[: -len(e)] + THIRD[e]
    if (e := _ending(w, FOURTH)) and len(w) - len(e) >= second and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]

    if w.endswith("e"):
        base = w[:-1]
        if len(base) >= second or (len(base) >= first and not _SHORT.search(base)):
            w = base
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.lower()


def lexeme(word: str) -> str | None:
    """What full-text search keeps of a word: its stem, or nothing of a stop word."""
    return None if word in _STOPS else stem(word)


_STOPS = frozenset(STOP_WORDS)


@F.pandas_udf(T.StringType())
def lexemes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for words in batches:
        yield words.map(lexeme, na_action="ignore")


def stems_of(words: DataFrame, word: str | Column = "word") -> DataFrame:
    """word, stem of the distinct words; stop words are left out."""
    distinct = words.select((F.col(word) if isinstance(word, str) else word).alias("word")).distinct()
    return distinct.withColumn("stem", lexemes("word")).where("stem is not null")
