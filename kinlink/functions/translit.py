"""Transliteration of other scripts to ASCII, as a pandas UDF over Arrow batches.

Latin, Greek and Cyrillic letters go by their Unicode decomposition and names; the Indic blocks share one
layout (128 code points each), so one table of offsets serves nine scripts. Text that is ASCII already
isn't touched.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Consonants, vowels and signs by their offset in an Indic block (fixed values).
CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh n ch chh j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split(), strict=True))
VOWELS = dict(zip(range(0x05, 0x15), "a aa i ii u uu ri l e e e ai o o o au".split(), strict=True))
SIGNS = dict(zip(range(0x3E, 0x4D), "aa i ii u uu ri ri e e e ai o o o au".split(), strict=True))
INDIC = range(0x0900, 0x0D80)
_VIRAMA, _NASAL = 0x4D, (0x01, 0x02)


@lru_cache(maxsize=65536)
def letter(c: str) -> str:
    """One letter of another alphabet in ASCII, '' if there is no way to tell."""
    plain = unicodedata.normalize("NFKD", c)
    out = "".join(x for x in plain if x.isascii())
    if out or not c.isalpha():
        return out or (" " if c.isspace() else "")
    name = unicodedata.name(c, "").split(" WITH ")[0].split()
    if "LETTER" in name and name[0] in ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "GEORGIAN", "HEBREW", "ARABIC"):
        word = name[-1].lower()
        if len(word) == 2 and "e" in word and word != "ye":  # names such as PE and ER
            return word.replace("e", "", 1)
        return {"alpha": "a", "beta": "b", "gamma": "g", "delta": "d", "epsilon": "e", "zeta": "z", "eta": "i", "theta": "th"}.get(word, word if len(word) <= 3 else word[:1])
    return ""


def transliterate_text(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    out: list[str] = []
    open_a = False  # a consonant whose inherent vowel isn't decided yet
    for n, c in enumerate(text):
        code = ord(c)
        if code in (0x200C, 0x200D):
            continue
        if code in INDIC:
            at = code % 0x80
            if at in SIGNS and open_a:
                out.append(SIGNS[at])
                open_a = False
                continue
            if at == _VIRAMA:
                open_a = False
                continue
            if open_a:
                out.append("a")
            open_a = False
            if at in CONSONANTS:
                out.append(CONSONANTS[at])
                follows = text[n + 1 : n + 2]
                open_a = bool(follows) and ord(follows) in INDIC  # no vowel at the end of a word
            elif at in VOWELS:
                out.append(VOWELS[at])
            elif at in _NASAL:
                out.append("n")
            elif 0x66 <= at <= 0x6F:
                out.append(str(at - 0x66))
            continue
        if open_a:
            out.append("a")
        open_a = False
        out.append(c if c.isascii() else letter(c))
    return "".join(out)


@F.pandas_udf(T.StringType())
def transliterate(text: pd.Series) -> pd.Series:
    return text.map(transliterate_text, na_action="ignore")
