"""Syllable units and transliteration of Devanagari."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signs that continue a unit; the two after which the next character joins.
SIGNS = "\u0900\u0901\u0902\u0903\u093a\u093b\u093c\u093e\u093f\u0940\u0941\u0942\u0943\u0944\u0945\u0946\u0947\u0948\u0949\u094a\u094b\u094c\u094e\u094f\u0951\u0952\u0953\u0954\u0955\u0956\u0957\u0962\u0963"
JOINERS = "\u094d\u093c"
#: A unit: a character of the script, then signs or whatever follows a joiner. The virama is
#: no sign: it opens a unit, which then takes in the character after it.
UNIT = re.compile(f"[{JOINERS}][\u0900-\u097f]?(?:(?<=[{JOINERS}])[\u0900-\u097f]|[{SIGNS}])*|[\u0900-\u097f](?:(?<=[{JOINERS}])[\u0900-\u097f]|[{SIGNS}])*")


def syllables(text: str | None) -> list[str]:
    return UNIT.findall(unicodedata.normalize("NFC", text or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_syllables(text: pd.Series) -> pd.Series:
    return text.map(syllables)


# Devanagari letters, and their SLP1 and IAST forms in the same order.
VOWELS = dict(zip("अआइईउऊऋॠऌॡएऐओऔ", zip("aAiIuUfFxXeEoO", "a ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split(), strict=True), strict=True))
MATRAS = dict(zip("ािीुूृॄॢॣेैोौ", list(VOWELS.values())[1:], strict=True))
CONSONANTS = dict(zip(
    "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह",
    zip("kKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzsh", "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h".split(), strict=True), strict=True,
))
MARKS = {"ं": ("M", "ṃ"), "ः": ("H", "ḥ"), "ँ": ("~", "m̐"), "ऽ": ("'", "'"), "ळ": ("L", "ḻ")}
DIGITS = {chr(0x966 + i): (str(i), str(i)) for i in range(10)}
VIRAMA = "\u094d"


def romanised(text: str, scheme: int) -> str:
    """Devanagari in SLP1 (0) or IAST (1); other characters stay."""
    out = []
    for i, c in enumerate(text):
        if c in CONSONANTS:
            out.append(CONSONANTS[c][scheme])
            follows = text[i + 1 : i + 2]
            if follows != VIRAMA and follows not in MATRAS:
                out.append("a")
        elif c != VIRAMA:
            found = VOWELS.get(c) or MATRAS.get(c) or MARKS.get(c) or DIGITS.get(c)
            out.append(found[scheme] if found else c)
    return "".join(out)


def from_slp1(text: str) -> str:
    """Devanagari of an SLP1 text; a text that holds Devanagari already stays."""
    if re.search("[\u0900-\u097f]", text):
        return text
    vowels = {v[0]: (k, m) for (k, v), m in zip(VOWELS.items(), ["", *MATRAS], strict=True)}
    consonants = {v[0]: k for k, v in CONSONANTS.items()}
    marks = {v[0]: k for k, v in MARKS.items()}
    out, open_end = [], False
    for c in text:
        if c in consonants:
            out.append((VIRAMA if open_end else "") + consonants[c])
            open_end = True
        elif c in vowels:
            out.append(vowels[c][1 if open_end else 0])
            open_end = False
        else:
            out.append((VIRAMA if open_end else "") + marks.get(c, c))
            open_end = False
    return "".join(out) + (VIRAMA if open_end else "")


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("devanagari", "slp1", "iast")]))
def transliterations(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(t, romanised(t, 0), romanised(t, 1)) if t is not None else (None, None, None) for t in text], columns=["devanagari", "slp1", "iast"])


@F.pandas_udf(T.StringType())
def to_devanagari(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else from_slp1(t))
