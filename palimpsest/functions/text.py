"""Text as Column expressions. Script-specific functions take the script's character class."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Script:
    """A character class (without brackets), and the part of it that a skeleton leaves out."""

    letters: str
    dependent: str


# Unicode ranges.
DEVANAGARI = Script(r"\u0900-\u097F", r"\u0900-\u0903\u093A-\u094D\u0951-\u0957\u0962-\u0963")
LATIN = Script("A-Za-z", "AEIOUaeiou")


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC. Spark has no such function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: Characters below U+0300 compose with nothing and are composed themselves.
MAY_COMPOSE = r"[^\x{0}-\x{2FF}]"


def normalize_token(text: Column, script: Script = DEVANAGARI, compose: bool = True) -> Column:
    """Only the script's characters, composed. ``compose=False`` keeps the expression free of Python; with it only texts go there that may change."""
    if compose:
        text = F.coalesce(composed(F.when(text.rlike(MAY_COMPOSE), text)), text)
    return F.regexp_replace(text, f"[^{script.letters}]+", "")


def token_skeleton(token: Column, script: Script = DEVANAGARI) -> Column:
    return F.regexp_replace(token, f"[{script.dependent}]+", "")


def tokenize(text: Column, script: Script = DEVANAGARI, least: int = 2, compose: bool = False) -> Column:
    """Runs of the script's characters of at least ``least`` characters, in order."""
    return F.regexp_extract_all(composed(text) if compose else text, F.lit(f"[{script.letters}]{{{max(least, 1)},}}"), F.lit(0))


def visible(text: Column) -> Column:
    """Number of characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def character_counts(text: Column) -> Column:
    """Struct of all and of non-white characters; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.length(text).cast("long").alias("characters"), visible(text).cast("long").alias("non_whitespace_characters"))


def class_ratio(text: Column, pattern: str, n: Column | None = None) -> Column:
    """Share of the visible characters (``n``, if that is at hand) that are of a bracketed class; 0 if none is visible."""
    n = visible(text) if n is None else n
    # What goes when runs are taken out: no array of single characters is made.
    return F.when(n > 0, (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("double") / n).otherwise(0.0)


def script_ratio(text: Column, script: Script = DEVANAGARI) -> Column:
    return class_ratio(text, f"[{script.letters}]")


def latin_ratio(text: Column) -> Column:
    return class_ratio(text, "[A-Za-z]")


@lru_cache(maxsize=1)
def _other_digits() -> str:
    """Ranges of the characters that have a digit value but are no decimal digits."""
    found = [c for c in range(0x110000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    starts = [c for c, before in zip(found, [-1, *found], strict=False) if c != before + 1]
    ends = [c for c, after in zip(found, [*found[1:], -1], strict=True) if after != c + 1]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


def digit_ratio(text: Column, n: Column | None = None) -> Column:
    """Decimal digits and all other characters with a digit value, such as superscripts or circled digits."""
    return class_ratio(text, rf"[\p{{Nd}}{_other_digits()}]", n)


def lexical_ratio(tokens: Column, lexicon: Column | list[str]) -> Column:
    """Share of ``tokens`` in the array ``lexicon``; 0 if either is empty. A list is looked up by hash, an array from end to end."""
    n = F.size(tokens)
    held = isinstance(lexicon, list)
    hits = F.size(F.filter(tokens, lambda t: t.isin(lexicon) if held else F.array_contains(lexicon, t)))
    size = F.lit(len(lexicon)) if held else F.size(lexicon)
    return F.when((n > 0) & (size > 0), hits.cast("double") / n).otherwise(0.0)


def heuristic_score(confidence: Column, script: Column, lexical: Column, latin: Column, digits: Column, visible: Column) -> Column:
    """Weighted quality of a recognition result; ``visible`` counts its visible characters."""
    bonus = F.when(visible > 0, F.least(F.lit(1.0), F.log1p(visible) / 5)).otherwise(0.0)
    penalty = F.when((visible > 0) & (visible < 6), 0.15).otherwise(0.0)
    return 0.35 * confidence + 0.30 * script + 0.25 * lexical + 0.10 * bonus - 0.35 * latin - 0.20 * digits - penalty


def text_score(text: Column, confidences: Column) -> Column:
    """Struct of the mean confidence (0 for none) and the visible characters: the order in which results are preferred."""
    n = F.size(confidences)
    mean = F.when(n > 0, F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    return F.struct(mean.alias("mean_score"), character_counts(text)["non_whitespace_characters"].alias("non_whitespace_characters"))


def fallback_text(normalized: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(normalized, F.lit("")), F.trim(raw))


def joined_lines(texts: Column, separator: str = "\n") -> Column:
    """Texts without margins, blank ones left out."""
    return F.array_join(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""), separator)


#: A part of a list: in either kind of quotes, which may hold the other kind.
QUOTED = """(?:'[^']*'|"[^"]*")"""


def split_candidates(output: Column, most: int | None = None, bracketed: bool = True) -> Column:
    """Lists of parts in the ``Split:`` lines of an analyser's output, each list once, the first ``most``.

    ``bracketed`` takes what looks like a list; otherwise the rest of the line must be one.
    """
    pattern = r"Split:\s*(\[.*\])" if bracketed else r"Split:\s*(.*)"
    lines = F.filter(F.split(F.coalesce(output, F.lit("")), "\r\n|\n|\r"), lambda x: x.rlike(pattern))
    texts = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, pattern, 1))), lambda x: x.rlike(f"^\\[\\s*(?:{QUOTED}\\s*(?:,\\s*{QUOTED}\\s*)*)?\\]$"))
    lists = F.transform(texts, lambda x: F.transform(F.regexp_extract_all(x, F.lit(QUOTED), F.lit(0)), lambda p: F.substring(p, F.lit(2), F.length(p) - 2)))
    found = F.array_distinct(lists)
    return F.slice(found, 1, most) if most is not None else found


def combined_output(stdout: Column, stderr: Column) -> Column:
    return F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))


def parse_cost(output: Column) -> Column:
    return F.regexp_extract(output, r"Parse 0 : \(Cost = ([0-9.]+)\)", 1).try_cast("double")


def parse_score(output: Column) -> Column:
    """1 / (1 + cost); 0 without a parse."""
    cost = parse_cost(output)  # greatest() would take a null for nothing
    return F.when(cost.isNotNull(), 1 / (1 + F.greatest(cost, F.lit(0.0)))).otherwise(0.0)


def has_morphology(output: Column) -> Column:
    return F.coalesce(F.contains(output, F.lit("Morphological tags:")) & output.rlike(r"(?m)^\([^\n]+\)$"), F.lit(False))


def has_split(output: Column) -> Column:
    return F.coalesce(F.contains(output, F.lit("Split:")) & ~F.contains(output, F.lit("No Splits Found")), F.lit(False))


def safe_double(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def safe_int(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(0))


def local_score(base: Column, rank: Column) -> Column:
    """The better of a candidate's own score and 1 / (rank + 1)."""
    return F.greatest(F.coalesce(base, F.lit(0.0)), 1 / (rank + 1))


def split_score(scores: Column, skipped: Column) -> Column:
    """Mean step score less 0.06 for each further part and 0.08 for each skipped character, within 0 and 1."""
    n = F.size(scores)
    mean = F.when(n > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean - 0.06 * F.greatest(n - 1, F.lit(0)) - 0.08 * skipped))


def json_payload(text: Column) -> Column:
    """The JSON object in a reply: code fences go, else what is between the outermost braces; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    whole, inner = F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(whole.isNotNull(), F.when(is_object(whole), whole)).when(is_object(inner), inner)


def shortened(text: Column, most: int) -> Column:
    """Texts over ``most`` characters end in three dots after the first ``most`` - 1."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("..."))).otherwise(text)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.5, "high").when(score >= 0.25, "medium").otherwise("low")


def changed(observed: Column, best: Column) -> Column:
    return ~observed.eqNullSafe(best)


UNKNOWN = "<unknown>"


def known_or(text: Column, other: str = UNKNOWN) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(other))


def plus_separated(text: Column) -> Column:
    """Parts of a word analysis, joined by plus signs whatever separated them."""
    text = known_or(text)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s*\+\s*", " + "), "\\s*[|/,;\\-\u2013\u2014]\\s*", " + "), r"\s+", " "))
    return F.when((text == UNKNOWN) | F.contains(plain, F.lit(" + ")), plain).otherwise(F.replace(plain, F.lit(" "), F.lit(" + ")))


# The confidence that a reviewer's words stand for.
CONFIDENCE_WORDS = {"low": 0.30, "medium": 0.60, "high": 0.85, "very high": 0.95, "very_low": 0.20, "very low": 0.20, "मध्यम": 0.60, "कम": 0.30, "उच्च": 0.85}


def numeric_confidence(value: Column) -> Column:
    """A confidence in words, per cent or as a fraction, with two digits; 0.00 if there is none."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    words = F.create_map(*(F.lit(x) for pair in CONFIDENCE_WORDS.items() for x in pair))
    number = F.regexp_extract(text, r"\d+(?:\.\d+)?(?:e-?\d+)?", 0).try_cast("double")
    share = F.when(number.isNotNull(), F.least(F.lit(1.0), F.when(number > 1, number / 100).otherwise(number)))
    return F.format_string("%.2f", F.coalesce(F.try_element_at(words, text), share, F.lit(0.0)))


def score_text(score: Column) -> Column:
    """:func:`numeric_confidence` of a double, without going through its text: sign and what is no number count for nothing there."""
    n = F.abs(score)
    share = F.when(n < float("inf"), F.least(F.lit(1.0), F.when(n > 1, n / 100).otherwise(n)))
    return F.format_string("%.2f", F.coalesce(share, F.lit(0.0)))


def page_name(number: Column) -> Column:
    return F.format_string("page_%03d.png", number)


def arrows(pairs: Column, left: str, right: str) -> Column:
    """Lines ``left -> right`` of an array of structs."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p[left], F.lit(" -> "), p[right])), "\n")


def suggestion_rows(suggestions: Column, most: int = 8) -> Column:
    """The ``most`` best suggestions as lines; those with a blank token are left out.

    ``suggestions``: structs of combined_score, observed_token, best_surface, source, candidate_gloss.
    """
    ordered = F.array_sort(suggestions, lambda a, b: F.when(a["combined_score"] > b["combined_score"], -1).when(a["combined_score"] < b["combined_score"], 1).otherwise(0))
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))

    def row(s: Column) -> Column:
        observed, best, gloss = blank(s["observed_token"]), blank(s["best_surface"]), blank(s["candidate_gloss"])
        arrow = F.when((best != "") & (best != observed), F.concat(F.lit(" -> "), best)).otherwise("")
        tail = F.when(gloss != "", F.concat(F.lit(" | gloss="), gloss)).otherwise("")
        return F.concat(F.lit("- "), observed, arrow, F.lit(" | source="), blank(s["source"]), F.lit(" | score="), F.format_string("%.3f", s["combined_score"].cast("double")), tail)

    return F.slice(F.transform(F.filter(ordered, lambda s: blank(s["observed_token"]) != ""), row), 1, most)
