"""Column functions on literals."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import fuzzy, syllables, text


def cases():
    return [
        (text.normalize_token(F.lit("१ कमल, abc ख़ ।")), "१कमल" + unicodedata.normalize("NFC", "ख़") + "।"),
        (text.token_skeleton(F.lit("संस्कृतम्")), "ससकतम"),
        (text.tokenize(F.lit("नमः क शिव abc गण")), ["नमः", "शिव", "गण"]),
        (text.tokenize(F.lit("A bc def"), text.LATIN), ["bc", "def"]),
        (text.tokenize(F.lit(""), text.LATIN), []),
        (text.digit_ratio(F.lit("a1² ")), 2 / 3),
        (text.latin_ratio(F.lit("  ")), 0.0),
        (text.script_ratio(F.lit("गण ab")), 0.5),
        (text.lexical_ratio(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), 0.5),
        (text.joined_lines(F.array(F.lit(" a "), F.lit(" "), F.lit("b"))), "a\nb"),
        (text.split_candidates(F.lit("x\nSplit: ['a', 'b']\nSplit: ['a', 'b']\nSplit: ['c']\nSplit: no"), 5), [["a", "b"], ["c"]]),
        (text.split_candidates(F.lit("Split: ['a']\nSplit: ['b']"), 1), [["a"]]),
        (text.split_candidates(F.lit(None).cast("string")), []),
        (text.parse_cost(F.lit("Parse 0 : (Cost = 2.5)")), 2.5),
        (text.parse_score(F.lit("Parse 0 : (Cost = 1.0)")), 0.5),
        (text.parse_score(F.lit("none")), 0.0),
        (text.has_morphology(F.lit("Morphological tags:\n(m, n)\n")), True),
        (text.has_morphology(F.lit("(m, n)")), False),
        (text.has_split(F.lit("Split: No Splits Found")), False),
        (text.safe_double(F.lit("x")), 0.0),
        (text.safe_int(F.lit("12")), 12),
        (text.text_score(F.lit("a b"), F.array(F.lit(0.5), F.lit(1.0)))["mean_score"], 0.75),
        (text.text_score(F.lit(None).cast("string"), F.array().cast("array<double>"))["non_whitespace_characters"], 0),
        (text.local_score(F.lit(0.2), F.lit(1)), 0.5),
        (text.split_score(F.array(F.lit(0.9), F.lit(0.7)), F.lit(1)), 0.8 - 0.06 - 0.08),
        (text.split_score(F.array().cast("array<double>"), F.lit(0)), 0.0),
        (text.shortened(F.lit("abcdefgh"), 5), "abcd..."),
        (text.shortened(F.lit("abc  fgh"), 5), "abc..."),
        (text.confidence_label(F.lit(0.25)), "medium"),
        (text.known_or(F.lit("  ")), "<unknown>"),
        (text.plus_separated(F.lit("a | b-c")), "a + b + c"),
        (text.plus_separated(F.lit("a b")), "a + b"),
        (text.plus_separated(F.lit(None).cast("string")), "<unknown>"),
        (text.plus_separated(F.lit("one")), "one"),
        (text.numeric_confidence(F.lit("Very High")), "0.95"),
        (text.numeric_confidence(F.lit("about 85%")), "0.85"),
        (text.numeric_confidence(F.lit("0.5")), "0.50"),
        (text.numeric_confidence(F.lit("")), "0.00"),
        (text.numeric_confidence(F.lit("उच्च")), "0.85"),
        (text.page_name(F.lit(7)), "page_007.png"),
        (text.json_payload(F.lit('```json\n{"a": 1}\n```')).cast("string"), '{"a":1}'),
        (text.json_payload(F.lit('so: {"a": {"b": 2}} ok')).cast("string"), '{"a":{"b":2}}'),
        (text.json_payload(F.lit("[1]")).cast("string"), None),
        (text.json_payload(F.lit("nothing")).cast("string"), None),
    ]


def test_functions(spark):
    """All in one select: columns can only be made with a session."""
    columns, expected = zip(*cases(), strict=True)
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    for i, (found, want) in enumerate(zip(row, expected, strict=True)):
        assert (found == pytest.approx(want) if isinstance(want, float) else found == want), (i, found, want)


def test_suggestion_rows(spark):
    rows = spark.sql("select array(struct(0.1 as combined_score, 'a' as observed_token, 'a' as best_surface, 'observed' as source, '' as candidate_gloss), named_struct('combined_score', 0.9, 'observed_token', 'b', 'best_surface', 'c', 'source', 'lexicon', 'candidate_gloss', 'see'), named_struct('combined_score', 0.5, 'observed_token', ' ', 'best_surface', 'x', 'source', 'y', 'candidate_gloss', '')) as s")
    assert rows.select(text.suggestion_rows(F.col("s"), 2)).first()[0] == ["- b -> c | source=lexicon | score=0.900 | gloss=see", "- a | source=observed | score=0.100"]


SKELETON = __import__("re").compile("[ऀ-ःऺ-्॑-ॗॢ-ॣ]+")


@pytest.mark.parametrize(("observed", "entry", "score"), [("गण", "गण", 0.98), ("गण", "गणना", 0.72), ("भ्रगणयायनम", "गण", 0.64), ("विधिर", "विधि", 0.8533), ("तत्र", "तत्", 0.8343)])
def test_token_score(observed, entry, score):
    assert fuzzy.token_score(observed, entry, SKELETON)[0] == score


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeilorst", max_size=14), st.text(alphabet="abeilorst", min_size=1, max_size=7))
def test_no_score_is_over_its_bound(observed, entry):
    vowels = __import__("re").compile("[aeiou]+")
    assert fuzzy.token_score(observed, entry, vowels)[0] <= fuzzy.attainable(observed, entry, vowels) + 1e-4


@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
@settings(max_examples=300, deadline=None)
def test_ratio_equals_difflib(a, b):
    assert fuzzy.ratio(a, b) == (SequenceMatcher(None, a, b).ratio() if a and b else 0.0)


@given(st.text("abcd", min_size=1, max_size=20), st.text("abcd", max_size=8))
@settings(max_examples=300, deadline=None)
def test_best_window_is_the_first_of_the_best(observed, entry):
    n = max(2, len(entry) + 2)
    windows = [observed] if len(observed) <= n else [observed[i : i + n] for i in range(len(observed) - n + 1)]
    best = max(fuzzy.ratio(w, entry) for w in windows)
    assert fuzzy.best_window(observed, entry) == (best, next(w for w in windows if fuzzy.ratio(w, entry) == best))


def test_ratio_is_not_symmetric():
    assert fuzzy.ratio("tide", "diet") == 0.25 and fuzzy.ratio("diet", "tide") == 0.5 and fuzzy.ratio("", "a") == 0.0


def test_span_score():
    assert fuzzy.span_score("गण", "गण", 2, "गण", "गण", 2) == 1.0


@pytest.mark.parametrize(("word", "units"), [("क्षिति", ["क", "्षि", "ति"]), ("नमः", ["न", "मः"]), ("संज्ञा", ["सं", "ज", "्ञा"]), ("abc", []), ("", [])])
def test_syllables(word, units):
    assert syllables.syllables(word) == units


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="कखग़्ाि॥ंx ", max_size=14))
def test_syllables_keep_every_character(word):
    assert "".join(syllables.syllables(word)) == "".join(c for c in unicodedata.normalize("NFC", word) if "ऀ" <= c <= "ॿ")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="kgcjtdnpbmyrlvsaAiIuUeo", min_size=1, max_size=10))
def test_transliteration_round_trip(word):
    assert syllables.romanised(syllables.from_slp1(word), 0) == word


def test_iast():
    assert syllables.romanised("संस्कृतम्", 1) == "saṃskṛtam"


def test_scores_as_text_equal_confidences(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.004, 0.005, 0.3001, -0.25, 0.999, 1.0, 1.5, 85.0, 1e-7, 1e9, float("nan"), float("inf"), None)], "x double")
    assert all(a == b for a, b in rows.select(text.score_text(F.col("x")), text.numeric_confidence(F.col("x"))).collect())


def test_only_texts_that_may_change_are_composed(spark):
    rows = spark.createDataFrame([("caf\u0065\u0301 x",), ("caf\u00e9 y",), ("plain",), (None,)], "t string")
    told = rows.select(text.normalize_token(F.col("t"), text.LATIN), F.col("t").rlike(text.MAY_COMPOSE)).collect()
    assert [tuple(r) for r in told] == [("cafx", True), ("cafy", False), ("plain", False), (None, None)]
