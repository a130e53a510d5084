"""Spans of syllables against a lexicon."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.fuzzy import Bounds, scored_span, span_score
from palimpsest.functions.syllables import split_syllables
from palimpsest.functions.text import DEVANAGARI, Script, token_skeleton
from palimpsest.operators.matching import BROADCAST_ROWS, SPAN_THRESHOLD, against, dealt

SEGMENT = ("line_index", "segment_index")


def spans(segments: DataFrame, most: int = 8, units: str = "units") -> DataFrame:
    """All runs of up to ``most`` units of each row's array: start, end (exclusive), span, n_units."""
    n = F.size(units)
    starts = segments.filter(n > 0).withColumn("start", F.explode(F.sequence(F.lit(0), n - 1)))
    both = starts.withColumn("end", F.explode(F.sequence(F.col("start") + 1, F.least(n, F.col("start") + most))))
    return both.withColumn("n_units", F.col("end") - F.col("start")).withColumn("span", F.array_join(F.slice(units, F.col("start") + 1, F.col("n_units")), ""))


def lattice(segments: DataFrame, lexicon: DataFrame, script: Script = DEVANAGARI, most_units: int = 8, least: float = SPAN_THRESHOLD, per_span: int = 5, text: str = "text", splitter: Callable[[Column], Column] = split_syllables) -> DataFrame:
    """Scored entries of every span: the segment's columns, start, end, span, entry, score, rank within the span.

    Distinct spans are scored once, and joined back. Equal scores keep the lexicon's order.
    ``splitter`` makes the units of a text; another one, of a library, can take its place.
    """
    cut = segments.withColumn("units", splitter(F.col(text)))
    placed = spans(cut, most_units)
    known = lexicon.select(F.col("token").alias("entry"), "normalized", "gloss", F.col("position").alias("entry_position"), F.size(splitter(F.col("normalized"))).alias("entry_units"))
    rows = lexicon.count()
    if rows <= BROADCAST_ROWS:
        ranked = _ranked(placed.select("span", "n_units").distinct(), known, script, least, per_span)
        return placed.join(ranked, ["span", "n_units"])
    a, b = F.length("span"), F.length("normalized")
    reach = 0.67 * 2 * F.least(a, b) / (a + b) + 0.25 + F.greatest(F.lit(0.0), 0.08 - 0.02 * F.abs(F.col("n_units") - F.col("entry_units"))) >= least
    pairs = against(dealt(placed.select("span", "n_units").distinct(), "span"), known, reach, rows)
    score = scored_span.asNondeterministic()("span", token_skeleton(F.col("span"), script), "n_units", "normalized", token_skeleton(F.col("normalized"), script), "entry_units")
    scored = pairs.withColumn("score", score).filter(F.col("score") >= least)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("span", "n_units").orderBy(F.desc("score"), "entry_position"))).filter(F.col("rank") <= per_span)
    return placed.join(ranked.select("span", "n_units", "entry", "gloss", "score", "rank", "entry_position"), ["span", "n_units"])


def _ranked(seen: DataFrame, known: DataFrame, script: Script, least: float, per_span: int) -> DataFrame:
    """The best entries of distinct spans, of a lexicon that every task can hold."""
    entries = known.filter("normalized is not null").withColumn("skeleton", token_skeleton(F.col("normalized"), script)).orderBy("entry_position").collect()
    shared = seen.sparkSession.sparkContext.broadcast([(r.normalized, r.skeleton, r.entry_units, r.entry, r.gloss, r.entry_position) for r in entries])
    position = known.schema["entry_position"].dataType.simpleString()
    dependent = f"[{script.dependent}]+"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = Bounds([e[0] for e in shared.value], re.compile(dependent))
        for part in parts:
            spans, units, bare = (part[c].tolist() for c in ("span", "n_units", "skeleton"))
            found: dict[int, list] = {}
            for i, j, *_ in bounds.parts(spans, least, spans=True):
                entry, skeleton, entry_units, *_ = shared.value[j]
                score = span_score(spans[i], bare[i], units[i], entry, skeleton, entry_units)
                if score >= least:
                    found.setdefault(i, []).append((-score, j))
            rows = [(spans[i], units[i], *shared.value[j][3:5], -score, rank, shared.value[j][5]) for i, pairs in found.items() for rank, (score, j) in enumerate(sorted(pairs)[:per_span], 1)]
            yield pd.DataFrame(rows, columns=["span", "n_units", "entry", "gloss", "score", "rank", "entry_position"])

    told = seen.filter("span <> ''").withColumn("skeleton", token_skeleton(F.col("span"), script))
    return dealt(told, "span").mapInPandas(run, f"span string, n_units int, entry string, gloss string, score double, rank int, entry_position {position}")


def best_spans(found: DataFrame, segment: tuple[str, ...] = SEGMENT) -> DataFrame:
    """The best entry of each segment: highest score, then first start, end and entry."""
    order = Window.partitionBy(*segment).orderBy(F.desc("score"), "start", "end", "entry_position")
    return found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
