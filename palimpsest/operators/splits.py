"""The k best segmentations of a token into lexicon entries and noise."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.fuzzy import Bounds, token_score
from palimpsest.functions.text import DEVANAGARI, Script, has_morphology, has_split
from palimpsest.operators.matching import BROADCAST_ROWS, dealt

PER_START = 12
#: Tokens whose spans are scored together.
STRETCH = 2000
STEPS = "array<struct<kind:string,surface:string,normalized:string,score:double,lemma:string,pos:string,gloss:string>>"
SCHEMA = f"token string, rank int, score double, lexical_steps int, skipped_chars int, split string, interpretation string, steps {STEPS}"


@dataclass(frozen=True)
class Entry:
    token: str
    normalized: str
    lemma: str = ""
    pos: str = ""
    gloss: str = ""


def span_options(tokens: list[str], lexicon: list[Entry], bounds: Bounds, least: float) -> list[list[list[tuple[int, float, Entry]]]]:
    """By token and start: (end, score, entry) of the PER_START weightiest spans of two characters and more.

    Each distinct span of all tokens is scored once, against the entries that can reach ``least``.
    """
    reach = max((len(e.normalized) for e in lexicon), default=0) + 2
    ends = lambda t, i: range(i + 2, min(len(t), i + reach) + 1)
    texts = list({t[i:j]: None for t in tokens for i in range(len(t)) for j in ends(t, i)})
    hits: dict[str, list[tuple[int, float]]] = {}
    for i, n, *_ in bounds.parts(texts, least):
        score = token_score(texts[i], lexicon[n].normalized, bounds.dependent)[0]
        if score >= least:
            hits.setdefault(texts[i], []).append((n, score))
    out = []
    for t in tokens:
        options = []
        for start in range(len(t)):
            found = [(end, score, lexicon[n]) for end in ends(t, start) for n, score in sorted(hits.get(t[start:end], ()))]
            found.sort(key=lambda x: (x[1] * (x[0] - start), -abs(len(x[2].token) - (x[0] - start)), x[1]), reverse=True)
            options.append(found[:PER_START])
        out.append(options)
    return out


def best_paths(token: str, options: list[list[tuple[int, float, Entry]]], k: int, skip: float, split: float) -> list[tuple[float, int, int, tuple]]:
    """(score, lexical steps, skipped characters, steps) of the ``k`` best paths with a lexical step.

    A table over suffixes, from the token's end: a path there is a first step before one of
    a later suffix. Of paths with the same steps the best stays; each suffix keeps its best
    max(6k, 20). A step is (kind, surface, normalized, score, entry); adjacent noise is one.
    """
    width = max(6 * k, 20)
    table: list[list] = [[] for _ in token] + [[(0.0, 0, 0, ())]]
    for i in reversed(range(len(token))):
        found: dict[tuple, tuple] = {}

        def offer(path: tuple, found=found) -> None:
            name = tuple((s[0], s[2]) for s in path[3])
            if name not in found or path[0] > found[name][0]:
                found[name] = path

        for score, n, skipped, steps in table[i + 1]:
            head, rest = ("noise", token[i], token[i], -skip, None), steps
            if steps and steps[0][0] == "noise":
                after = steps[0]
                head, rest = ("noise", token[i] + after[1], token[i] + after[2], after[3] - skip, None), steps[1:]
            offer((score - skip, n, skipped + 1, (head, *rest)))
        for end, value, entry in options[i]:
            gain = value * (end - i) - 0.25 * abs(len(entry.token) - (end - i)) - split
            head = ("lexical", token[i:end], entry.token, round(value, 4), entry)
            for score, n, skipped, steps in table[end]:
                offer((score + gain, n + 1, skipped, (head, *steps)))
        table[i] = sorted(found.values(), key=lambda p: (p[0], p[1], -p[2]), reverse=True)[:width]
    return [p for p in table[0] if p[1] > 0][:k]


def _row(token: str, rank: int, path: tuple) -> tuple:
    score, n, skipped, steps = path
    lexical = [s for s in steps if s[0] == "lexical"]
    told = [(kind, surface, normal, round(value, 4), *((e.lemma, e.pos, e.gloss) if e else ("", "", ""))) for kind, surface, normal, value, e in steps]
    fields = ("kind", "surface", "normalized", "score", "lemma", "pos", "gloss")
    return (token, rank, round(score, 4), n, skipped, " + ".join(s[2] for s in lexical), " + ".join(s[4].gloss for s in lexical if s[4].gloss), [dict(zip(fields, t, strict=True)) for t in told])


def segmentations(tokens: DataFrame, lexicon: list[Entry], script: Script = DEVANAGARI, k: int = 5, least: float = 0.72, skip: float = 0.55, split: float = 0.08, token: str = "token") -> DataFrame:
    """The ``k`` best segmentations of each distinct token, with rank from 1. ``lexicon`` is a small list, sent to all tasks."""
    shared = tokens.sparkSession.sparkContext.broadcast(lexicon)
    dependent = f"[{script.dependent}]+"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = Bounds([e.normalized for e in shared.value], re.compile(dependent))
        names = [c.split()[0] for c in SCHEMA.split(", ")][:7] + ["steps"]
        for part in parts:
            for at in range(0, len(part), STRETCH):
                some = part["token"][at : at + STRETCH].tolist()
                options = span_options(some, shared.value, bounds, least)
                rows = [_row(t, n, p) for t, o in zip(some, options, strict=True) if any(o) for n, p in enumerate(best_paths(t, o, k, skip, split), 1)]
                yield pd.DataFrame(rows, columns=names)

    seen = tokens.select(F.col(token).alias("token")).filter("token <> ''").distinct()
    return dealt(seen, "token").mapInPandas(run, SCHEMA)


def entries_of(lexicon: DataFrame, most: int = BROADCAST_ROWS) -> list[Entry]:
    """A lexicon table as a list, in order; an error if it has more than ``most`` entries, which tasks could not hold."""
    rows = lexicon.orderBy("position").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lexicon of over {most} entries can't be sent to all tasks")
    return [Entry(r.token, r.normalized, r.lemma or "", r.pos or "", r.gloss or "") for r in rows]


def probe_summary(probes: DataFrame, splits: DataFrame) -> DataFrame:
    """Of probed tokens (token, output): how many an analyser split or tagged, and how many a segmentation splits."""
    cut = splits.select("token").distinct().withColumn("cut", F.lit(1))
    return probes.join(cut, "token", "left").agg(
        F.count("*").alias("tokens"), F.count_if(has_split(F.col("output"))).alias("split"), F.count_if(has_morphology(F.col("output"))).alias("tagged"), F.count("cut").alias("segmented"),
    )
