"""Tokens against a lexicon: scored candidates, the best few, what is chosen."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.fuzzy import DETAILS, Bounds, best_entries, scored_token
from palimpsest.functions.text import DEVANAGARI, Script
from palimpsest.sources.shared import written

#: Largest lexicon, in rows, that is sent to every executor whole; a larger one is cut into blocks.
BROADCAST_ROWS = 200_000
#: Most frequent tokens whose results are sent to every executor, where not all can be.
FREQUENT_ROWS = 100_000
#: Parts of the texts that are held against each block of a larger lexicon.
SEEN_PARTS = 64
#: Texts whose pairs are bounded together.
STRETCH = 2000
TOKEN_THRESHOLD, SPAN_THRESHOLD, REPLACE_THRESHOLD = 0.58, 0.62, 0.78


def _attainable(a, b):
    """Upper bound of the gestalt ratio by lengths alone."""
    return 2 * F.least(a, b) / (a + b)


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle makes, or there are cores: few rows, much work on each.

    By a hash of ``by``: where rows come from a shuffle by the column itself, the planner would keep
    that one instead, and adaptive execution make few tasks of its few bytes.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.xxhash64(by))


def against(seen: DataFrame, known: DataFrame, condition: Column, rows: int) -> DataFrame:
    """``seen`` joined with a lexicon of ``rows`` rows by any condition.

    Up to BROADCAST_ROWS the lexicon is sent to all tasks; a larger one is cut into blocks of
    that size, against each of which all of ``seen`` is held.
    """
    if rows <= BROADCAST_ROWS:
        return seen.join(F.broadcast(known), condition)
    blocks = -(-rows // BROADCAST_ROWS)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # A block would be one task with all of ``seen``: that is dealt to parts, and every block to each of them.
    parts = known.withColumn("_block", F.pmod(F.xxhash64(*known.columns), F.lit(blocks))).withColumn("_part", upto(SEEN_PARTS))
    each = seen.withColumn("_part", F.pmod(F.xxhash64(*seen.columns), F.lit(SEEN_PARTS))).withColumn("_block", upto(blocks))
    return each.join(parts, (each["_block"] == parts["_block"]) & (each["_part"] == parts["_part"]) & condition).drop("_block", "_part")


def candidates(tokens: DataFrame, lexicon: DataFrame, script: Script = DEVANAGARI, least: float = TOKEN_THRESHOLD, most: int = 5, token: str = "token") -> DataFrame:
    """The ``most`` best entries of each distinct token that score at least ``least``.

    ``lexicon``: token, normalized, lemma, pos, gloss, position. Returns observed, the entry,
    score, details and rank from 1; equal scores keep the lexicon's order. Pairs are formed
    for distinct tokens only, those dropped that cannot reach the score by length, and the
    rest scored once: the score is filtered after a step that the optimiser won't repeat.
    """
    known = lexicon.select(F.col("token").alias("entry"), "normalized", "lemma", "pos", "gloss", F.col("position").alias("entry_position"), F.length("normalized").alias("entry_length"))
    n = F.length("observed")
    seen = tokens.select(F.col(token).alias("observed")).distinct().filter("observed <> ''")
    seen = dealt(seen, "observed")
    rows = lexicon.count()
    if most > 0 and rows <= BROADCAST_ROWS:
        return _ranked(seen, known.drop("entry_length").filter("normalized is not null"), script, least, most)
    # Longer texts are also compared by windows two characters longer than the entry.
    window = F.when(n > F.col("entry_length") + 2, F.col("entry_length") + 2).otherwise(n)
    # Skeletons are shorter than their texts and may agree fully: only the weight of the characters is bounded.
    bound = 0.6 * F.greatest(_attainable(n, F.col("entry_length")), _attainable(window, F.col("entry_length"))) + 0.38
    pairs = against(seen, known, bound >= least, rows)
    scored = pairs.withColumn("details", scored_token(script, least)("observed", "normalized")).withColumn("score", F.col("details.score")).filter(F.col("score") >= least)
    order = Window.partitionBy("observed").orderBy(F.desc("score"), "entry_position")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("entry_length")


def _ranked(seen: DataFrame, known: DataFrame, script: Script, least: float, most: int) -> DataFrame:
    """:func:`candidates` of a lexicon that every task can hold, all entries of a text at a time."""
    shared = seen.sparkSession.sparkContext.broadcast([tuple(r) for r in known.orderBy("entry_position").collect()])
    normalized, dependent = known.columns.index("normalized"), f"[{script.dependent}]+"
    schema = T.StructType([*seen.schema, *known.schema, T.StructField("details", DETAILS), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = [e[normalized] for e in shared.value]
        bounds = Bounds(entries, re.compile(dependent))
        for part in parts:
            texts = part["observed"].tolist()
            for at in range(0, len(texts), STRETCH):
                some = texts[at : at + STRETCH]
                rows = [(some[i], *shared.value[j], dict(zip(DETAILS.names, d, strict=True)), d[0], rank) for i, j, rank, d in best_entries(some, entries, bounds, least, most)]
                yield pd.DataFrame(rows, columns=schema.names)

    return seen.mapInPandas(run, schema)


def looked_up(tokens: DataFrame, found: DataFrame, counts: DataFrame | None = None, how: str = "left") -> DataFrame:
    """``tokens`` joined with what is known of each distinct token: ``found``, one row for each ``token``.

    With ``counts`` (token, count) up to BROADCAST_ROWS rows are sent to all tasks. Of more, those
    of the FREQUENT_ROWS most frequent tokens are, and only the rows of other tokens are shuffled:
    the frequent ones, which are most of a text, would come together in a few tasks.
    """
    if counts is None:
        return tokens.join(found, "token", how)
    found = written(found, "found")
    if found.count() <= BROADCAST_ROWS:
        return tokens.join(F.broadcast(found), "token", how)
    often = counts.orderBy(F.desc("count"), "token").limit(FREQUENT_ROWS).select("token")
    often = written(often.join(found.withColumn("_hit", F.lit(True)), "token", "left"), "frequent")
    held = (often.filter("_hit") if how == "inner" else often).drop("_hit")
    rest = tokens.join(F.broadcast(often.select("token")), "token", "left_anti")
    return tokens.join(F.broadcast(held), "token").unionByName(rest.join(found, "token", how))


def chosen(tokens: DataFrame, found: DataFrame, replace: float = REPLACE_THRESHOLD, token: str = "token", counts: DataFrame | None = None) -> DataFrame:
    """Adds the best entry (``best_entry``, ``best_score``), ``n_candidates`` and ``chosen_token``: the entry if its score is at least ``replace``.

    ``counts``: see :func:`looked_up`.
    """
    per = found.groupBy("observed").agg(F.count("*").alias("n_candidates"), F.max_by("entry", -F.col("rank")).alias("best_entry"), F.max("score").alias("best_score"))
    if counts is not None:
        rows = looked_up(tokens, per.withColumnRenamed("observed", "token"), counts)
    else:
        rows = tokens.join(per.withColumnRenamed("observed", "_o"), F.col(token) == F.col("_o"), "left").drop("_o")
    rows = rows.withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("long")))
    return rows.withColumn("chosen_token", F.when(F.col("best_score") >= replace, F.col("best_entry")).otherwise(F.col(token)))


def exact_hits(tokens: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    return tokens.join(lexicon.select(F.col("normalized").alias(token)).distinct(), token, "left_semi")


def nearest_by_edits(tokens: DataFrame, lexicon: DataFrame, most: int = 3, furthest: int = 2) -> DataFrame:
    """Entries within ``furthest`` edits of a token, the ``most`` nearest first. (Distinct tokens; lengths within reach.)"""
    seen = dealt(tokens.select(F.col("token").alias("observed")).distinct(), "observed")
    pairs = against(seen, lexicon.select(F.col("normalized").alias("entry")), F.abs(F.length("observed") - F.length("entry")) <= furthest, lexicon.count())
    near = pairs.withColumn("distance", F.levenshtein("observed", "entry", furthest)).filter(F.col("distance") >= 0)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("observed").orderBy("distance", "entry"))).filter(F.col("rank") <= most)
