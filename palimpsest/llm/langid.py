"""Language identification by compression.

Each language has a Zstandard raw-content dictionary of its own training text; a text's
language is the one whose dictionary makes it smallest. Texts are lower-cased, reduced to
letters, and compressed whole, in independent chunks so that the dictionary counts to the
end of long texts. A text is rejected if it has no letter, or if no language is better
than the next by ``MARGIN`` of the size, at any length: of short texts that means ties.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bucket_of, documents

#: Fitting takes at most this many distinct texts of each language, those with the least hashes (about twice as many are collected), and of longer ones a part.
SAMPLE_TEXTS = 600
EXCERPT = 6000
DICTIONARY_BYTES = 131_072
LEVEL = 6
CHUNK = 8192
MARGIN = 0.004
#: Bits of code length count as this many bits of evidence in ``score``.
EVIDENCE = 0.25
NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return NO_LETTERS.sub(" ", text.lower()).strip().encode()


def fit(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of ``docs`` (text, lang), the most frequent first.

    Null texts and languages, and texts without a character, are left out. Repeated texts
    count once in the sample. A text of more than EXCERPT characters gives that many, from a
    place that its hash chooses. The driver gets a row for each language, and the sample.
    """
    known = docs.filter("text <> '' and lang is not null").select("lang", "text", F.xxhash64("text").alias("place"))
    counts = {r["lang"]: (r["n"], r["d"]) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("place").alias("d")).collect()}
    if not counts:
        return {}
    # Hashes up to which twice the sample is expected: an estimate of distinct texts can't miss by so much.
    limits = {lang: min((1 << 63) - 1, (1 << 65) * SAMPLE_TEXTS // d - (1 << 63)) for lang, (_, d) in counts.items()}
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    start = F.pmod("place", F.greatest(F.length("text") - EXCERPT + 1, F.lit(1))).cast("int")
    part = F.substring(F.col("text"), start + 1, F.lit(EXCERPT)).alias("text")
    rows = known.filter(F.col("place") <= limit[F.col("lang")]).select("lang", "place", part).groupBy("lang", "place").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.place, r.text))
    found: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda x: (-counts[x][0], x)):
        held, size = [], 0
        for text in [r.text for r in rows if r.lang == lang][:SAMPLE_TEXTS]:
            if size < DICTIONARY_BYTES:
                held.append(letters(text))
                size += len(held[-1]) + 1
        if size > len(held):
            found[lang] = b" ".join(held)[:DICTIONARY_BYTES]
    return found


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.compressors = {}
        for lang, data in dictionaries.items():
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.compressors[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language or ``und``, score, rejected). Null, letterless: ``und``, 0, rejected. Ties: the more frequent language."""
        data = letters(text) if text and any(map(str.isalpha, text)) else b""
        if not data or not self.compressors:
            return "und", 0.0, True
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        sizes = {lang: sum(len(c.compress(x)) for x in chunks) for lang, c in self.compressors.items()}
        best, *rest = sorted(sizes, key=sizes.get)
        score = 1 / sum(2.0 ** max(-1000.0, 8 * EVIDENCE * (sizes[best] - s)) for s in sizes.values())
        narrow = bool(rest) and sizes[rest[0]] - sizes[best] < MARGIN * sizes[rest[0]]
        return best, score, narrow


def identify(model: dict[str, bytes]):
    """The model as a function of a text column: struct of lang_pred, score, rejected."""

    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = Classifier(model)
        for texts in parts:
            yield pd.DataFrame([held(x) for x in texts], columns=["lang_pred", "score", "rejected"])

    return F.pandas_udf(of, "lang_pred string, score double, rejected boolean")


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(bucket_of(F.col("doc_id"), 3) != 1)


def op5_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    of = identify(fit(training(docs)))
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), of("text").alias("x")).select("doc_id", "held_out", "x.lang_pred", "x.score", "x.rejected")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go; columns stay as they are.

    Null texts and texts without a letter are rejected; without any training text all are.
    Rows that repeat are judged alike.
    """
    of = identify(fit(training(docs)))
    return docs.filter(~of("text")["rejected"])
