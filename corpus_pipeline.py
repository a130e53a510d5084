"""Corpus preparation in five stages; each works on all that its predecessor kept.

Language identification and the quality classifier drop the documents they reject, of each
class of near-duplicates one document stays, secrets are replaced in the text, and the rest
is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import documents, word_bpe, written
from palimpsest.llm.langid import keep_identified
from palimpsest.llm.minhash import keep_one_of_each
from palimpsest.llm.packing import pack
from palimpsest.llm.quality import keep_good
from palimpsest.llm.secrets import redact_secrets


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_bpe(), end_id=1)


STAGES = [
    ("language identification", keep_identified),
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("secret scan", redact_secrets),
    ("packing", packed),
]

#: Fitted models and near-duplicate classes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
