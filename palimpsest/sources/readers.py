"""Readers: images, JSON documents, recognition results of either kind, lexicons, settings."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import DEVANAGARI, Script, normalize_token, token_skeleton
from palimpsest.operators.tokens import numbered
from palimpsest.sources.schemas import CHUNK_ENTRY, ENTRY, PAGE_SCAN, RECOGNITION

PREFERENCE = ("paddleocr", "easyocr", "tesseract")


def images(spark: SparkSession, path: str, glob: str = "page_*.png") -> DataFrame:
    """Image files: path, length, content and the page number in their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.withColumn("page", F.regexp_extract("path", r"(\d+)\.[A-Za-z]+$", 1).try_cast("int"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each file: its document, with the columns of ``schema`` (missing ones null), and ``path``."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_path").alias("path"))


def optional_documents(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Like :func:`json_documents`, of those of ``paths`` that exist."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    if not there:
        return spark.createDataFrame([], schema).withColumn("path", F.lit(None).cast("string"))
    return json_documents(spark, there, schema)


def page_scans(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, PAGE_SCAN)


def scan_entries(scans: DataFrame) -> DataFrame:
    """A row for each entry of a scan: path, position from 1, box, text, confidence, tile_index."""
    return scans.select("path", F.posexplode("entries").alias("_i", "e")).select("path", (F.col("_i") + 1).cast("long").alias("position"), "e.*")


def zipped_result(boxes: Column, texts: Column, scores: Column) -> Column:
    """Entries of three parallel arrays; what one has more than the shortest is left out. (arrays_zip pads.)"""
    n = F.least(F.size(boxes), F.size(texts), F.size(scores))
    rows = F.arrays_zip(F.slice(boxes, 1, n).alias("box"), F.slice(texts, 1, n).alias("text"), F.slice(scores, 1, n).alias("confidence"))
    return F.filter(rows, lambda r: F.trim(F.coalesce(r["text"], F.lit(""))) != "")


def nested_result(result: Column) -> Column:
    """Entries of a result of the nested form, as JSON: [box, [text, confidence]] items, or a page of them; others are left out."""
    item = "array<string>"
    items = F.from_json(result, f"array<{item}>")
    paged = result.rlike(r"^(?:\s*\[){5}")  # page, item, box, point
    rows = F.coalesce(F.when(paged, F.transform(F.get(items, F.lit(0)), lambda x: F.from_json(x, item))).otherwise(items), F.array().cast(f"array<{item}>"))
    payload = lambda r: F.from_json(F.get(r, F.lit(1)), item)
    good = F.filter(rows, lambda r: (F.size(r) >= 2) & (F.coalesce(F.size(payload(r)), F.lit(0)) >= 2))
    return F.transform(good, lambda r: F.struct(F.from_json(F.get(r, F.lit(0)), "array<array<double>>").alias("box"), F.get(payload(r), F.lit(0)).alias("text"), F.get(payload(r), F.lit(1)).cast("double").alias("confidence")))


def recognition(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, RECOGNITION)


def chosen_model(models: Column, preference: tuple[str, ...] = PREFERENCE) -> Column:
    """The result of the first preferred model that is available, else of the first available one; null if none is."""
    ready = F.filter(F.map_entries(models), lambda e: e["value"]["available"])
    rank = lambda e: F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(p) for p in preference)), e["key"]), F.lit(0)), F.lit(len(preference) + 1))
    ordered = F.array_sort(ready, lambda a, b: F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0))
    return F.get(ordered, F.lit(0))["value"]


def unavailable(spark: SparkSession, models: dict[str, str]) -> DataFrame:
    """Rows of models that can't run here, with the reason."""
    return spark.createDataFrame([(m, False, r) for m, r in models.items()], "model string, available boolean, reason string")


def recognized_entries(results: DataFrame) -> DataFrame:
    """Entries (:data:`~palimpsest.sources.schemas.CHUNK_ENTRY`) of recognition results of either kind; an error where there is no result.

    Entries of scans have no line; lines of a model keep their place (from 1) though blank ones
    are left out.
    """
    scanned = F.transform("entries", lambda e: F.struct(e["text"].alias("text"), F.lit(None).cast("int").alias("line_index"), F.lit(None).cast("string").alias("line_image"), F.lit(None).cast("array<string>").alias("segments"), e["box"].alias("box")))
    lines = F.transform(chosen_model(F.col("models"))["line_results"], lambda x, i: F.struct(x["text"].alias("text"), (i + 1).alias("line_index"), x["line_image"].alias("line_image"), x["segments"].alias("segments"), F.lit(None).cast("array<array<double>>").alias("box")))
    entries = F.coalesce(scanned, lines, F.raise_error(F.concat(F.lit("no recognition result in "), F.col("path"))).cast(f"array<{CHUNK_ENTRY}>"))
    return results.select("path", F.filter(entries, lambda e: F.trim(F.coalesce(e["text"], F.lit(""))) != "").alias("entries"))


def lexicon(spark: SparkSession, path: str, script: Script = DEVANAGARI, strict: bool = True, columns: int = 4, required: bool | None = None) -> DataFrame:
    """Entries of a tab-separated lexicon: token, lemma, pos, gloss, normalized, skeleton, position.

    Blank lines and those that start with ``#`` are left out, as are tokens without a character of
    the script. A line of another number of columns is an error, or left out if not ``strict``.
    ``position`` (from 1) follows the lines of the files. A lexicon without an entry is an error if
    ``required`` (by default, if ``strict``).
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("_line")).filter("line <> '' and not startswith(line, '#')")
    parts = F.split("line", "\t")
    if strict:
        parts = F.when(F.size(parts) == columns, parts).otherwise(F.raise_error(F.concat(F.lit("lexicon line without 4 columns: "), F.col("line"))).cast("array<string>"))
    rows = lines.withColumn("_p", parts).filter(F.size("_p") == columns)
    rows = rows.select("_line", *(F.trim(F.get("_p", F.lit(i))).alias(n) for i, n in enumerate(("token", "lemma", "pos", "gloss"))))
    rows = rows.withColumn("normalized", normalize_token(F.col("token"), script)).filter("normalized <> ''")
    if (strict if required is None else required) and rows.isEmpty():
        raise ValueError(f"no usable entry in the lexicon {path}")
    placed = numbered(rows, ["_line"])
    return placed.withColumn("skeleton", token_skeleton(F.col("normalized"), script)).drop("_line")


def word_lexicon(docs: DataFrame, most: int = 200, text: str = "text", least: int = 3) -> DataFrame:
    """A lexicon of the ``most`` frequent Latin words of ``docs``: count falling, then word."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{least},}})"), F.lit(1))).alias("token"))
    top = words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)
    placed = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "token")).cast("long"))
    return placed.select("token", F.col("token").alias("normalized"), F.col("token").alias("lemma"), F.lit("word").alias("pos"), F.lit("").alias("gloss"), F.regexp_replace("token", "[aeiou]+", "").alias("skeleton"), "position", "n")


def settings(lines: list[str], names: list[str]) -> dict[str, str | None]:
    """Values of ``names``: of the environment, else of ``NAME=value`` lines; quotes go."""
    found = {}
    for line in lines:
        name, mark, value = line.strip().partition("=")
        if mark and not name.startswith("#"):
            found[name.strip()] = value.strip().strip("'\"")
    return {n: os.environ.get(n, found.get(n)) for n in names}


__all__ = ["ENTRY", "chosen_model", "images", "json_documents", "lexicon", "optional_documents", "page_scans", "recognition", "recognized_entries", "scan_entries", "settings", "unavailable", "word_lexicon", "zipped_result"]
