"""Lines into bounded chunks, greedily, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.geometry import union_bounds

TASKS = ("normalize", "tokenize", "match", "review")


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line of a document: the document's columns but its text, line_index from 1, line."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(F.split(text, "\n")).alias("_i", "line")).withColumn("line_index", F.col("_i") + 1).drop("_i")


def chunk_starts(costs: Column, max_lines: int, max_chars: int) -> Column:
    """Where each chunk starts (from 0) in an array of items, by a fold over their lengths.

    An item costs its length and one separator. A chunk closes before an item that is one too
    many, or would bring the cost over ``max_chars``; one item alone may be longer than that.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("lines"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, n: Column) -> Column:
        cost = n.cast("long") + 1
        opens = (s["lines"] == 0) | (s["lines"] >= max_lines) | (s["chars"] + cost > max_chars)
        return F.struct(
            (s["at"] + 1).alias("at"), F.when(opens, 1).otherwise(s["lines"] + 1).alias("lines"), F.when(opens, cost).otherwise(s["chars"] + cost).alias("chars"),
            F.when(opens, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"),
        )

    return F.aggregate(costs, zero, step, lambda s: s["starts"])


def chunked(items: Column, starts: Column) -> Column:
    """Items as an array of chunks that begin at ``starts``."""
    return F.transform(starts, lambda s, k: F.slice(items, s + 1, F.coalesce(F.get(starts, k + 1), F.size(items)) - s))


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lines: int = 12, max_chars: int = 800) -> DataFrame:
    """The chunks of each document: key, chunk_index from 1, lines (line_index, line), blank ones left out.

    The fold runs over a document's own array of lines: nothing is shuffled.
    """
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line_index"), x.alias("line")))
    held = docs.select(key, F.filter(numbered, lambda x: F.trim(x["line"]) != "").alias("_lines"))
    held = held.withColumn("_starts", chunk_starts(F.transform("_lines", lambda x: F.length(F.trim(x["line"]))), max_lines, max_chars))
    return held.select(key, F.posexplode(chunked(F.col("_lines"), F.col("_starts"))).alias("_i", "lines")).select(key, (F.col("_i") + 1).alias("chunk_index"), "lines")


def pack_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lines: int = 12, max_chars: int = 800) -> DataFrame:
    """Non-blank lines of each document with their chunk: key, chunk_index, line_index, line."""
    return packed(docs, key, text, max_lines, max_chars).select(key, "chunk_index", F.explode("lines").alias("x")).select(key, "chunk_index", "x.line_index", "x.line")


def chunk_summary(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of chunks (key, chunk_index, lines): line_count, char_count, text. Each is one row, so nothing is shuffled."""
    return chunks.select(
        key, "chunk_index", F.size("lines").cast("long").alias("line_count"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"])).alias("char_count"),
        F.array_join(F.transform("lines", lambda x: F.trim(x["line"])), "\n").alias("text"),
    )


def pack_entries(entries: Column, max_lines: int = 12, max_chars: int = 800) -> Column:
    """Chunks of an array of entries (text, line_index, line_image, segments, box), as one array."""
    filled = F.filter(entries, lambda e: F.trim(F.coalesce(e["text"], F.lit(""))) != "")
    starts = chunk_starts(F.transform(filled, lambda e: F.length(F.trim(e["text"]))), max_lines, max_chars)

    def chunk(own: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).alias("chunk_index"), F.size(own).alias("line_count"), F.aggregate(own, F.lit(0), lambda a, e: a + F.length(e["text"])).alias("char_count"),
            union_bounds(F.transform(own, lambda e: e["box"])).alias("bounds"), F.array_join(F.transform(own, lambda e: F.trim(e["text"])), "\n").alias("text"),
            own.alias("entries"), F.array(*(F.lit(t) for t in TASKS)).alias("phase2_tasks"),
        )

    return F.transform(chunked(filled, starts), chunk)
