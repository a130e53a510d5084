"""Packing of tokenized documents into windows by non-negative least squares.

A document's full windows are sequences of their own; its tail (shorter than the window)
is packed. Every way in which up to three tail lengths fill a window exactly is a
combination; the repeat count of each is the non-negative least squares solution against
the histogram of all tails, rounded so that the running total stays whole and no length
is used more often than it occurs. What is left is packed greedily, longest first, end to
end and cut at window borders; the last, partial window is cut into powers of two, which
need no padding.

All that the driver holds is the histogram and the plan, whose sizes depend on the window
alone. A tail's place follows from its rank among the tails of its length: its rank within
its task plus the count in earlier tasks, so that no length gathers in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import documents, pieces, small_batches, word_bpe, written

WINDOW = 2048
ITERATIONS = 150
#: Rows of the rank table up to which it is broadcast (about 30 bytes each); beyond, a shuffled join.
BROADCAST_ROWS = 500_000


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths, longest first, that sum to ``window`` (0: unused); all of them present."""
    lengths = np.flatnonzero(present)
    lengths = lengths[(lengths > 0) & (lengths < window)]
    if not len(lengths):
        return np.zeros((0, 3), np.int64)
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    rows = []
    for a in lengths[lengths >= window // 3].tolist():
        b = lengths[(lengths <= a) & (2 * lengths >= window - a) & (lengths <= window - a)]
        c = window - a - b
        fits = (c == 0) | has[c]
        rows.append(np.stack([np.full(int(fits.sum()), a), b[fits], c[fits]], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """argmin |Ax - histogram| over x >= 0, by multiplicative updates (A: how often each length is used)."""
    if not len(combos):
        return np.zeros(0)
    size = len(histogram)
    target = histogram.astype(float)
    target[0] = 0
    used = lambda x: np.bincount(combos.ravel(), np.repeat(x, 3), size) * (np.arange(size) > 0)
    gathered = lambda y: y[combos].sum(axis=1)
    x = np.full(len(combos), target.sum() / combos.astype(bool).sum())
    toward = gathered(target)
    for _ in range(iterations):
        x *= toward / np.maximum(gathered(used(x)), 1e-12)
    return x


@dataclass
class Plan:
    window: int
    key: np.ndarray  # length << 40 | first rank, ascending: the slots of all combinations
    sequence: np.ndarray  # by slot: sequence of its first copy
    offset: np.ndarray  # by slot: place in the sequence
    planned: np.ndarray  # by length: tails in combinations
    rest_at: np.ndarray  # by length: where its other tails begin in the greedy stream
    rest_sequence: int  # first sequence of the greedy stream
    rest_full: int  # its full windows
    ends: np.ndarray  # ends of its last sequences, relative to the last full window
    full_sequence: int  # first sequence of the full windows of long documents


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """Where the tails go; ``histogram[n]`` counts tails of n tokens, index 0 is unused."""
    combos = combinations(window, histogram > 0)
    x = solve(combos, histogram)
    total = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
    copies = np.diff(total, prepend=0)
    stock = histogram.astype(np.int64).tolist()
    used = np.flatnonzero(copies)
    taken = np.zeros(len(used), np.int64)
    for j, row in enumerate(map(np.ndarray.tolist, combos[used])):
        n = min([int(copies[used[j]]), *(stock[v] // row.count(v) for v in set(row) if v)])
        if n > 0:
            for v in row:
                stock[v] -= n if v else 0
            taken[j] = n
    rows, taken = combos[used][taken > 0], taken[taken > 0]
    first = int(taken.sum())
    lengths, counts = rows.ravel(), np.repeat(taken, 3)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    before = np.cumsum(counts[order]) - counts[order]
    starts = np.searchsorted(lengths[order], np.arange(window + 1))
    base = np.append(before, counts[order].sum())[starts]
    planned = np.bincount(lengths[order], counts[order], window + 1).astype(np.int64)
    slots = np.column_stack([lengths[order] << 40 | before - base[lengths[order]], np.repeat(np.cumsum(taken) - taken, 3)[order], (np.cumsum(rows, axis=1) - rows).ravel()[order]])
    left = np.array(stock, np.int64)
    left[0] = 0
    mass = left * np.arange(window + 1)
    rest_at = mass[::-1].cumsum()[::-1] - mass
    full, rest = divmod(int(mass.sum()), window)
    ends = np.cumsum([1 << k for k in range(window.bit_length() - 1, -1, -1) if rest >> k & 1]).astype(np.int64)
    return Plan(window, slots[:, 0], slots[:, 1], slots[:, 2], planned, rest_at, first, full, ends, first + full + len(ends))


def place(p: Plan, length: int, rank: int) -> list[tuple[int, int, int]]:
    """Parts of a tail: (tokens, sequence, offset)."""
    if rank < p.planned[length]:
        i = int(np.searchsorted(p.key, length << 40 | rank, side="right")) - 1
        return [(length, int(p.sequence[i]) + rank - (int(p.key[i]) & (1 << 40) - 1), int(p.offset[i]))]
    at = int(p.rest_at[length]) + (rank - int(p.planned[length])) * length
    out = []
    while length:
        row, offset = divmod(at, p.window)
        end = p.window
        if row >= p.rest_full:
            inside = at - p.rest_full * p.window
            i = int(np.searchsorted(p.ends, inside, side="right"))
            start = int(p.ends[i - 1]) if i else 0
            row, offset, end = p.rest_full + i, inside - start, int(p.ends[i]) - start
        n = min(length, end - offset)
        out.append((n, p.rest_sequence + row, offset))
        at, length = at + n, length - n
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty: their only id is ``end_id``. Rows with equal or null ids are
    documents of their own. No documents give no pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = pieces(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], held.dtype).tobytes()
        seen, full = np.zeros(window, np.int64), 0
        for batch in batches:
            ids = [x + end for x in held.encode_many(batch.column("text"))]
            n = np.array([len(x) for x in ids], np.int64) // held.dtype.itemsize
            rank, before = [], []
            for tokens in n.tolist():
                rank.append(int(seen[tokens % window])), before.append(full)
                seen[tokens % window] += 1
                full += tokens // window
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "task": pa.array([task] * len(ids), pa.int32()), "doc_tokens": n, "tail": n % window, "rank": pa.array(rank, pa.int64()), "windows": pa.array(before, pa.int64()), "ids": pa.array(ids, pa.binary())})

    table = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, task int, doc_tokens long, tail long, rank long, windows long, ids binary"), "packing")
    by_task = written(table.groupBy("task", "tail").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / window)).alias("windows")), "packing-ranks")
    # Full windows are counted as tails of -1 tokens.
    counts = by_task.select("task", "tail", "n").unionByName(by_task.groupBy("task").agg(F.sum("windows").alias("n")).select("task", F.lit(-1).cast("long").alias("tail"), "n"))
    earlier = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("tail").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = earlier.filter("tail >= 0").select("task", "tail", "base").join(earlier.filter("tail < 0").select("task", F.col("base").alias("windows_base")), "task")
    histogram = np.zeros(window + 1, np.int64)
    for tail, n in by_task.groupBy("tail").agg(F.sum("n")).collect():  # at most ``window`` rows
        histogram[tail] += n
    histogram[0] = 0
    shared = spark.sparkContext.broadcast(plan(histogram, window))
    itemsize = pieces(vocabulary).dtype.itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc, n, tail, rank, windows, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "tail", "rank", "windows")), batch.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_buffer(), f"<u{itemsize}").astype("<u4")
                parts = [(window, p.full_sequence + windows + k, 0) for k in range(n // window)] + (place(p, tail, rank) if tail else [])
                start = 0
                for length, sequence, offset in parts:
                    out.append((doc, start, length, zlib.crc32(ids[start : start + length]), n, sequence, offset))
                    start += length
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(names), names=names)

    base = F.broadcast(base) if by_task.count() <= BROADCAST_ROWS else base
    return (table.join(base, ["task", "tail"])
            .select("doc_id", "doc_tokens", "tail", (F.col("rank") + F.col("base")).alias("rank"), (F.col("windows") + F.col("windows_base")).alias("windows"), "ids")
            .mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))


def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), word_bpe(), end_id=1)
