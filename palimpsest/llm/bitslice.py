"""Exact top-k search by a bit-sliced index.

Components are quantised to whole numbers. A block of rows keeps, for each dimension, the
bits of its numbers (less the block's least one) as bitmaps over the rows: the slices. A
query's score is a sum of slices, each once for every signed digit of the query's
component; slices of equal significance are added by full adders, three bitmaps to two,
with nothing but bitmap operations. The result is itself bit-sliced: the top rows are
selected from its most significant slice downward, and where the last places are tied the
rows with the smallest ids are taken from the bitmap of ties, as ids ascend in a block.

Every block is held against all queries, in chunks: the search is exact for any data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import written
from palimpsest.llm.vectors import dimensions, matrix

#: Rows of a block: its bitmaps are 4 KB each.
BLOCK_ROWS = 32_768
QUERY_CHUNK = 1024
SCALE = 64.0


def _bitmap(ones: np.ndarray) -> np.ndarray:
    """Words of 64 bits, the least one first."""
    packed = np.zeros((len(ones) + 63) // 64 * 8, np.uint8)
    found = np.packbits(ones, bitorder="little")
    packed[: len(found)] = found
    return packed.view(np.uint64)


class Slices:
    """Bit slices of a block: ``bits[d][b]`` is the bitmap of bit b of dimension d, less ``low[d]``."""

    def __init__(self, rows: int, low: np.ndarray, bits: list[list[np.ndarray]]):
        self.rows, self.low, self.bits = rows, low, bits
        self.every = _bitmap(np.ones(rows, np.uint8))

    @classmethod
    def of(cls, values: np.ndarray) -> Slices:
        low = values.min(axis=0)
        shifted = (values - low).astype(np.uint64)
        widths = [int(x).bit_length() for x in shifted.max(axis=0)]
        return cls(len(values), low, [[_bitmap((shifted[:, d] >> np.uint64(b)).astype(np.uint8) & 1) for b in range(width)] for d, width in enumerate(widths)])

    def dumped(self) -> bytes:
        """Rows and dimensions, least numbers, widths, bitmaps."""
        widths = np.array([len(p) for p in self.bits], "<i8")
        return b"".join((np.array([self.rows, len(self.low)], "<i8").tobytes(), self.low.astype("<i8").tobytes(), widths.tobytes(), *(p.tobytes() for planes in self.bits for p in planes)))

    @classmethod
    def loaded(cls, data: bytes) -> Slices:
        rows, dims = np.frombuffer(data, "<i8", 2).tolist()
        low, widths = np.frombuffer(data, "<i8", 2 * dims, 16).reshape(2, dims)
        words = (rows + 63) // 64
        planes = iter(np.frombuffer(data, np.uint64, offset=16 + 16 * dims).reshape(-1, words))
        return cls(rows, low, [[next(planes) for _ in range(w)] for w in widths.tolist()])

    def score(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the inner product with ``query``, least significant first, and what to add to it.

        A negative digit adds the slice's complement and corrects the constant.
        """
        constant = int(query @ self.low)
        held: list[list[np.ndarray]] = []
        for q, planes in zip(query.tolist(), self.bits, strict=True):
            place = 0
            while q:  # digits -1, 0, 1, no two in a row but zero
                digit = 0
                if q & 1:
                    digit = 2 - (q & 3)
                    q -= digit
                if digit:
                    for b, plane in enumerate(planes):
                        while len(held) <= place + b:
                            held.append([])
                        held[place + b].append(plane if digit > 0 else self.flipped(plane))
                        constant -= (1 << (place + b)) * (digit < 0)
                q >>= 1
                place += 1
        out, place = [], 0
        while place < len(held):
            level = held[place]
            while len(level) > 1:
                if place + 1 == len(held):
                    held.append([])
                if len(level) == 2:
                    a, b = level
                    level[:] = [a ^ b]
                    held[place + 1].append(a & b)
                else:
                    a, b, c = level.pop(), level.pop(), level.pop()
                    x = a ^ b
                    held[place + 1].append((a & b) | (x & c))
                    x ^= c
                    level.insert(0, x)
            out.append(level[0] if level else np.zeros_like(self.every))
            place += 1
        return out, constant

    def flipped(self, plane: np.ndarray) -> np.ndarray:
        known = self.__dict__.setdefault("_flipped", {})
        found = known.get(id(plane))
        if found is None:
            found = known[id(plane)] = ~plane & self.every
        return found

    def members(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), count=self.rows, bitorder="little"))

    def top(self, query: np.ndarray, k: int, leave: range = range(0)) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the ``k`` best rows, best first, ties by smaller row; ``leave`` is left out."""
        slices, constant = self.score(query)
        sure, even = np.zeros_like(self.every), self.every.copy()
        for row in leave:
            even[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        got = 0
        for plane in reversed(slices):
            if got == k:
                break
            more = even & plane
            n = int(np.bitwise_count(more).sum())
            if got + n > k:
                even = more
            else:
                sure |= more
                got += n
                even &= ~plane
        rows = self.members(sure)
        if got < k:
            rows = np.concatenate([rows, self.members(even)[: k - got]])
        at, bit = rows >> 6, (rows & 63).astype(np.uint64)
        scores = np.full(len(rows), constant, np.int64)
        for place, plane in enumerate(slices):
            scores += ((plane[at] >> bit) & np.uint64(1)).astype(np.int64) << place
        order = np.lexsort((rows, -scores))
        return rows[order], scores[order]


def _quantised(size: int):
    # So large that a score's sum stays in 64 bits.
    most = math.isqrt((1 << 62) // max(size, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at, x = matrix(batch.column("embedding"), size, nonzero=False)
            values = np.floor(SCALE * x)
            if len(values) and np.abs(values).max() > most:
                raise ValueError(f"a component beyond {most / SCALE:g} in {size} dimensions: scores would not fit a long")
            values = values.astype("<i8")
            slot = (np.arange(n, n + len(at), dtype=np.int64) << 24) + task
            n += len(at)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(slot), pa.array([v.tobytes() for v in values], pa.binary())], names=["vec_id", "slot", "v"])

    return run


def search(rows: DataFrame, every: int, k: int) -> DataFrame:
    """For each row whose vec_id ``every`` divides: its ``k`` best other rows.

    Rows with a null vec_id, and vectors that are null or hold null or non-finite
    components, or not as many components as most, take no part. Rows with the query's
    vec_id are not its candidates; a vec_id that repeats is a candidate with each vector, and
    as a query it has one list, of the best over its vectors. Returns query_id, rank, vec_id,
    score; nothing for an empty table. Components so large that a score might not fit a
    long (2^31 / sqrt(dimensions) / 64 and more) are an error, not a wrong score.
    """
    size = dimensions(rows)
    values = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null").mapInArrow(_quantised(size), "vec_id long, slot long, v binary"), "quantised")
    total = values.count()
    blocks, chunks = max(1, -(-total // BLOCK_ROWS)), max(1, -(-total // (every * QUERY_CHUNK)))

    def sliced(part: pa.Table) -> pa.Table:
        ids = part.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        data = part.column("v").to_pylist()
        index = Slices.of(np.stack([np.frombuffer(data[i], "<i8") for i in order]))
        return pa.table({"block": part.column("block")[:1], "ids": pa.array([ids[order].astype("<i8").tobytes()]), "index": pa.array([index.dumped()])})

    def gathered(part: pa.Table) -> pa.Table:
        return pa.table({"chunk": part.column("chunk")[:1], "queries": pa.array([part.column("query_id").to_numpy().astype("<i8").tobytes()]), "q": pa.array([b"".join(part.column("q").to_pylist())])})

    # Each block is sliced once, each chunk of queries put together once; then every block meets every chunk.
    held = values.select(F.pmod(F.xxhash64("slot"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    index = written(held.groupBy("block").applyInArrow(sliced, "block int, ids binary, index binary"), "slices")
    asked = values.filter(F.col("vec_id") % every == 0).select(F.pmod(F.hash("slot"), F.lit(chunks)).cast("int").alias("chunk"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    queries = written(asked.groupBy("chunk").applyInArrow(gathered, "chunk int, queries binary, q binary"), "query-chunks")
    spread = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(part: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
        for row in part.to_pylist():
            ids, block = np.frombuffer(row["ids"], "<i8"), Slices.loaded(row["index"])
            own, q = np.frombuffer(row["queries"], "<i8"), np.frombuffer(row["q"], "<i8")
            for query, vector in zip(own.tolist(), q.reshape(len(own), -1), strict=True):
                leave = range(int(np.searchsorted(ids, query)), int(np.searchsorted(ids, query, side="right")))
                found, scores = block.top(vector, k, leave)
                out.append(np.stack([np.full(len(found), query), ids[found], scores]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), np.concatenate(out, axis=1), strict=True)))

    # One row, a block's slices and a chunk's queries, is a group. The planner takes ``spread`` for as small as the
    # queries' file, though it holds them once for every block: without the hint it is collected and broadcast.
    found = spread.join(index.hint("merge"), "block").groupBy("block", "chunk").applyInArrow(best, "query_id long, vec_id long, score long")
    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
