"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Words are runs of letters, digits and underscores in lower case (any character beyond
ASCII counts as a letter); a shingle is five of them in a row, or all of a shorter text.
A shingle's weight is (1 + ln tf) times its inverse document frequency, 1 + ln(1 / share)
/ ln(1 / FLOOR) for the share of documents that hold it; every shingle is counted exactly.
Those in FLOOR of all documents are few, and known to all tasks: every task puts forward,
by lossy counting, what may be in half of FLOOR of its documents; what can't reach FLOOR of
all documents with that is dropped before anything is collected, and the rest is counted
over all documents. The others are counted by a shuffle: documents are put in chunks, a
chunk sends each of its distinct shingles once, with its count, to the part of the range of
hashes that it lies in, and gets the number of all documents that hold it back.

1. Documents with the same words form one node. Its signature has BANDS x ROWS samples;
   nodes with a band in common are candidates.
2. Each bucket's most connected node is held against all others of the bucket by weighted
   Jaccard similarity: links of at least THRESHOLD make components.
3. Buckets that still hold several components make groups, by the nodes they share. In a
   group the similarity of all pairs of nodes is worked out, in pairs of blocks, by exact
   matrix products. A task passes on no more links than it takes to join its nodes.
Classes are the components of all links of at least THRESHOLD between candidates: a link
inside a component changes no class, and is neither looked for nor counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import documents, give_back, light_batches, written
from palimpsest.llm.components import components

WORDS = 5
THRESHOLD = 0.8
FLOOR = 0.01
#: Documents between two rounds of forgetting: four for each that the floor asks for.
WINDOW = round(4 / FLOOR)
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Weights are whole multiples of 1 / STEP.
STEP = 32
#: Draws of r and beta, and of c, come from tables of these sizes, by different bits of a shingle's hash.
CELL_BITS, LEVEL_BITS = 14, 16
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Nodes and bytes that a block of step 3 aims at; columns of a matrix that are multiplied at once.
BLOCK, BLOCK_BYTES, STRIP = 1024, 8 << 20, 4096
#: Bytes of text of a chunk at most, unless one document has more; shingles that a part of the counting aims at.
CHUNK_BYTES, PART = 4 << 20, 1 << 21
#: Bits of the filter that keeps texts without any candidate out of the verification.
MOST_FILTER_BITS = 1 << 24

U = np.uint64
_WORD = np.array([c >= 0x80 or chr(c).isalnum() or c == 0x5F for c in range(256)])
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_MIXERS = np.random.default_rng(17).integers(0, 1 << 63, SAMPLES + WORDS + ROWS, dtype=np.uint64) * U(2) + U(1)
_powers = [np.ones(1, U), np.ones(1, U)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def words(text: str) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes. Long texts are cut between words."""
    data = np.frombuffer(text.lower().encode(errors="replace"), np.uint8)
    parts, a = [np.zeros(0, U)], 0
    while a < len(data):
        b = min(a + PIECE, len(data))
        if b < len(data):
            gaps = np.flatnonzero(~_WORD[data[a:b]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                after = np.flatnonzero(~_WORD[data[b:]])
                b = b + int(after[0]) if len(after) else len(data)
        parts.append(_words(data[a:b]))
        a = b
    return np.concatenate(parts)


def _words(data: np.ndarray) -> np.ndarray:
    power, inverse = _power(len(data) + 1)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=total[1:])
    return _mix((total[ends] - total[starts]) * inverse[starts])


def shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and how often each occurs."""
    n = min(WORDS, len(hashes))
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.full(len(hashes) - n + 1, U(n))
    for j in range(n):
        total += hashes[j : len(hashes) - n + 1 + j] * _MIXERS[SAMPLES + j]
    return np.unique(_mix(total), return_counts=True)


def weights(found: np.ndarray, tf: np.ndarray, frequent: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """In whole steps. ``frequent``: counted shingles, ascending, with their ``idf``; all others, if there are any, have 2."""
    w = np.full(len(found), 2.0)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        w = np.where(frequent[at] == found, idf[at], w)
    if len(tf) and tf.max() > 1:
        w = w * (1 + np.log(tf))
    return np.maximum(np.rint(w * STEP), 1).astype(np.uint16)


class Sampler:
    """Improved consistent weighted sampling.

    A draw combines r and beta of one table with ln c of another, chosen by different bits:
    2^30 different draws, so that unlike sets of a million shingles still share none but by chance.
    """

    def __init__(self, usual: int = 2 * STEP) -> None:
        draw = np.random.default_rng(29)
        n = 1 << CELL_BITS
        self.r, self.beta = draw.gamma(2, 1, n), draw.random(n)
        self.lnc = np.log(draw.gamma(2, 1, 1 << LEVEL_BITS)).astype(np.float32)
        self.usual = usual  # the weight of most shingles, in steps
        self.table = self.step(slice(None), np.full(n, self.usual))

    def step(self, cell, steps: np.ndarray) -> np.ndarray:
        """What ln a is more than ln c. Equal values: the same quantised weight."""
        r, beta = self.r[cell], self.beta[cell]
        t = np.floor((np.log(steps / STEP)[..., None] if r.ndim > 1 else np.log(steps / STEP)) / r + beta)
        return (-r * (t - beta + 1)).astype(np.float32)

    def __call__(self, found: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """SAMPLES sample names of a weighted set, as 32 bits: ln a of the least draw."""
        least = np.full(SAMPLES, np.inf, np.float32)
        for a in range(0, len(found), 2048):
            x = found[a : a + 2048, None] * _MIXERS[:SAMPLES]
            cell = x >> U(64 - CELL_BITS)
            values = self.table[cell]
            other = steps[a : a + 2048] != self.usual
            if other.any():
                values[other] = self.step(cell[other], steps[a : a + 2048][other].astype(float))
            values += self.lnc[(x >> U(64 - CELL_BITS - LEVEL_BITS)) & U((1 << LEVEL_BITS) - 1)]
            np.minimum(least, values.min(axis=0), out=least)
        return least.view(np.uint32)


@lru_cache(maxsize=2)
def _sampler(usual: int) -> Sampler:
    return Sampler(usual)


def bands(names: np.ndarray) -> np.ndarray:
    rows = names.reshape(BANDS, ROWS).astype(U) * _MIXERS[-ROWS:]
    return _mix(rows.sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U) * _BASE).view(np.int64)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two payloads."""
    (x, v), (y, w) = _unpacked(a), _unpacked(b)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    common = np.minimum(v[both], w[at[both]]).sum(dtype=np.int64)
    return float(common / (v.sum(dtype=np.int64) + w.sum(dtype=np.int64) - common))


def _payload(found: np.ndarray, steps: np.ndarray) -> bytes:
    """Upper 32 bits of each shingle's hash, ascending, and its weight; equal ones count as the first."""
    names = (found >> U(32)).astype("<u4")
    first = np.concatenate(([True], names[1:] != names[:-1])) if len(names) else np.zeros(0, bool)
    return names[first].tobytes() + steps[first].astype("<u2").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n), np.frombuffer(data, "<u2", n, 4 * n)


def _key(hashes: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for text in batch.column("text"):
        yield words(text.as_py() or "")


class _Seen(set):
    """Whether a key came before in this task; forgets all now and then (repeats are dropped later)."""

    def new(self, key: bytes) -> bool:
        if key in self:
            return False
        if len(self) >= 200_000:
            self.clear()
        self.add(key)
        return True


def _mark():
    """Of a row: what only rows of equal doc_id and text share (null texts are empty)."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))))


NODES = "doc_id long, mark binary, key binary, shingle long, n long, docs long"


def _nodes(docs: DataFrame) -> DataFrame:
    """A row (doc_id, mark, key) for each document, and rows (shingle, n, docs) that tasks put forward as frequent.

    ``n`` bounds the documents of the task that hold the shingle from above, ``docs`` counts its documents.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lossy counting: what can't have reached a quarter of the floor is forgotten every WINDOW documents.
        names, counts, missed = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, n, windows = [], 0, 0

        def close(full: bool) -> None:
            nonlocal names, counts, missed, windows
            fresh, more = np.unique(np.concatenate(held or [np.zeros(0, U)]), return_counts=True)
            at = np.minimum(np.searchsorted(names, fresh), max(len(names) - 1, 0))
            old = names[at] == fresh if len(names) else np.zeros(len(fresh), bool)
            counts[at[old]] += more[old]
            names, counts = np.concatenate([names, fresh[~old]]), np.concatenate([counts, more[~old]])
            missed = np.concatenate([missed, np.full(int((~old).sum()), windows)])
            windows += full
            order = np.argsort(names)
            if full:
                order = order[counts[order] + missed[order] > windows]
            names, counts, missed = names[order], counts[order], missed[order]
            held.clear()

        def out(ids, marks, keys, shingle, counts) -> pa.RecordBatch:
            m, k = len(ids), len(shingle)
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([ids, pa.nulls(k, pa.int64())]), pa.concat_arrays([marks, pa.nulls(k, pa.binary())]), pa.array(keys + [None] * k, pa.binary()),
                pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(shingle, pa.int64())]), pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(counts, pa.int64())]),
                pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(np.full(k, n), pa.int64())]),
            ], names=["doc_id", "mark", "key", "shingle", "n", "docs"])

        for batch in batches:
            keys = []
            for hashes in _texts(batch):
                found, _ = shingles(hashes)
                keys.append(_key(hashes) if len(hashes) else None)
                held.append(found)
                n += 1
                if n % WINDOW == 0:
                    close(full=True)
            yield out(batch.column("doc_id"), batch.column("mark"), keys, [], [])
        close(full=False)
        often = counts + missed >= FLOOR / 2 * n
        yield out(pa.nulls(0, pa.int64()), pa.nulls(0, pa.binary()), [], names[often].view(np.int64), (counts + missed)[often])
        give_back()

    return written(docs.mapInArrow(scan, NODES), "nodes")


def _frequent(docs: DataFrame, table: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least FLOOR of all documents, ascending, and their idf."""
    # Tasks that don't put a shingle forward have it in less than half of FLOOR of their documents. What is left
    # is in at least a quarter of FLOOR of all documents, so there are 4 / FLOOR x (shingles of a mean document) at most.
    bound = F.sum("n") + FLOOR / 2 * (F.lit(total) - F.sum("docs"))
    put_forward = table.filter("shingle is not null").groupBy("shingle").agg(bound.alias("most")).filter(F.col("most") >= FLOOR * total).select("shingle")
    asked = np.sort(np.array([r[0] for r in put_forward.collect()], np.int64).view(U))
    if not len(asked):
        return np.zeros(0, U), np.zeros(0)
    names = docs.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value
        n = np.zeros(len(known), np.int64)
        for batch in batches:
            for hashes in _texts(batch):
                found, _ = shingles(hashes)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                n[at[known[at] == found]] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["at", "n"])
        give_back()

    counts = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") >= FLOOR * total).collect()
    counts.sort()
    return asked[[r["at"] for r in counts]], _idf(np.array([r.n for r in counts]), total)


def _idf(docs: np.ndarray, total: int) -> np.ndarray:
    return 1 + np.log(total / docs) / math.log(1 / FLOOR)


def _chunks(docs: DataFrame) -> DataFrame:
    """All texts, compressed, in rows (chunk, size, texts), fixed: what is worked out of a chunk twice is the same."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, schema = TaskContext.get().partitionId(), 0, pa.schema([("text", pa.string())])
        for batch in batches:
            texts = batch.column("text").cast(pa.string()).fill_null("")
            ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
            cuts = np.flatnonzero(np.diff(ends // CHUNK_BYTES)) + 1
            for i, j in pairwise([0, *cuts.tolist(), len(texts)]):
                if i < j:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(pa.RecordBatch.from_arrays([texts[i:j]], schema=schema))
                    row = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                    size = int(ends[j - 1] - (ends[i - 1] if i else 0))
                    yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), pa.array([size]), row], names=["chunk", "size", "texts"])
                    n += 1
        give_back()

    return written(docs.select("text").mapInArrow(gather, "chunk long, size long, texts binary"), "chunks")


def _unpacked_texts(data: bytes) -> Iterator[np.ndarray]:
    """Word hashes of each text of a chunk."""
    for batch in pa.ipc.open_stream(data):
        yield from _texts(batch)


def _dumped(names: np.ndarray) -> bytes:
    """Steps between ascending numbers, byte by byte: the upper bytes are zeros, which the shuffle compresses."""
    return np.diff(names, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _loaded(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=U)


def _uncounted(sets: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``sets`` but the ``known`` ones, ascending, and the number of sets that hold each."""
    names, n = np.unique(np.concatenate([np.zeros(0, U), *sets]), return_counts=True)
    if len(known):
        new = known[np.minimum(np.searchsorted(known, names), len(known) - 1)] != names
        names, n = names[new], n[new]
    return names, n


def _sums(names: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each of ``names`` the sum of ``n`` over all that are equal to it."""
    order = np.argsort(names, kind="stable")
    names, n = names[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    out = np.empty(len(names), np.int64)
    out[order] = np.repeat(np.add.reduceat(n, starts, dtype=np.int64), np.diff(starts, append=len(names)))
    return out


def _counted(chunks: DataFrame, frequent) -> DataFrame:
    """(chunk, part, docs): how many documents hold each of the chunk's distinct shingles but the frequent ones, ascending.

    A shingle that very many documents hold is one number of each chunk: no part is much larger than others.
    """
    size = chunks.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-size // (6 * PART)))  # a word and a space are six bytes, or so

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts"), strict=True):
                names, n = _uncounted([shingles(hashes)[0] for hashes in _unpacked_texts(texts.as_py())], frequent.value[0])
                part = ((names >> U(32)) * U(parts)) >> U(32)
                edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(names)])) if len(names) else np.zeros(1, np.int64)
                spans = list(pairwise(edges.tolist()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(part[i]) for i, _ in spans], pa.int32()), pa.array([chunk] * len(spans), pa.int64()),
                    pa.array([_dumped(names[i:j]) for i, j in spans], pa.binary()), pa.array([n[i:j].astype("<u4").tobytes() for i, j in spans], pa.binary()),
                ], names=["part", "chunk", "names", "n"])
        give_back()

    def count(part: pa.Table) -> pa.Table:
        n = [np.frombuffer(x.as_buffer(), "<u4") for x in part.column("n")]
        docs = _sums(np.concatenate([_loaded(x.as_buffer()) for x in part.column("names")]), np.concatenate(n)).astype("<u4")
        docs = np.split(docs, np.cumsum([len(x) for x in n])[:-1])
        return pa.table({"chunk": part.column("chunk"), "part": part.column("part"), "docs": pa.array([x.tobytes() for x in docs], pa.binary())})

    sent = chunks.select("chunk", "texts").mapInArrow(send, "part int, chunk long, names binary, n binary")
    return sent.groupBy("part").applyInArrow(count, "chunk long, part int, docs binary")


def _signatures(docs: DataFrame, frequent, total: int) -> DataFrame:
    """(key, bands, steps) of each node; ``steps`` are the weights of its shingles in their order."""
    chunks = _chunks(docs)
    counted = _counted(chunks, frequent)
    usual = int(weights(np.zeros(1, U), np.ones(1), np.zeros(1, U), _idf(np.ones(1), max(total, 1)))[0])

    def sign(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        sampler, (often, idf) = _sampler(usual), frequent.value
        nodes: dict[bytes, tuple] = {}
        sets = []
        for hashes in _unpacked_texts(chunk.column("texts")[0].as_py()) if len(chunk) else ():
            found, tf = shingles(hashes)
            sets.append(found)
            if len(hashes):
                nodes.setdefault(_key(hashes), (found, tf))
        names, _ = _uncounted(sets, often)
        counts = counts.sort_by("part").column("docs").to_pylist()  # parts ascend as their shingles do
        idf = np.concatenate([idf, _idf(np.frombuffer(b"".join(counts), "<u4"), total)])
        names = np.concatenate([often, names])
        order = np.argsort(names, kind="stable")
        names, idf = names[order], idf[order]
        steps = [weights(found, tf, names, idf) for found, tf in nodes.values()]
        buckets = [bands(sampler(found, w)) for (found, _), w in zip(nodes.values(), steps, strict=True)]
        flat = pa.array(np.concatenate(buckets) if buckets else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(nodes) + 1, BANDS), pa.int32()), flat)
        return pa.table({"key": pa.array(list(nodes), pa.binary()), "bands": lists, "steps": pa.array([w.astype("<u2").tobytes() for w in steps], pa.binary())})

    signed = chunks.select("chunk", "texts").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(sign, "key binary, bands array<long>, steps binary")
    return written(signed.dropDuplicates(["key"]), "signatures")


def _filter_size(n: int) -> int:
    return min(MOST_FILTER_BITS, max(1 << 12, 1 << math.ceil(math.log2(16 * n + 1))))


def _filter_words(rows: DataFrame, places: list) -> np.ndarray:
    """A Bloom filter of bounded size: the bits at ``places`` of each row, by a grouped bit-or."""
    bits = rows.select(F.explode(F.array(*places)).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit")).collect()  # at most MOST_FILTER_BITS / 64 rows
    out = np.zeros((max((r[0] for r in found), default=0) + 1), np.int64)
    for word, value in found:
        out[word] = value
    return out.view(U)


def _key_filter(keys: DataFrame) -> tuple[np.ndarray, int]:
    """Bloom filter of binary ``key``: the numbers in its first and next four bytes."""
    size = _filter_size(keys.count())
    return _filter_words(keys, [F.conv(F.hex(F.substring("key", a, 4)), 16, 10).cast("long") % size for a in (1, 5)]), size


def _payloads(docs: DataFrame, keys: DataFrame, signatures: DataFrame) -> DataFrame:
    """(key, payload) of the nodes among ``keys``, whose weights are in ``signatures``."""
    shared = docs.sparkSession.sparkContext.broadcast(_key_filter(keys))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, size), seen = shared.value, _Seen()
        for batch in batches:
            held, names = [], []
            for hashes in _texts(batch):
                key = _key(hashes) if len(hashes) else b""
                spots = [int.from_bytes(key[a : a + 4], "big") % size for a in (0, 4)] if key else []
                if spots and all(s >> 6 < len(bits) and int(bits[s >> 6]) >> (s & 63) & 1 for s in spots) and seen.new(key):
                    held.append(key), names.append((shingles(hashes)[0] >> U(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(names, pa.binary())], names=["key", "names"])
        seen.clear()
        give_back()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("names").to_pylist(), batch.column("steps").to_pylist(), strict=True)
            payloads = [_payload(np.frombuffer(n, "<u4").astype(U) << U(32), np.frombuffer(w, "<u2")) for n, w in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(payloads, pa.binary())], names=["key", "payload"])
        give_back()

    found = docs.select("text").mapInArrow(find, "key binary, names binary").join(keys, "key", "left_semi").groupBy("key").agg(F.first("names").alias("names"))
    weighed = signatures.select("key", "steps").join(keys, "key", "left_semi").join(found, "key")
    return written(weighed.select("key", "names", "steps").mapInArrow(weigh, "key binary, payload binary"), "payloads")


def _verified(pairs: DataFrame, payloads: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b), those that are similar enough."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(x.as_py(), y.as_py()) >= THRESHOLD for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])
        give_back()

    x, y = (payloads.select(F.col("key").alias(k), F.col("payload").alias(p)) for k, p in (("a", "x"), ("b", "y")))
    return written(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(test, "a binary, b binary"), "links")


def _levels(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nodes and columns of a 0/1 matrix, and the weights of its columns, whose products are common weights.

    A shingle has a column for each of its weights, which holds a 1 for all nodes with as much.
    """
    parts = [_unpacked(p) for p in payloads]
    node = np.repeat(np.arange(len(parts)), [len(x) for x, _ in parts])
    name, weight = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))
    _, which, n = np.unique(name, return_inverse=True, return_counts=True)
    shared = n[which] > 1  # the others have nothing in common
    node, name, weight = node[shared], name[shared], weight[shared]
    level, which = np.unique(name << 16 | weight, return_inverse=True)
    first = np.concatenate(([True], level[1:] >> 16 != level[:-1] >> 16)) if len(level) else np.zeros(0, bool)
    gap = level & 0xFFFF
    gap[1:] -= np.where(first[1:], 0, gap[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(level)), 0))
    times = which - start[which] + 1
    end = np.cumsum(times)
    column = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - times - start[which], times)
    return np.repeat(node, times), column, gap, len(level)


def pairs_of(payloads: list[bytes], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """All pairs of a node of ``left`` and one of ``right`` whose weighted Jaccard similarity is at least THRESHOLD."""
    node, column, gap, width = _levels(payloads)
    weight = np.array([_unpacked(p)[1].sum(dtype=np.int64) for p in payloads])
    kind = np.float32 if weight.max(initial=0) < 1 << 24 else np.float64  # whole numbers: either is exact
    common = np.zeros((len(left), len(right)), kind)
    order = np.argsort(column, kind="stable")
    node, column = node[order], column[order]
    for a in range(0, width, STRIP):
        i, j = np.searchsorted(column, (a, a + STRIP))
        ones = np.zeros((len(payloads), min(STRIP, width - a)), kind)
        ones[node[i:j], column[i:j] - a] = 1
        common += (ones[left] * gap[a : a + STRIP].astype(kind)) @ ones[right].T
    for k, row in enumerate(common.astype(np.int64)):
        for m in np.flatnonzero(row / (weight[left[k]] + weight[right] - row) >= THRESHOLD).tolist():
            yield int(left[k]), int(right[m])


def _within(members: DataFrame) -> DataFrame:
    """Links (a, b) that join components among ``members`` (group, blocks, key, component, payload), in blocks."""
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        own, group = part["own"].to_numpy(), pd.factorize(part["component"])[0]
        keys, out = part["key"].tolist(), []
        if (group != group[0]).any():
            every, here = np.arange(len(part)), own == own[0]
            sides = (every, every) if here.all() else (every[here], every[~here])
            if part["i"].iat[0] == part["j"].iat[0] or not here.all():
                for k, m in pairs_of(part["payload"].tolist(), *sides):
                    if group[m] != group[k]:
                        group[group == group[m]] = group[k]
                        out.append((keys[k], keys[m]))
        return pd.DataFrame(out, columns=["a", "b"])

    return written(placed.groupBy("group", "i", "j").applyInPandas(join, "a binary, b binary"), "more-links")


def members_of_classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, mark (of doc_id and text), and of its class class_id, class_size, first (the mark of its first row).

    A class is named by its least doc_id. Its first row is the one with the least doc_id,
    null last, then the least mark. Rows without a word have null for class_size and first.
    """
    light_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _mark().alias("mark"))
    table = _nodes(docs)
    rows = table.filter("shingle is null").select("doc_id", "mark", "key")
    total = rows.count()
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, table, max(total, 1)))
    signatures = _signatures(docs, frequent, total)
    placed = signatures.select("key", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(placed.join(shared, "bucket"), "members", BANDS * total)
    placements = members.count()
    payloads = _payloads(docs, members.select("key").distinct(), signatures)

    degree = members.groupBy("key").agg(F.sum(F.col("n") - 1).alias("degree"))
    centre = members.join(degree, "key").groupBy("bucket").agg(F.max(F.struct("degree", "key")).alias("centre")).select("bucket", F.col("centre.key").alias("b"))
    pairs = written(members.join(centre, "bucket").filter("key <> b").select(F.col("key").alias("a"), "b").distinct(), "pairs", placements)
    links = _verified(pairs, payloads)
    named = components(links)

    component = F.coalesce("component", "key").alias("component")
    rest = members.filter("n > 2").join(named.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", component)
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("key").alias("b")).filter("x <> y").select("bucket", "b")
    nodes = written(rest.join(mixed, "bucket").select(F.col("key").alias("a"), "b", "component"), "mixed", placements)
    groups = components(nodes.select("a", "b")).select(F.col("node").alias("key"), F.col("component").alias("group"))
    whole = written(groups.join(nodes.select(F.col("a").alias("key"), "component").distinct(), "key").join(payloads, "key"), "groups")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("payload")) / BLOCK_BYTES)).cast("int")
    sizes = written(whole.groupBy("group").agg(blocks.alias("blocks")), "group-sizes", placements)
    found = _within(whole.join(sizes, "group"))
    if found.take(1):
        named = components(named.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))

    # Copies meet at their node by sums alone, nodes at their component; each join is with a written table, so that a hot key can be split.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark"))
    per_node = rows.filter("key is not null").groupBy("key").agg(first.alias("first"), F.count("*").alias("n"))
    per_node = written(per_node.join(named.withColumnRenamed("node", "key"), "key", "left").select("key", component, "first", "n"), "class-nodes", total)
    per_class = written(per_node.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("class_size")), "class-sizes", total)
    of_node = written(per_node.select("key", "component").join(per_class, "component").select("key", F.col("first.doc_id").alias("class_id"), "class_size", F.col("first.mark").alias("first")), "node-classes", total)
    alone = rows.filter("key is null").select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("class_size"), F.lit(None).cast("binary").alias("first"))
    return rows.join(of_node, "key").select("doc_id", "mark", "class_id", "class_size", "first").unionByName(alone)


def classes(docs: DataFrame) -> DataFrame:
    """Per document of ``docs`` (doc_id, text, any more): doc_id, class_id, class_size.

    A class is named by its least doc_id. Texts without a word (null, empty) are classes of
    their own, named by themselves. Rows with the same id are documents of their own, so two
    classes have one name where their least ids are equal. An empty table has no classes.
    Very long texts are hashed in pieces, and compared whole.
    """
    return members_of_classes(docs).select("doc_id", "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def op9_icws_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


def _maybe_in(marks: DataFrame):
    """Whether a row's mark may be among ``marks``: never false for one of them, by a Bloom filter of bounded size.

    Only rows that may be need a join, so most texts are not shuffled.
    """
    bits, size = _key_filter(marks.select(F.col("mark").alias("key")))

    def test(marks: pd.Series) -> pd.Series:
        held = np.zeros((size >> 6) + 1, U)
        held[: len(bits)] = bits
        spots = np.frombuffer(b"".join(m[:8] for m in marks), ">u4").reshape(-1, 2).astype(np.int64) % size
        return pd.Series(((held[spots >> 6] >> (spots & 63).astype(U)) & U(1)).astype(bool).all(axis=1), dtype=bool)

    # Else the planner also has Python test the other side of each join.
    return F.pandas_udf(test, "boolean").asNondeterministic()


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one row stays, the one with the least id; columns stay as they are.

    Decided by row: rows that share an id but not their text can be of different classes,
    and each class keeps a row. A null id comes after all others. Of rows that agree in id
    and text one stays, whatever their other columns hold. Rows without a word all stay.
    """
    found = written(members_of_classes(docs).filter("class_size > 1"), "classes")
    gone = written(found.filter("mark <> first").select("mark").distinct(), "gone")
    again = written(found.filter("mark = first").groupBy("mark").count().filter("count > 1").select("mark"), "again")
    mark, maybe = _mark(), _maybe_in(gone.unionByName(again))
    name = "mark"
    while name in map(str.lower, docs.columns):
        name += "_"
    rest = docs.filter(maybe(mark)).withColumn(name, mark).join(gone.withColumnRenamed("mark", name), name, "left_anti")
    again = again.withColumnRenamed("mark", name)
    once = rest.join(again, name, "left_semi").dropDuplicates([name])
    kept = docs.filter(~maybe(mark))
    for part in (rest.join(again, name, "left_anti"), once):
        kept = kept.unionByName(part.select(*docs.columns))
    return kept
