"""Token-id files compressed by Re-Pair grammars, with random access.

A file set is a Parquet table of blocks (``shard, block, start, n_tokens, n_docs,
payload``). A block holds whole documents; its payload is self-contained:

    magic "RPG1", then u32: first nonterminal, rules, symbols, documents, symbol width
    rules' left and right sides, rules' expansion lengths (u32), symbols
    documents' ids (i64) and null marks (u8), documents' token counts (u32)

Re-Pair replaces frequent pairs of adjacent ids by nonterminals, again and again. Here
one round replaces every pair that is at least a thirty-second as frequent as the most
frequent one (a vectorised batch), the more frequent pair winning where two overlap. It
ends when no pair is frequent or a round shortens the block by less than ``LEAST_GAIN``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import documents, new_path, pieces, word_bpe

MAGIC = b"RPG1"
#: Tokens after which a block closes; whole documents only, so a longer one has its own block.
BLOCK_TOKENS = 1 << 19
#: A pair must save at least as many symbols as this to become a rule.
MIN_COUNT = 16
#: Pairs at least 1 / SPREAD as frequent as the most frequent one are replaced in one round.
SPREAD = 32
#: Share of the symbols that a round must save for another to follow.
LEAST_GAIN = 0.005
HASH_BITS = 18


def induce(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, int]:
    """Grammar of ``ids``: (symbols, rules as rows of left and right side, first nonterminal)."""
    current = ids.astype(np.uint32)
    first = int(current.max()) + 1 if len(current) else 0
    rules: list[np.ndarray] = []
    made, limit = 0, None
    while len(current) > 1:
        slot = current[:-1] * np.uint32(0x9E3779B1) + current[1:] * np.uint32(0x85EBCA6B)
        slot = (slot >> np.uint32(32 - HASH_BITS)).astype(np.int64)
        count = np.bincount(slot, minlength=1 << HASH_BITS)
        top = int(count.max())
        if top < min_count:
            break
        least = max(min_count, min(top, limit or top) // SPREAD)
        at = np.flatnonzero((count >= least)[slot])
        key = current[at].astype(np.uint64) << np.uint64(32) | current[at + 1]
        order = np.argsort(key)
        key, at = key[order], at[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        chosen = np.flatnonzero(sizes >= least)
        chosen = chosen[np.argsort(-sizes[chosen], kind="stable")]
        none = len(chosen)
        rank = np.full(len(sizes), none, np.int32)
        rank[chosen] = np.arange(none, dtype=np.int32)
        rank = np.repeat(rank, sizes)
        near = np.full(len(current) + 2, none, np.int32)  # near[i + 1]: rank of the pair at i
        near[at + 1] = rank
        twin = key[starts[chosen]]
        twin = np.append(twin >> np.uint64(32) == twin & np.uint64(0xFFFFFFFF), False)
        if twin.any():  # in a run of one id every other place has a pair of it
            run = np.sort(at[twin[rank]])
            begin = np.flatnonzero(np.concatenate(([True], np.diff(run) != 1)))
            odd = (run - np.repeat(run[begin], np.diff(np.append(begin, len(run))))) & 1
            near[run[odd > 0] + 1] = none
        at = at[rank < none]
        here = near[at + 1]
        won = (here < near[at]) & (here <= near[at + 2])  # no two of these overlap
        at, here = at[won], here[won]
        kept = np.flatnonzero(np.bincount(here, minlength=none) >= min_count // 2) if none else chosen
        if not len(kept):  # slots shared by several pairs
            if least == min_count:
                break
            limit = least
            continue
        limit = None
        new_id = np.zeros(none, np.uint32)
        new_id[kept] = first + made + np.arange(len(kept))
        at, here = at[new_id[here] > 0], here[new_id[here] > 0]
        pair = key[starts[chosen[kept]]]
        rules.append(np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        made += len(kept)
        stay = np.ones(len(current), bool)
        stay[at + 1] = False
        current[at] = new_id[here]
        before, current = len(current), current[stay]
        if before - len(current) < LEAST_GAIN * before:
            break
    return current, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), first


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Terminals that each rule stands for. Rules only refer to earlier ones."""
    lengths: list[int] = []
    for a, b in (rules.astype(np.int64) - first).tolist():
        lengths.append((lengths[a] if a >= 0 else 1) + (lengths[b] if b >= 0 else 1))
    return np.array(lengths, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """All terminals of ``symbols``: the rules are spelt out once, then copied to where they stand."""
    symbols = symbols.astype(np.uint32)
    deep = symbols >= first
    if not len(rules) or not deep.any():
        return symbols
    spelt: list[bytes] = []
    side = lambda x: spelt[x - first] if x >= first else x.to_bytes(4, "little")
    for a, b in rules.tolist():
        spelt.append(side(a) + side(b))
    lengths = np.array([len(x) >> 2 for x in spelt], np.int64)
    starts = np.cumsum(lengths) - lengths
    text = np.concatenate([np.frombuffer(b"".join(spelt), "<u4"), symbols[~deep]])
    rule = symbols[deep] - np.uint32(first)
    size, begin = np.ones(len(symbols), np.int64), np.empty(len(symbols), np.int64)
    size[deep], begin[deep] = lengths[rule], starts[rule]
    begin[~deep] = len(text) - int((~deep).sum()) + np.arange(int((~deep).sum()))
    ends = np.cumsum(size)
    return text[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))].astype(np.uint32)


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    symbols, rules, first = induce(ids)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    return b"".join((
        MAGIC, struct.pack("<5I", first, len(rules), len(symbols), len(doc_ids), width),
        rules[:, 0].astype(kind).tobytes(), rules[:, 1].astype(kind).tobytes(),
        expansion_lengths(rules, first).astype("<u4").tobytes(), symbols.astype(kind).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "<u1").tobytes(),
        np.array(lengths, "<u4").tobytes(),
    ))


class Block:
    """A payload, read for random access."""

    def __init__(self, payload: bytes):
        assert payload[:4] == MAGIC, "not a Re-Pair block"
        self.first, n_rules, n_symbols, n_docs, width = struct.unpack_from("<5I", payload, 4)
        place = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(payload, kind, n, place)
            place += out.nbytes
            return out

        left, right = take(f"<u{width}", n_rules), take(f"<u{width}", n_rules)
        self.rules = np.stack([left, right], axis=1).astype(np.uint32)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols).astype(np.uint32)
        ids, null = take("<i8", n_docs), take("<u1", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.doc_tokens = take("<u4", n_docs).astype(np.int64)
        self._ends: np.ndarray | None = None
        self.touched = 0

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.first)

    def tokens(self, start: int, length: int) -> np.ndarray:
        """Ids from ``start`` on: of the symbols that cover them only the rules that are needed are taken apart.

        ``touched`` counts these. A side of a rule that ends before the range, or begins after
        it, is passed over by its expansion length.
        """
        if self._ends is None:
            size = np.ones(len(self.symbols), np.int64)
            deep = self.symbols >= self.first
            size[deep] = self.lengths[self.symbols[deep] - np.uint32(self.first)]
            self._ends = np.cumsum(size)
        self.touched = 0
        if length <= 0 or not len(self._ends):
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self._ends, start, side="right"))
        b = int(np.searchsorted(self._ends, start + length - 1, side="right")) + 1
        at = int(self._ends[a - 1]) if a else 0
        out, end, first = [], start + length, self.first
        todo = self.symbols[a:b][::-1].tolist()
        while todo and at < end:
            symbol = todo.pop()
            n = int(self.lengths[symbol - first]) if symbol >= first else 1
            if at + n <= start:
                at += n
            elif symbol < first:
                out.append(symbol)
                at += 1
            else:
                self.touched += 1
                left, right = self.rules[symbol - first].tolist()
                todo += [right, left]
        return np.array(out, np.uint32)


BLOCKS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and write blocks to ``path``.

    Null texts are empty; null ids come first; equal ids are ordered by their text. Shards
    are ranges of doc_id: their numbers ascend with it.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, number, start = pieces(vocabulary), TaskContext.get().partitionId(), 0, 0
        ids, lengths, chunks, total = [], [], [], 0
        tail = b"" if end_id is None else np.array([end_id], held.dtype).tobytes()

        def close() -> pa.RecordBatch:
            payload = pack_block(ids, lengths, np.frombuffer(b"".join(chunks), held.dtype))
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": number, "start": start, "n_tokens": total, "n_docs": len(ids), "payload": payload}], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for doc, chunk in zip(batch.column("doc_id").to_pylist(), held.encode_many(batch.column("text")), strict=True):
                chunk += tail
                n = len(chunk) // held.dtype.itemsize
                ids.append(doc), lengths.append(n), chunks.append(chunk)
                total += n
                if total >= BLOCK_TOKENS:
                    yield close()
                    number, start = number + 1, start + total
                    ids, lengths, chunks, total = [], [], [], 0
        if ids:
            yield close()

    text = F.coalesce("text", F.lit(""))
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
         .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
         .mapInArrow(encode, BLOCKS).write.parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32, shard, block."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    ends = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).collect())
    base, offsets = 0, []
    for shard, n in ends:  # one entry for each file
        offsets.append((shard, base))
        base += n
    before = spark.createDataFrame(offsets, "shard int, before long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["payload"])
                ids = block.all().astype("<u4")
                ends = np.cumsum(block.doc_tokens)
                starts = ends - block.doc_tokens
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(block.doc_ids, pa.int64()), "start": pa.array(starts + row["start"] + row["before"], pa.int64()),
                    "n_tokens": pa.array(block.doc_tokens, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    "shard": pa.array([row["shard"]] * len(starts), pa.int32()), "block": pa.array([row["block"]] * len(starts), pa.int32()),
                })

    return blocks.join(F.broadcast(before), "shard").select("shard", "block", "start", "before", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, block int")


def op1_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "repair")
    write_tokens(documents(spark, sf_dir), path, word_bpe(), end_id=2)
    return read_tokens(spark, path)
