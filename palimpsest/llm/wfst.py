"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled from a piece model's file:

* the normaliser: the model's character map, a trie of byte strings and what each becomes
  (the longest that matches counts), its white-space rules, and the meta symbol for a space;
* an arc for each piece, from its text to its id: of weight minus its score, or 0 in models
  learnt by merging, whose scores only say which merge comes first;
* a byte fallback arc for each character without a piece, of a weight beyond all pieces (or
  0 in models learnt by merging).

Composed with a text these make a trellis over the characters of the normalised text. Its
tropical-semiring shortest path is the encoding: the weight of a place is the least sum of
the weight of an arc's start, the arc's own, and the weight of the step between two arcs.

A step weighs 0 in models of independent pieces (unigram). In models learnt by merging it
weighs 0 if merging the two pieces' text gives the two pieces back, and infinity otherwise:
merges inside two neighbours go as they would anywhere, until one crosses their border. For
each text exactly one path has a finite weight then, and so has each place: it is what
merging makes of the text up to there. That is why a place needs one entry, its last arc.

Where no piece holds a meta symbol after another character, words are separate inputs; so
are the two sides of any two neighbouring characters that no piece holds in a row.
"""

from __future__ import annotations

import math
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import documents

META = "▁"
#: Words, and pairs of pieces, whose results a worker holds.
HELD = 400_000
INFINITE = math.inf
# Fixed values of the model format.
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protocol buffer message's fields; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield number, data[at : at + n]
        at += n


class Normaliser:
    """The text that a model's pieces are matched with, by its ``normalizer_spec``."""

    def __init__(self, spec: bytes):
        held = dict(_fields(spec))
        self.prefix, self.squeeze, self.escape = (bool(held.get(n, 1)) for n in (3, 4, 5))
        chars = bytes(held.get(2, b""))
        size = int.from_bytes(chars[:4], "little") if chars else 0
        self.units, self.texts = array("I", chars[4 : 4 + size]), chars[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(what it becomes, end) of the longest entry of the character map at a place."""
        units, found = self.units, None
        node = units[0]
        place = (node >> 10) << ((node & 0x200) >> 6)
        while at < len(data):
            place ^= data[at]
            if place >= len(units):
                break
            node = units[place]
            if node & 0x800000FF != data[at]:
                break
            at += 1
            place ^= (node >> 10) << ((node & 0x200) >> 6)
            if node >> 8 & 1:
                start = units[place] & 0x7FFFFFFF
                found = self.texts[start : self.texts.index(0, start)], at
        return found

    def mapped(self, text: str) -> str:
        if not len(self.units):
            return text
        data, out, at = text.encode(errors="replace"), [], 0
        while at < len(data):
            found = self.longest(data, at)
            if found is None:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                found = data[at : at + n], at + n
            out.append(found[0])
            at = found[1]
        return b"".join(out).decode()

    def __call__(self, text: str) -> str:
        text = self.mapped(text)
        if self.squeeze:
            text = " ".join(w for w in text.split(" ") if w)
        if not text:
            return ""
        return (" " * self.prefix + text).replace(" ", META if self.escape else " ")


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        self.compile(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())

    @classmethod
    def of(cls, model: bytes) -> Transducer:
        """From a model's bytes."""
        held = cls.__new__(cls)
        held.compile(model)
        return held

    def compile(self, model: bytes) -> None:
        import ahocorasick

        pieces, trainer, normaliser = [], {}, b""
        for number, value in _fields(model):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, bytes(4)))[0], x.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = value
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, MERGES) or any(kind == USER for *_, kind in pieces) or trainer.get(24, 0):
            raise ValueError("only unigram and merging models without user-defined symbols or suffixed spaces")
        self.normalise = Normaliser(normaliser)
        self.merging = trainer.get(3, UNIGRAM) == MERGES
        self.pieces = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.written = {p: struct.pack("<I", i) for p, i in self.pieces.items()}
        self.score = {p: pieces[i][1] for p, i in self.pieces.items()}
        self.weight = {p: 0.0 if self.merging else -s for p, s in self.score.items()}
        #: Of a character without a piece: ten more than the worst piece.
        self.beyond = 0.0 if self.merging else max(self.weight.values(), default=0.0) + 10
        self.rank = {p: n for n, p in enumerate(sorted(self.pieces, key=lambda p: -self.score[p])) if len(p) > 1}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (*_, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.text = {i: p for p, i in self.pieces.items()}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.whole = any(META in p.lstrip(META) for p in self.pieces)
        self.words: dict[str, bytes] = {}
        self.steps: dict[tuple[str, str], bool] = {}
        #: The last merge of each piece that merging makes at all.
        self.halves: dict[str, tuple[str, str]] = {}
        self.arcs = ahocorasick.Automaton()
        for p in self.pieces:
            if len(p) == 1 or not self.merging or self.merged(p) == [p]:
                self.arcs.add_word(p, p)
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        self.within = frozenset(pair for p in self.pieces for pair in pairwise(p))
        self.arcs.make_automaton()

    def merged(self, text: str) -> list[str]:
        """Pieces that merging makes of a short text: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` gives these two pieces.

        Looks at the symbols on both sides of the border, back in time: the younger one is
        taken apart, as long as no merge across the border would have come before it.
        """
        rank, halves = self.rank, self.halves
        if a.strip(META) == "" or b.strip(META) == "":  # pieces of meta symbols share one score
            return self.merged(a + b) == [a, b]
        limit = 1 << 60
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            x, y = rank.get(a, -1), rank.get(b, -1)
            if x > y:
                limit, a = x, halves[a][1]
            elif y >= 0:
                limit, b = y + 1, halves[b][0]
            else:
                return True

    def step(self, a: str, b: str) -> bool:
        """Whether the step between two arcs has a finite weight."""
        good = self.steps.get((a, b))
        if good is None:
            if len(self.steps) >= HELD:
                self.steps.clear()
            good = self.steps[a, b] = not self.merging or self.fits(a, b)
        return good

    def composed(self, word: str) -> Iterable[tuple[int, str]]:
        """(last place, text) of all arcs of ``word``'s trellis, by place, the longer first."""
        arcs = self.arcs.iter(word)
        if self.single.issuperset(word):
            return arcs
        fallback = [(i, c) for i, c in enumerate(word) if c not in self.single]
        return sorted([*arcs, *fallback], key=lambda x: (x[0], -len(x[1])))

    def shortest(self, word: str) -> list[str]:
        """Texts of the arcs of the shortest path through ``word``'s trellis; of equal ones the one whose last arc is longer."""
        n = len(word)
        cost, last = [0.0] + [INFINITE] * n, [""] * (n + 1)
        weight, steps, beyond, merging = self.weight, self.steps, self.beyond, self.merging
        least = 0.0 if merging else -INFINITE  # of any path
        for end, arc in self.composed(word):
            end += 1
            if cost[end] <= least:
                continue
            start = end - len(arc)
            total = cost[start] + (0.0 if merging else weight.get(arc, beyond))
            if total < cost[end]:
                if start and merging:
                    good = steps.get((last[start], arc))
                    if not (self.step(last[start], arc) if good is None else good):
                        continue
                cost[end], last[end] = total, arc
        out, end = [], n
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def cost(self, path: list[str]) -> float:
        """Weight of a path by its arcs."""
        if not all(self.step(a, b) for a, b in pairwise(path)):
            return INFINITE
        return sum(self.weight.get(arc, self.beyond) for arc in path)

    def ids(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.fresh(word)
            if len(word) <= 64:
                if len(self.words) >= HELD:
                    self.words.clear()
                self.words[word] = found
        return found

    def fresh(self, word: str) -> bytes:
        if self.bytes and not word[1:].isalpha():  # without byte fallback neighbours without a piece share an id
            cuts = [i for i, pair in enumerate(pairwise(word), 1) if pair not in self.within]
            if cuts:
                return b"".join([self.ids(word[a:b]) for a, b in pairwise([0, *cuts, len(word)])])
        path = self.shortest(word)
        if self.single.issuperset(word):
            return b"".join([self.written[arc] for arc in path])
        out: list[int] = []
        for arc in path:
            i = self.pieces.get(arc)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in arc.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return array("I", out).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text. Null and empty texts have none."""
        return self.encode_normal(self.normalise(text or ""))

    def encode_normal(self, text: str) -> np.ndarray:
        """Ids of a normalised text."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.whole or text[0] != META:
            return np.frombuffer(self.ids(text), np.uint32)
        words = [META + w for w in text.split(META)[1:]]
        if META in words:  # meta symbols in a row belong to one input
            joined: list[str] = []
            for w in words:
                if joined and joined[-1].strip(META) == "":
                    joined[-1] += w
                else:
                    joined.append(w)
            words = joined
        return np.frombuffer(b"".join(map(self.ids, words)), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: bytes are joined, the meta symbol in front goes, others are spaces."""
        out, held = [], bytearray()
        if self.text.keys() >= set(np.unique(ids).tolist()):
            return "".join(map(self.text.__getitem__, np.asarray(ids).tolist())).removeprefix(META).replace(META, " ")
        for i in [*np.asarray(ids).tolist(), None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held = bytearray()
            if i is not None:
                out.append(self.text.get(i, " ⁇ "))
        return "".join(out).removeprefix(META).replace(META, " ")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any more): doc_id, ids (little-endian u32), and whether decoding gives the normalised text back.

    Null and empty texts have no ids; an empty table gives no rows; repeated rows are encoded
    each; texts of any length are encoded whole. Of paths of equal weight the one whose last
    arc is longer counts (in merging models no two paths have a finite weight).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = transducer(path)
        for batch in batches:
            ids, same = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                normal = held.normalise(text)
                found = held.encode_normal(normal)
                ids.append(found.tobytes())
                same.append(held.decode(found) == normal.removeprefix(META).replace(META, " "))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(same)], names=["doc_id", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, round_trip boolean")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_wfst_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(documents(spark, sf_dir), piece_model())
    return found.select("doc_id", F.expr("cast(length(ids) / 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "round_trip")
