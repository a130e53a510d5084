"""Token files, packing and the piece transducer: exact round trips and brute force."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import packing, repair, wfst
from palimpsest.llm.common import Pieces, new_path, word_bpe

ODD = ["a\x1cb's don't <|endoftext|>x <|endoftext|> İstanbul ΑΣ. Σ, é ½ 12a   z\u0085y", "'''s", "...", "a.b.,c", "́a", "ǅ ﬁ", "K’s", "", "x" * 5000, "日本語 한국어 नमस्ते", "a'S 'T'll", "ÉTÉ, Été!!"]
DOCS = [(3, "One two three. " * 400, 1), (1, None, 2), (2, "", 3), (None, "no id", 4), (3, "again", 5), (5, "long " * 9000, 6), (7, "aaa aaa", 7)]


@pytest.fixture(scope="module")
def held():
    return Pieces(word_bpe(), limit=50)


@pytest.mark.parametrize("text", ODD)
def test_chunks_give_the_tokenizers_ids(held, text):
    assert held.encode(text) == held.plain(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF) | st.sampled_from(" \n'.,sStTéÉ"), max_size=60))
def test_chunks_give_the_tokenizers_ids_for_any_text(held, text):
    assert held.encode(text) == held.plain(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(2, 6))
def test_grammar_round_trip(ids, least):
    ids = np.array(ids, np.uint32)
    symbols, rules, first = repair.induce(ids, least)
    assert (repair.expand(symbols, rules, first) == ids).all() and len(symbols) <= len(ids)


def test_random_access():
    ids = np.random.default_rng(0).integers(0, 30, 20_000).astype(np.uint32)
    ids[5000:9000] = 7
    block = repair.Block(repair.pack_block([4, None], [15_000, 5_000], ids))
    assert block.doc_ids == [4, None] and len(block.symbols) < len(ids) and (block.all() == ids).all()
    for start, n in ((0, 1), (4990, 30), (8000, 1500), (19_999, 1), (0, 0)):
        assert (block.tokens(start, n) == ids[start : start + n]).all()
        depth = int(np.log2(block.lengths.max())) * 2 + 2
        assert block.touched <= 2 * n + 2 * depth
    assert block.tokens(6000, 1).tolist() == [7] and 0 < block.touched < len(block.rules) / 4


def plain_repair(ids, least):
    """The textbook form: the most frequent pair, one at a time, until none is as frequent as ``least``."""
    ids, rules = list(ids), []
    while True:
        counts, before = {}, None
        for i in range(len(ids) - 1):
            pair = (ids[i], ids[i + 1])
            if before == (i - 1, pair):  # aaa holds one pair
                before = None
                continue
            counts[pair], before = counts.get(pair, 0) + 1, (i, pair)
        top = max(counts, key=counts.get, default=None)
        if top is None or counts[top] < least:
            return ids, rules
        out, i = [], 0
        while i < len(ids):
            if tuple(ids[i : i + 2]) == top:
                out.append(1000 + len(rules))
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids, rules = out, [*rules, top]


def test_grammar_against_plain_repair():
    draw = np.random.default_rng(3)
    words = [draw.integers(0, 40, n).tolist() for n in (3, 4, 5, 6, 7, 8, 9)]
    ids = np.array(sum((words[i] for i in draw.integers(0, len(words), 600)), []), np.uint32)
    want, rules = plain_repair(ids.tolist(), 16)
    symbols, own, first = repair.induce(ids, 16)
    assert (repair.expand(symbols, own, first) == ids).all()
    size = lambda s, r: len(s) + 2 * len(r)
    assert size(symbols, own) <= 1.3 * size(want, rules) < 0.4 * len(ids)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)


def test_token_files(spark):
    path = new_path(spark, "t")
    repair.write_tokens(frame(spark, DOCS), path, word_bpe(), end_id=2)
    got = sorted(repair.read_tokens(spark, path).collect(), key=lambda r: r.start)
    held, start = Pieces(word_bpe()), 0
    for row, (doc, text, _) in zip(got, sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")), strict=True):
        ids = np.append(np.frombuffer(held.plain(text or ""), held.dtype), 2).astype("<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_nothing(spark):
    path = new_path(spark, "t")
    repair.write_tokens(frame(spark, []), path, word_bpe(), end_id=2)
    assert repair.read_tokens(spark, path).count() == 0


def check_pieces(rows, docs):
    held = Pieces(word_bpe())
    whole = sorted(np.append(np.frombuffer(held.plain(t or ""), held.dtype), 1).astype("<u4").tobytes() for _, t, _ in docs)
    assert sum(r.length for r in rows) == sum(map(len, whole)) // 4
    by_end = {}
    for r in rows:
        by_end.setdefault(r.sequence_id, []).append((r.offset, r.length))
    waste = 0
    for parts in by_end.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= packing.WINDOW
        waste += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return waste


def test_packing(spark):
    rows = packing.pack(frame(spark, DOCS), word_bpe(), end_id=1).collect()
    assert check_pieces(rows, DOCS) == 0
    held = Pieces(word_bpe())
    ids = np.append(np.frombuffer(held.plain(DOCS[5][1]), held.dtype), 1).astype("<u4")
    own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 5)
    assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n, _ in own] == [c for _, _, c in own]
    assert packing.pack(frame(spark, []), word_bpe(), end_id=1).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=120))
def test_plan_places_every_tail_once(lengths):
    histogram = np.bincount(np.array(lengths, int), minlength=65)
    histogram[0] = 0
    p = packing.plan(histogram, window=64)
    filled = {}
    for length in range(1, 64):
        for rank in range(int(histogram[length])):
            parts = packing.place(p, length, rank)
            assert sum(n for n, _, _ in parts) == length
            for n, sequence, offset in parts:
                filled.setdefault(sequence, []).extend(range(offset, offset + n))
    for places in filled.values():
        assert sorted(places) == list(range(len(places))) and len(places) & (len(places) - 1) == 0


def test_least_squares_uses_exact_combinations():
    histogram = np.zeros(65, int)
    histogram[[40, 24, 16]] = 100, 60, 80
    combos = packing.combinations(64, histogram > 0)
    x = packing.solve(combos, histogram, 2000)
    assert {tuple(c): round(v) for c, v in zip(combos.tolist(), x, strict=True)}[(40, 24, 0)] >= 55


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=wfst.piece_model()), wfst.Transducer(wfst.piece_model())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefghinorst éß  ▁\n.,1日𓀀"), max_size=40))
def test_transducer_gives_the_librarys_ids(library, text):
    model, own = library
    ids = own.encode(text)
    assert ids.tolist() == model.encode(text) and own.decode(ids) == text.replace("▁", " ")


def test_transducer_query(spark):
    got = wfst.encode(frame(spark, DOCS), wfst.piece_model()).collect()
    assert len(got) == len(DOCS) and all(r.round_trip for r in got)


def test_transducer_of_no_rows(spark):
    assert wfst.encode(frame(spark, []), wfst.piece_model()).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("▁aehnrst日"), min_size=1, max_size=7))
def test_no_path_weighs_less(library, word):
    own = library[1]
    paths = [[]]
    ends = {}
    for end, arc in own.composed(word):
        ends.setdefault(end + 1 - len(arc), []).append(arc)
    whole = []
    while paths:
        path = paths.pop()
        at = sum(map(len, path))
        if at == len(word):
            whole.append(path)
        paths += [[*path, arc] for arc in ends.get(at, [])]
    best = own.shortest(word)
    assert best in whole and own.cost(best) == min(map(own.cost, whole)) < wfst.INFINITE
    assert [p for p in whole if own.cost(p) < wfst.INFINITE] == [best]


def message(*fields):
    """A protocol buffer message of (number, bytes, int or float)."""

    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


@pytest.fixture(scope="module")
def unigram():
    """A model of independent pieces with byte fallback, and a normaliser that changes texts."""
    import sentencepiece

    normaliser = next(bytes(v) for n, v in wfst._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if n == 3)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [(p, -1.0 - i / 7, 1) for i, p in enumerate(["▁a", "ab", "▁", "a", "b", "abc", "c", "bc", "▁abca", "1", "12", "k", "▁k", "é"])]
    proto = message(*((1, message((1, p.encode()), (2, w), (3, k))) for p, w, k in pieces), (2, message((3, 1), (35, 1))), (3, normaliser))
    return sentencepiece.SentencePieceProcessor(model_proto=proto), wfst.Transducer.of(proto)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abck12 é  ①ﬁＡ㎏\u3000\t½日e\u0301\ufeff\n"), max_size=30))
def test_transducer_normalises_and_weighs_pieces(unigram, text):
    model, own = unigram
    assert own.normalise(text) == ("▁" if model.normalize(text) and not model.normalize(text).startswith("▁") else "") + model.normalize(text)
    assert own.encode(text).tolist() == model.encode(text)
    assert own.decode(own.encode(text)) == own.normalise(text).removeprefix("▁").replace("▁", " ")
