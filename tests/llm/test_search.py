"""Vector searches, near-duplicates, chat collapse and the pipeline: brute force on small tables."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import bitslice, chat, minhash, tree
from palimpsest.llm.common import give_back
from palimpsest.llm.components import components

KIND = "vec_id long, embedding array<float>, score string"


def vectors(n=900, dims=12, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims)).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[0]  # a third of all rows is one vector
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    return rows, x


ODD = [(None, [1.0] * 12, ""), (5000, None, ""), (5020, [float("nan")] * 12, ""), (5040, [None] + [1.0] * 11, ""), (5060, [float("inf")] * 12, "")]


def expect(ids, values, k, score):
    out = {}
    for i, q in zip(ids, values, strict=True):
        if i % 20 == 0:
            s = [(-score(q, v), j) for j, v in zip(ids, values, strict=True) if j != i]
            out[i] = [(j, -v) for v, j in sorted(s)[:k]]
    return out


def got(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return dict(out)


@pytest.mark.parametrize("block", [64, 32_768])
def test_bit_slices_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", block)
    monkeypatch.setattr(bitslice, "QUERY_CHUNK", 16)
    rows, x = vectors()
    df = spark.createDataFrame([*rows, *ODD], KIND).repartition(4)
    q = np.floor(64 * x.astype(float)).astype(int)
    assert got(bitslice.search(df, 20, 7).collect()) == expect(range(len(q)), q, 7, lambda a, b: int(a @ b))


def test_bit_slice_sums():
    draw = np.random.default_rng(1)
    values, query = draw.integers(-40, 40, (130, 5)), draw.integers(-40, 40, 5)
    rows, scores = bitslice.Slices.loaded(bitslice.Slices.of(values).dumped()).top(query, 130)
    assert (scores == values[rows] @ query).all() and sorted(rows.tolist()) == list(range(130))


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], ""), (1, [1.0, 0.0], ""), (2, [0.0, 0.0], "")], KIND)
    assert [(r.vec_id, r.score) for r in tree.search(few, 20, 5).collect()] == [(1, 1.0)]
    assert [r.vec_id for r in bitslice.search(few, 20, 5).orderBy("rank").collect()] == [1, 2]
    assert tree.search(few.filter("false"), 20, 5).count() == bitslice.search(few.filter("false"), 20, 5).count() == 0


def test_lengths_and_repeats(spark):
    rows = [(9, [1.0, 2.0, 3.0], ""), (0, [1.0, 1.0], ""), (0, [2.0, 0.0], ""), (1, [1.0, 0.0], ""), (1, [0.0, 1.0], ""), (2, [3.0, 0.0], "")]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, KIND).coalesce(1).repartition(parts)
        assert [(r.vec_id, r.score) for r in tree.search(df, 20, 3).orderBy("rank").collect()] == [(2, 6.0), (2, 3.0), (1, 2.0)]
        assert [(r.vec_id, r.score) for r in bitslice.search(df, 20, 3).orderBy("rank").collect()] == [(2, 24576), (2, 12288), (1, 8192)]


def test_queries_of_all_blocks_are_not_sent_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", 50)
    monkeypatch.setattr(bitslice, "QUERY_CHUNK", 2)
    rows, x = vectors(300)
    found = bitslice.search(spark.createDataFrame(rows, KIND).repartition(3), 20, 5)
    values = [[int(c) for c in np.floor(64 * v.astype(float))] for v in x]
    assert got(found.collect()) == expect(range(300), values, 5, lambda a, b: sum(p * q for p, q in zip(a, b, strict=True)))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_scores_that_fit_no_long(spark):
    large = spark.createDataFrame([(0, [1e6, -1e6], ""), (1, [1e6, 1e6], ""), (2, [-1e6, 1e6], "")], KIND)
    assert [(r.vec_id, r.score) for r in bitslice.search(large, 20, 5).orderBy("rank").collect()] == [(1, 0), (2, -2 * 64_000_000**2)]
    with pytest.raises(Exception, match="would not fit a long"):
        bitslice.search(spark.createDataFrame([(0, [1e30], ""), (1, [1.0], "")], KIND), 20, 5).collect()


def test_tree_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(tree, "LEAF_ROWS", 30)
    monkeypatch.setattr(tree, "PART_ROWS", 50)
    rows, x = vectors(1500)
    df = spark.createDataFrame([*rows, *ODD, (6000, [0.0] * 12, "")], KIND).repartition(4)
    found = got(tree.search(df, 20, 10).collect())
    want = expect(range(len(x)), x.astype(float), 10, lambda a, b: float((a * b).sum()))
    assert found.keys() == want.keys()
    hits = [len({j for j, _ in found[i]} & {j for j, _ in want[i]}) for i in want]
    assert np.mean(hits) >= 9 and all(len(v) == 10 for v in found.values())
    for i, row in found.items():
        assert all(abs(s - float(x[i].astype(float) @ x[j].astype(float))) < 1e-9 for j, s in row)
        assert row == sorted(row, key=lambda p: (-p[1], p[0]))


def test_calibration_widens():
    draw = np.random.default_rng(2)
    sample = tree.lengthened(draw.normal(size=(2000, 8)), 100.0)
    grown = tree.grow(sample, 20_000)
    visits = tree.calibrate(grown, sample, 10)
    assert 1 < visits <= grown.leaves and len(set(grown.visit(sample[0], visits))) == visits


def near_copies(seed=4):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(120)] for _ in range(40)]
    rows = [" ".join(w) for w in base]
    hub = base[0]
    for i in range(60):  # copies that resemble the hub, not one another
        copy = list(hub)
        copy[(2 * i) % 116] = word()
        rows.append(" ".join(copy))
    rows += [rows[1].upper(), "  ".join(base[1]), rows[2] + " " + word(), "short text", "Short  TEXT", "", "", None, word()]
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(40)]
    order = list(range(len(rows)))
    draw.shuffle(order)
    return [(order[i], text, "clash") for i, text in enumerate(rows)]


def brute_classes(rows):
    sets = [(i, *minhash.shingles(minhash.words(t or ""))) for i, t, _ in rows]
    filled = [s for s in sets if len(s[1])]
    counts = defaultdict(int)
    for _, found, _ in filled:
        for h in found.tolist():
            counts[h] += 1
    often = sorted(h for h, n in counts.items() if n >= minhash.FLOOR * len(rows))
    idf = 1 + np.log([len(rows) / counts[h] for h in often]) / np.log(1 / minhash.FLOOR)
    data = {i: minhash._payload(f, minhash.weights(f, tf, np.array(often, np.uint64), idf)) for i, f, tf in filled}
    parent = {i: i for i, _, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(data)
    for a in ids:
        for b in ids:
            if a < b and minhash.similarity(data[a], data[b]) >= minhash.THRESHOLD and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in parent}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(5)
    found = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert found == brute_classes(rows)
    kept = minhash.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values()))


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    text, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(3, other, ""), (5, other, ""), (5, "quite another text of seven words here", ""), (7, text, "a"), (7, text, "b"), (None, text, ""), (9, text + " more", ""), (None, None, ""), (4, "", ""), (None, "all by itself", ""), (None, "all by itself", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)
    found = sorted((r.doc_id or -1, r.class_id or -1, r.class_size) for r in minhash.classes(docs).collect())
    assert found == [(-1, -1, 1), (-1, -1, 2), (-1, -1, 2), (-1, 7, 4), (3, 3, 2), (4, 4, 1), (5, 3, 2), (5, 5, 1), (7, 7, 4), (7, 7, 4), (9, 7, 4)]
    kept = minhash.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.filter("text <> ''").collect()) == [("3", other), ("5", rows[2][1]), ("7", text), ("None", "all by itself")]
    assert kept.filter("text is null or text = ''").count() == 2
    assert minhash.classes(docs.filter("false")).count() == minhash.keep_one_of_each(spark, docs.filter("false"), "").count() == 0


def test_similar_pairs_of_blocks(monkeypatch):
    monkeypatch.setattr(minhash, "STRIP", 50)
    draw = np.random.default_rng(6)
    base = np.unique(draw.integers(0, 1 << 63, 90, dtype=np.uint64))
    payloads = []
    for _ in range(60):
        names = np.unique(np.concatenate([draw.choice(base, 85, replace=False), draw.integers(0, 1 << 63, 2, dtype=np.uint64)]))
        payloads.append(minhash._payload(names, np.where(draw.random(len(names)) < 0.96, 64, draw.integers(20, 200, len(names))).astype(np.uint16)))
    payloads += [payloads[0], minhash._payload(base[:1], np.array([64]))]
    want = {(a, b) for a in range(62) for b in range(62) if minhash.similarity(payloads[a], payloads[b]) >= minhash.THRESHOLD}
    every = np.arange(62)
    assert set(minhash.pairs_of(payloads, every, every)) == want and 200 < len(want) < 3600
    assert set(minhash.pairs_of(payloads, every[:20], every[20:])) == {(a, b) for a, b in want if a < 20 <= b}


def test_unlike_long_texts_share_no_samples():
    draw, sampler = np.random.default_rng(0), minhash.Sampler()
    names = [np.unique(draw.integers(0, 1 << 63, 300_000, dtype=np.uint64)) for _ in range(2)]
    a, b = (sampler(n, np.full(len(n), 2 * minhash.STEP, np.uint16)) for n in names)
    assert (a == b).sum() <= 1 and not (minhash.bands(a) == minhash.bands(b)).any()


def test_frequent_shingles_are_bounded(spark):
    """Small tasks put all of their shingles forward; few are collected, and the counts are exact."""
    draw = random.Random(1)
    rows = [(i, " ".join([f"u{draw.random()}" for _ in range(30)] + (["common passage of six words here"] if i % 3 == 0 else []))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40).withColumn("mark", minhash._mark())
    table = minhash._nodes(docs)
    assert table.filter("shingle is not null").count() > 10_000
    names, idf = minhash._frequent(docs, table, 600)
    assert len(names) == 2 and np.allclose(idf, 1 + np.log(3) / np.log(100))


def rare_passages(n=1000):
    """Two texts that differ in passages that nine documents hold: similar enough as these weigh less than what only the two share."""
    draw = random.Random(8)
    some = lambda k: " ".join("".join(draw.choice("abcdefghij") for _ in range(8)) for _ in range(k))
    own, passages = some(372), [some(48), some(48)]
    rows = [f"{own} {p}" for p in passages] + [f"{some(150)} {passages[i % 2]} {some(150)}" for i in range(16)]
    return rows + [some(12) for _ in range(n - len(rows))]


def test_every_shingle_has_its_own_idf(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 1 << 9)
    rows = rare_passages()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(7).withColumn("mark", minhash._mark())
    counts, sets = defaultdict(int), [minhash.shingles(minhash.words(t)) for t in rows]
    for found, _ in sets:
        for h in found.tolist():
            counts[h] += 1
    assert set(counts.values()) == {1, 2, 9} and minhash.FLOOR * len(rows) > 9
    frequent = docs.sparkSession.sparkContext.broadcast(minhash._frequent(docs, minhash._nodes(docs), len(rows)))
    got = {bytes(r.key): np.frombuffer(r.steps, "<u2").tolist() for r in minhash._signatures(docs, frequent, len(rows)).collect()}
    want = [np.rint((1 + np.log([len(rows) / counts[h] for h in found.tolist()]) / np.log(100)) * (1 + np.log(tf)) * minhash.STEP) for found, tf in sets]
    assert got == {minhash._key(minhash.words(t)): w.astype(int).tolist() for t, w in zip(rows, want, strict=True)}
    like = [minhash.similarity(*(minhash._payload(sets[k][0], w[k]) for k in (0, 1))) for w in (want, [np.full(len(w), 64) for w in want])]
    assert like[0] >= minhash.THRESHOLD > like[1]
    assert {r.class_id for r in minhash.classes(docs.drop("mark")).filter("doc_id < 2").collect()} == {0}


def test_sums_of_equal_names():
    draw = np.random.default_rng(5)
    names, n = draw.integers(0, 300, 2000).astype(np.uint64) << np.uint64(50), draw.integers(1, 1 << 32, 2000).astype("<u4")
    sums = defaultdict(int)
    for name, k in zip(names.tolist(), n.tolist(), strict=True):
        sums[name] += k
    assert minhash._sums(names, n).tolist() == [sums[x] for x in names.tolist()] and max(sums.values()) > 1 << 32


def test_python_gets_large_rows_in_small_batches_and_tests_marks_once_a_scan(spark):
    docs = spark.createDataFrame([(i, f"one two three four five {i // 2}") for i in range(8)], "doc_id long, text string")
    kept = minhash.keep_one_of_each(spark, docs, "")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3 and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6]

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    large = spark.range(0, 16, 1, 1).selectExpr("repeat('x', 1048576) as text").mapInArrow(size, "bytes long")
    assert [r.bytes >> 20 for r in large.collect()] == [4, 4, 4, 4]


def test_workers_give_memory_back():
    def used():
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    held = [bytes(20_000) for _ in range(10_000)]  # too small for maps of their own
    held = held[::100]  # and what stays keeps the heap from shrinking
    before = used()
    give_back()
    assert used() < before - 100 and len(held) == 100


def test_samples_estimate_weighted_similarity():
    draw, sampler = np.random.default_rng(0), minhash.Sampler()
    names = np.unique(draw.integers(0, 1 << 63, 900, dtype=np.uint64))
    weights = draw.integers(20, 90, len(names)).astype(np.uint16)
    weights[:400] = 2 * minhash.STEP
    a, b = slice(0, 800), slice(100, 900)
    other = weights.copy()
    other[300:500] //= 2
    real = minhash.similarity(minhash._payload(names[a], weights[a]), minhash._payload(names[b], other[b]))
    same = np.mean([(minhash.Sampler.__call__(sampler, names[a] * np.uint64(2 * s + 1), weights[a]) == minhash.Sampler.__call__(sampler, names[b] * np.uint64(2 * s + 1), other[b])).mean() for s in range(20)])
    assert abs(same - real) < 0.05


def test_words_do_not_depend_on_pieces(monkeypatch):
    text = "Some words, été and ünïcode " * 30 + "x" * 90 + " end"
    whole = minhash.words(text)
    for piece in (7, 40, 64):
        monkeypatch.setattr(minhash, "PIECE", piece)
        assert (minhash.words(text) == whole).all()
    assert len(whole) == 5 * 30 + 2 and len(minhash.words("")) == 0


def test_components(spark):
    edges = spark.createDataFrame([(b"b", b"a"), (b"a", b"b"), (b"c", b"b"), (b"z", b"y"), (b"q", b"q"), *((bytes([99, i + 1]), bytes([99, i])) for i in range(40))], "a binary, b binary")
    found = {bytes(r.node): bytes(r.component) for r in components(edges).collect()}
    assert found[b"c"] == b"a" and found[b"z"] == b"y" and b"q" not in found and {v for k, v in found.items() if k[0] == 99 and len(k) == 2} == {bytes([99, 0])}


def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 3)
    full = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(11)]
    logs = {1: full[:4], 2: full, 3: full, 4: full[:7] + [("user", "other")], 5: full[:1], 6: [("user", "hello")], 7: full[1:5], 8: [(None, None)], 9: [(None, None), ("user", None)], 10: full[:10]}
    rows = [(c, 10 * i, role, text, "clash") for c, turns in logs.items() for i, (role, text) in enumerate(turns)] + [(None, None, "user", "lost", "clash")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string").repartition(3)
    kept = chat.collapse(df)
    assert {(r.conv_id, r.n_turns, r.copies) for r in kept.collect()} == {(2, 11, 2), (4, 8, 1), (6, 1, 1), (7, 4, 1), (9, 2, 1), (None, 1, 1)}
    lines = sorted((r.place, r.line) for r in chat.render(df, kept).collect() if r.conv_id == 4)
    assert "".join(x for _, x in lines) == "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in logs[4])
    assert chat.collapse(df.filter("false")).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Clashing columns, repeated ids, and no rows at all."""
    import corpus_pipeline

    text = " ".join(f"the word and of number {i}" for i in range(20))
    rows = [(i, text + f" item {i} " * 30, "en", "s", 1, "x", "y") for i in (1, 2, 2, 3)] + [(4, None, None, None, None, "", ""), (None, text, "en", "s", 1, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark string, scan_all string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for name, df in (("full", docs), ("none", docs.filter("false"))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        held = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, f"{tmp_path}/{name}")
            assert held.columns == df.columns
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0 if name == "none" else held.count() > 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held, kept = docs, {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, sf_dir)
        now = {r.doc_id for r in held.collect()}
        assert held.columns == docs.columns and now <= kept
        kept = now
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    assert len(kept) > 0.6 * docs.count() and len(good & kept) > 0.85 * len(good)
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
