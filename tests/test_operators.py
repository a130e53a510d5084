"""Operators on small tables: literals, invariants, brute force."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import fuzzy, text
from palimpsest.functions.text import LATIN
from palimpsest.operators import bands, chunks, context, geometry, graph, lattice, matching, review, splits, tokens
from palimpsest.plans.queries import QUERIES

# Geometry


def windows(spark, w, h, *args):
    return [tuple(x) for x in spark.range(1).select(geometry.windows(F.lit(w), F.lit(h), *args)).first()[0]]


def test_windows(spark):
    found = windows(spark, 13889, 7528, 2800, 1400, 2400, 1200)
    assert len(found) == 42 and found[0] == (1, 0, 0, 2800, 1400, 2800, 1400) and found[5] == (6, 11089, 0, 13889, 1400, 2800, 1400) and found[-1][3:5] == (13889, 7528)
    assert windows(spark, 100, 50, 2800, 1400, 2400, 1200) == [(1, 0, 0, 100, 50, 100, 50)]
    with pytest.raises(ValueError):
        geometry.windows(F.lit(1), F.lit(1), 0, 1, 1, 1)


def test_tiles(spark):
    tile = lambda w, h: [tuple(x)[1:5] for x in spark.range(1).select(geometry.tiles(F.lit(w), F.lit(h), 100, 20)).first()[0]]
    assert tile(100, 90) == [(0, 0, 100, 90)] and tile(150, 90) == [(0, 0, 100, 90), (50, 0, 150, 90)]
    with pytest.raises(ValueError):
        geometry.tiles(F.lit(1), F.lit(1), 20, 20)
    n = spark.range(1).select(geometry.tile_count(F.lit(1000), F.lit(100), 100, 20).alias("n"))
    assert n.first().n == 13
    with pytest.raises(Exception, match="too many tiles"):
        n.select(geometry.within_budget(F.col("n"), 9)).collect()


def box(x, y, w, h):
    return [[float(x), float(y)], [float(x + w), float(y)], [float(x + w), float(y + h)], [float(x), float(y + h)]]


ENTRIES = [(1, 1, "a", 0.9, box(0, 0, 10, 10)), (1, 2, "a", 0.8, box(3, 0, 10, 10)), (1, 3, "a", 0.7, box(6, 0, 10, 10)), (1, 4, "b", 0.99, box(0, 0, 10, 10)), (2, 1, "a", 0.5, box(0, 0, 10, 10)), (1, 5, "c", 0.5, box(0, 30, 1, 1)), (1, 6, "c", 0.5, box(0, 30, 1, 1))]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "page int, position long, text string, confidence double, box array<array<double>>")


def test_suppressed_entries_do_not_suppress(spark):
    kept = geometry.suppressed(entries(spark), ["page"], 0.5)
    assert sorted((r.page, r.position) for r in kept.collect()) == [(1, 1), (1, 3), (1, 4), (1, 5), (2, 1)]
    again = geometry.suppressed(kept, ["page"], 0.5)
    assert again.count() == kept.count()


def test_reading_order_and_bounds(spark):
    text = {r.page: r.text for r in geometry.ordered_text(entries(spark), ["page"]).collect()}
    assert text[1] == "a\nb\na\na\nc\nc"
    row = spark.range(1).select(geometry.union_bounds(F.array().cast("array<array<array<double>>>")).alias("b"), geometry.scale_to(F.lit(2800), F.lit(1400), 1600).alias("s"), geometry.scaled(F.lit(3), F.lit(0.1)).alias("n")).first()
    assert tuple(row.b) == (0.0, 0.0, 0.0, 0.0) and row.s == pytest.approx(1600 / 2800) and row.n == 1


def test_remap_and_iou(spark):
    row = entries(spark).filter("page = 2").select(geometry.remapped(F.col("box"), F.lit(0.5), F.lit(5), F.lit(7)).alias("m"), geometry.iou(geometry.bounds(F.col("box")), geometry.bounds(geometry.offset(F.col("box"), F.lit(5.0), F.lit(0.0)))).alias("iou")).first()
    assert row.m[2] == [25.0, 27.0] and row.iou == pytest.approx(50 / 150)


def test_millionths_of_shared_area_are_not_rounded_twice(spark, tmp_path):
    lines = [(1, 2312, 17, 3, 27.0, 0.04, "R"), (1, 10021, 408, 1, 29.0, 0.04, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [r.iou_millionths for r in QUERIES["box_iou_pairs"](spark, str(tmp_path)).collect()] == [128125]


def test_content_and_crop(spark):
    cells = spark.createDataFrame([(1, 30, 5, 100, 60), (1, 50, 50, 100, 60)], "image int, x int, y int, width int, height int")
    assert tuple(geometry.content_bounds(cells, ["image"], "width", "height").first()) == (1, 10, 0, 71, 60)
    crop = lambda *v: spark.range(1).select(geometry.valid_crop(*(F.lit(x) for x in v))).collect()
    assert crop(0, 0, 5, 5, 10, 10)
    with pytest.raises(Exception, match="outside"):
        crop(0, 0, 15, 5, 10, 10)


# Bands


def rows(spark, inks):
    return spark.createDataFrame([(1, i, ink, 100) for i, ink in enumerate(inks)], "image int, row long, ink int, width int")


def test_line_bands(spark):
    inks = [0] * 5 + [9] * 30 + [0] * 10 + [9] * 15 + [0] * 13 + [9] * 25 + [0] * 20 + [9] * 5
    assert sorted((r.start, r.end) for r in bands.line_bands(rows(spark, inks), ["image"]).collect()) == [(5, 60), (73, 98)]


def reference_bounded(start, end, most, least, overlap=40):
    if end - start <= most:
        return [(start, end)]
    out, at, step = [], start, max(least, most - overlap)
    while True:
        stop = min(end, at + most)
        out += [(at, stop)] if stop - at >= least else []
        if stop >= end:
            return out
        at += step


@pytest.mark.parametrize("end", [599, 600, 601, 700, 1160, 1161, 1181, 5000])
def test_bounded(spark, end):
    df = spark.createDataFrame([(1, 0, end)], "image int, start long, end long")
    assert sorted((r.start, r.end) for r in bands.bounded(df, 600, 25).collect()) == reference_bounded(0, end, 600, 25)


def test_tall_bands(spark):
    inks = [50] * 300 + [1] * 40 + [50] * 260 + [1] * 40 + [60] * 15
    band = spark.createDataFrame([(1, 0, len(inks)), (1, 2000, 2100)], "image int, start long, end long")
    found = sorted((r.start, r.end) for r in bands.split_tall(rows(spark, inks), band, ["image"]).collect())
    assert found == [(0, 320), (320, 620), (620, 655), (2000, 2100)]


def test_column_extent(spark):
    cols = spark.createDataFrame([(1, i, 5 if 10 <= i < 20 else 0, 500, 40) for i in range(40)] + [(2, 0, 0, 500, 40)], "image int, column int, ink int, height int, width int")
    assert sorted(tuple(r) for r in bands.column_extent(cols, ["image"]).collect()) == [(1, 10, 20), (2, 0, 40)]


# Chunks and tokens


def reference_chunks(lines, max_lines, max_chars):
    out, held, chars, chunk = [], 0, 0, 1
    for i, line in enumerate(lines, 1):
        n = len(line.strip(" ")) + 1
        if n == 1:
            continue
        if held and (held >= max_lines or chars + n > max_chars):
            chunk, held, chars = chunk + 1, 0, 0
        held, chars = held + 1, chars + n
        out.append((chunk, i))
    return out


def test_chunks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {}
    for r in chunks.pack_lines(docs, max_lines=5, max_chars=300).collect():
        found.setdefault(r.doc_id, []).append((r.chunk_index, r.line_index))
    for r in docs.collect():
        assert sorted(found.get(r.doc_id, [])) == reference_chunks(r.text.split("\n"), 5, 300)


def test_pack_entries(spark):
    df = spark.sql("select array(named_struct('text', 'aa', 'line_index', 1, 'line_image', 'x', 'segments', array('aa'), 'box', array(array(1D, 2D), array(3D, 4D))), named_struct('text', ' ', 'line_index', 2, 'line_image', 'x', 'segments', array(''), 'box', array(array(9D, 9D))), named_struct('text', ' bbb', 'line_index', 3, 'line_image', 'x', 'segments', array('b'), 'box', array(array(0D, 5D)))) as e")
    made = df.select(chunks.pack_entries(F.col("e"), 1, 100).alias("c")).first().c
    assert [(c.chunk_index, c.line_count, c.char_count, tuple(c.bounds), c.text) for c in made] == [(1, 1, 2, (1.0, 2.0, 3.0, 4.0), "aa"), (2, 1, 4, (0.0, 5.0, 0.0, 5.0), "bbb")]
    assert df.select(chunks.pack_entries(F.filter("e", lambda x: F.lit(False))).alias("c")).first().c == []


def segments(spark):
    return spark.createDataFrame([(1, 1, 1, 1, "The quick fox"), (1, 1, 2, 1, "?? 12"), (1, 2, 1, 2, "lazyy dog dog"), (2, 1, 1, 3, "quick")], "chunk_index int, entry_index int, segment_index int, line_index int, text string")


LEXICON = [("quick", 1), ("lazy", 2), ("dog", 3), ("quickly", 4)]


def lexicon(spark):
    return spark.createDataFrame([(w, w, w, "x", f"g{n}", re.sub("[aeiou]", "", w), n) for w, n in LEXICON], "token string, normalized string, lemma string, pos string, gloss string, skeleton string, position long")


def matched(spark):
    seen = tokens.observed_tokens(tokens.ocr_tokens(segments(spark), LATIN))
    found = matching.candidates(seen, lexicon(spark), LATIN)
    return matching.chosen(seen, found), found


def test_results_of_frequent_tokens_are_sent_and_the_rest_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate("a a a b b c d e f".split())], "id int, token string")
    found = spark.createDataFrame([("a", 1), ("c", 2), ("d", 3), ("e", 4)], "token string, n int")
    counts = rows.groupBy("token").count()
    wanted = {how: sorted(rows.join(found, "token", how).select("id", "n").collect()) for how in ("left", "inner")}
    for most in (10, 2):
        monkeypatch.setattr(matching, "BROADCAST_ROWS", most)
        monkeypatch.setattr(matching, "FREQUENT_ROWS", 2)
        for how in ("left", "inner"):
            assert sorted(matching.looked_up(rows, found, counts, how).select("id", "n").collect()) == wanted[how]


def test_observed_tokens(spark):
    best = spark.createDataFrame([(1, 1, "quick", "qu", 0.9, 1), (None, 1, "lost", "l", 0.9, 2), (2, 1, "a", "a", 0.9, 3)], "line_index int, segment_index int, best_token string, observed_span string, best_score double, position long")
    rows = tokens.observed_tokens(tokens.ocr_tokens(segments(spark), LATIN), tokens.lattice_tokens(segments(spark), best, LATIN)).orderBy("position").collect()
    assert [(r.id, r.token, r.token_index, r.source) for r in rows][:4] == [("obs_0001", "The", 1, "ocr_segment"), ("obs_0002", "quick", 2, "ocr_segment"), ("obs_0003", "fox", 3, "ocr_segment"), ("obs_0004", "quick", 1001, "akshara_lattice")]
    assert len(rows) == 8


def test_numbered_has_no_gaps(spark):
    rows = tokens.numbered(spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(7), ["k"]).collect()
    assert all(r.position == r.k + 1 for r in rows)


def test_numbered_counts_the_ranges_that_it_numbers(spark):
    held = spark.range(20000).select((F.col("id") * 7 % 20000).alias("k"), F.col("id").cast("string").alias("other")).repartition(5)
    rows = tokens.numbered(held, ["k"], parts=3).collect()
    assert len(rows) == 20000 and all(r.position == r.k + 1 for r in rows)


def test_candidates_and_choice(spark):
    chosen, found = matched(spark)
    ranks = {(r.observed, r.entry): (r.rank, r.score) for r in found.collect()}
    assert ranks["quick", "quick"] == (1, 0.98) and ranks["dog", "dog"] == (1, 0.98) and ("quick", "quickly") in ranks
    rows = {r.token: r for r in chosen.collect()}
    assert rows["lazyy"].chosen_token == "lazy" and rows["fox"].chosen_token == "fox" and rows["fox"].n_candidates == 0
    assert {r.token for r in tokens.unmatched_summary(chosen).collect()} >= {"fox"}
    assert [r.token for r in matching.exact_hits(chosen, lexicon(spark)).select("token").distinct().orderBy("token").collect()] == ["dog", "quick"]


def test_distinct_texts_are_dealt_to_all_tasks(spark):
    seen = spark.range(1000).select(F.col("id").cast("string").alias("observed")).distinct()
    tasks = matching.dealt(seen, "observed").select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism


def test_a_large_lexicon_is_met_in_blocks(spark, monkeypatch):
    whole = sorted(tuple(r) for r in matched(spark)[1].select("observed", "entry", "score", "rank").collect())
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 2)
    found = matched(spark)[1].select("observed", "entry", "score", "rank")
    assert sorted(tuple(r) for r in found.collect()) == whole


def test_batches_over_all_rows(spark):
    rows = review.fixed_batches(spark.range(10).repartition(3), "id", 4).collect()
    assert {r.id: r.batch_index for r in rows} == {i: i // 4 + 1 for i in range(10)}


def test_pairs_left_out_by_length_never_reach_the_score(spark):
    from palimpsest.functions.fuzzy import token_score

    words = [w for w in "a ab quack quickest laziness dogs god dogma quickquickquick yzal".split()]
    found = matching.candidates(spark.createDataFrame([(w,) for w in words], "token string"), lexicon(spark), LATIN, most=99)
    want = {(w, e) for w in words for e, _ in LEXICON if token_score(w, e, re.compile("[AEIOUaeiou]+"))[0] >= matching.TOKEN_THRESHOLD}
    assert {(r.observed, r.entry) for r in found.collect()} == want


# Graph and reconstruction


def test_graph(spark):
    chosen, found = matched(spark)
    nodes, edges = graph.nodes(chosen, found).collect(), graph.edges(chosen, found).collect()
    ids = [n.id for n in nodes]
    assert len(ids) == len(set(ids)) and all(e.source in ids and e.target in ids for e in edges)
    assert sum(e.type == "sequence" for e in edges) == chosen.count() - 2
    assert graph.summary(chosen).first().observed_tokens == 7


def test_reconstruction_loses_no_segment(spark):
    chosen, _ = matched(spark)
    rows = {(r.chunk_index, r.entry_index, r.segment_index): (r.reconstructed_text, r.strategy, r.token_count) for r in graph.reconstruct(segments(spark), chosen, script=LATIN).collect()}
    assert rows == {(1, 1, 1): ("quick", "ocr_matched", 1), (1, 1, 2): ("?? 12", "ocr_fallback", 0), (1, 2, 1): ("lazy dog", "ocr_matched", 2), (2, 1, 1): ("quick", "ocr_matched", 1)}
    lines = graph.reconstructed_lines(graph.reconstruct(segments(spark), chosen, script=LATIN)).orderBy("chunk_index", "entry_index").collect()
    assert [r.reconstructed_text for r in lines] == ["quick ?? 12", "lazy dog", "quick"]
    hypotheses = {r.chunk_index: (r.observed_text, r.hypothesis) for r in graph.chunk_hypotheses(chosen).collect()}
    assert hypotheses[1] == ("The quick fox lazyy dog dog", "The quick fox lazy dog dog")


# Lattice and segmentation


def test_lattice(spark):
    known = spark.createDataFrame([("गण", "गण", "गण", "", "troop", "", 1), ("नमः", "नमः", "", "", "bow", "", 2), ("नाम", "नाम", "", "", "name", "", 3)], "token string, normalized string, lemma string, pos string, gloss string, skeleton string, position long")
    seg = spark.createDataFrame([(1, 1, "भ्रगणयायनम")], "line_index int, segment_index int, text string")
    found = lattice.lattice(seg, known)
    top = found.orderBy(F.desc("score"), "start", "end", "entry_position").limit(3).collect()
    assert [(r.start, r.end, r.span, r.entry, r.score) for r in top] == [(2, 4, "गण", "गण", 1.0), (6, 8, "नम", "नमः", 0.866), (6, 8, "नम", "नाम", 0.866)]
    assert lattice.best_spans(found).first().entry == "गण"


def test_lattice_query_scores_fuzzy_spans(spark, tmp_path):
    from palimpsest.plans import queries

    spark.createDataFrame([(1, "sunny garden sunny")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "Gardem xxsunnyyy\nsunny qq")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rule = re.compile(f"[{LATIN.dependent}]+")
    cut = lambda t: re.findall("[a-z]{1,2}", t)
    wanted = {}
    for t in ("gardem", "xxsunnyyy", "sunny", "qq"):
        for i in range(len(cut(t))):
            for j in range(i + 1, min(len(cut(t)), i + 8) + 1):
                span = "".join(cut(t)[i:j])
                scores = [(-fuzzy.span_score(span, rule.sub("", span), j - i, w, rule.sub("", w), len(cut(w))), n, w) for n, w in enumerate(("sunny", "garden"))]
                wanted |= {(t, i, j, w): (-s, rank) for rank, (s, _, w) in enumerate(sorted(x for x in scores if -x[0] >= 0.62), 1)}
    found = {(r.token, r.start, r.end, r.entry): (r.score, r.rank) for r in queries.QUERIES["syllable_lattice"](spark, str(tmp_path)).collect()}
    assert found == wanted and ("gardem", 0, 3, "garden") in found
    best = {r.id: (r.span, r.entry) for r in queries.QUERIES["best_lattice_spans"](spark, str(tmp_path)).collect()}
    assert best["7:1:1"] == ("gardem", "garden") and best["7:2:1"] == ("sunny", "sunny") and len(best) == 3


def test_segmentations(spark):
    words = [splits.Entry(w, w, w, "n", w.upper()) for w in ("sun", "flower", "sunflow", "low")]
    rows = splits.segmentations(spark.createDataFrame([("sunflower",), ("xxsunyy",), ("zz",), ("",)], "token string"), words, LATIN, k=3, least=0.95).orderBy("token", "rank").collect()
    best = {r.token: r for r in rows if r.rank == 1}
    assert best["sunflower"].split == "sun + flower" and best["sunflower"].interpretation == "SUN + FLOWER" and best["sunflower"].skipped_chars == 0
    assert best["sunflower"].score == pytest.approx(0.98 * 9 - 0.16, abs=1e-4)
    assert [(s.kind, s.surface) for s in best["xxsunyy"].steps] == [("noise", "xx"), ("lexical", "sun"), ("noise", "yy")] and "zz" not in best
    assert [r.rank for r in rows if r.token == "sunflower"] == [1, 2, 3]


def test_span_bounds_miss_no_pair():
    rule = re.compile(f"[{LATIN.dependent}]+")
    words, texts = ["the", "a", "sunflower", "aeiou", "lo", "rhythm"], ["the", "t", "th", "sunflowers", "xsunflowerx", "aeiuo", "eaeiouxyz", "zz", "low", "rhythms", "é𝒳the"]
    for least in (0.3, 0.58, 0.85):
        got = {(texts[i], words[j]) for i, j, _ in fuzzy.Bounds(words, rule).pairs(texts, least, block=4)}
        assert got == {(t, w) for t in texts for w in words if fuzzy.attainable(t, w, rule) >= least - 1e-4}


def test_best_entries_equal_all_scores():
    rule = re.compile(f"[{LATIN.dependent}]+")
    words, texts = ["lazy", "lazier", "sun", "sunny", "sunflower", "flower", "low", "lower"], ["lazyy", "sunn", "sunflowers", "flow", "xlowerx", "zz"]
    for most in (1, 2, 5):
        got = [(i, j, rank, d[0]) for i, j, rank, d in fuzzy.best_entries(texts, words, fuzzy.Bounds(words, rule), 0.58, most)]
        scores = [sorted((-s, j) for j, w in enumerate(words) if (s := fuzzy.token_score(t, w, rule)[0]) >= 0.58) for t in texts]
        assert sorted(got) == sorted((i, j, rank, -s) for i, found in enumerate(scores) for rank, (s, j) in enumerate(found[:most], 1))


def test_order_bounds_pairs_of_the_same_letters(monkeypatch):
    rule, calls, score = re.compile("[aeiou]+"), [], fuzzy.token_score
    monkeypatch.setattr(fuzzy, "token_score", lambda *x: calls.append(x[:2]) or score(*x))
    words, texts = ["listen", "stream", "note"], ["netsil", "maerts", "streams", "netlisten"]
    found = sorted((texts[i], words[j]) for i, j, *_ in fuzzy.best_entries(texts, words, fuzzy.Bounds(words, rule), 0.58, 3))
    assert found == [("netlisten", "listen"), ("streams", "stream")] and len(calls) <= 3


def test_gestalt_queries_take_all_tokens_of_documents(spark, sf_dir):
    from palimpsest.plans import queries

    seen = queries.line_tokens(spark, sf_dir).cache()
    assert queries.QUERIES["chosen_tokens"](spark, sf_dir).count() == seen.count()
    found = {r.observed for r in queries.QUERIES["fuzzy_match_topk"](spark, sf_dir).select("observed").distinct().collect()}
    words = {r.normalized for r in queries.lexicon(spark, sf_dir).collect()}
    tokens_seen = {r.token for r in seen.select("token").distinct().collect()}
    seen.unpersist()
    assert {w for w in words & tokens_seen if re.search("[^aeiou]", w)} <= found <= tokens_seen


def test_split_query_takes_short_tokens_of_documents_and_all_entries(spark, sf_dir):
    from palimpsest.plans import queries

    words = [r.normalized for r in queries.lexicon(spark, sf_dir).orderBy("position").collect()]
    seen = {r.token for r in queries.line_tokens(spark, sf_dir).select("token").distinct().collect()}
    # Words of vowels alone have no skeleton, which keeps their score below 0.85.
    wanted = {w for w in words if w in seen and re.search("[^aeiou]", w)}
    found = {r.token: r.split for r in queries.QUERIES["split_kbest"](spark, sf_dir).filter("rank = 1").collect()}
    assert wanted <= set(found) <= seen and min(map(len, found)) < 4
    assert any(w in set(" + ".join(found.values()).split(" + ")) for w in words[100:])


# Context


def test_neighbours_by_stretches_equal_one_window(spark):
    rows = spark.range(1, 4000).select(F.col("id").alias("position"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("surface"))
    got = {r.position: (r.before, r.after) for r in context.neighbours(rows, 2).collect()}
    assert len(got) == 3999
    for p in (1, 2, 1023, 1024, 1025, 2048, 3999):
        near = lambda q: [str(x) for x in q if 1 <= x < 4000 and x % 3]
        assert got[p] == (near((p - 2, p - 1)), near((p + 1, p + 2)))


def test_neighbours_in_an_array_equal_a_window(spark):
    held = spark.createDataFrame([(1, list("abcde")), (2, ["x"]), (3, [])], "chunk_index int, words array<string>")
    held = held.select("chunk_index", F.transform("words", lambda w, i: F.struct(i.alias("position"), F.when(w != "c", w).alias("surface"))).alias("items"))
    got = {(r.chunk_index, r.position): (r.before, r.after, r.previous and r.previous.position) for r in context.beside(held, "items", "surface", 2).collect()}
    rows = context.neighbours(held.select("chunk_index", F.inline("items")), 2, by=("chunk_index",)).collect()
    assert got == {(r.chunk_index, r.position): (r.before, r.after, r.position - 1 if r.position else None) for r in rows} and len(rows) == 6


def test_candidates_of_tokens_equal_those_by_id(spark):
    chosen, _ = matched(spark)
    probes = spark.createDataFrame([("fox", "Split: ['ka', 'ma']", 1), ("quick", "Split: ['ga']", 2)], "token string, output string, position long")
    paths = spark.createDataFrame([("fox", 1, 2, [("lexical", "fo", 0.9)]), ("fox", 2, 0, [("lexical", "fx", 0.9)])], "token string, rank int, skipped_chars int, steps array<struct<kind:string,normalized:string,score:double>>")
    flat = lambda windows: windows.withColumn("context_score", F.size("context_window") / 10)
    by_id = context.ranked(chosen, context.parser_candidates(chosen, probes).unionByName(context.split_candidates_of(chosen, paths, most=2)), flat, radius=1)
    held = matching.looked_up(chosen, context.listed(context.parser_splits(probes), context.segmentation_splits(paths, most=2)))
    by_token = context.ranked(held, None, flat, radius=1, once=False)
    fields = ["candidate_id", "source", "surface", "local_score", "context_score", "combined_score", "skipped"]
    assert sorted(by_id.select(fields).collect()) == sorted(by_token.select(fields).collect()) and by_token.count() == chosen.count() + 5
    assert context.summary(by_token).first() == context.summary(by_id).first() and context.summary(by_id).first().tokens == chosen.count()


def test_queries_over_tokens_bring_no_tokens_together(spark, sf_dir):
    from palimpsest.plans import records  # noqa: F401  registers more queries

    for name in ("contextual_candidates", "contextual_counts", "contextual_scores", "tokens_with_lattice", "three_tier_reconstruction", "chunk_hypotheses", "context_window", "sequence_edges", "token_sheets", "graph_counts", "edit_graph_edges"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Window|SortMergeJoin|hashpartitioning\((id|chunk_index|line_index|context_window)#", plan), name


def test_ranking(spark):
    chosen, _ = matched(spark)
    probes = spark.createDataFrame([("fox", "Split: ['ka', 'ma']", 1), ("fox", "Split: ['ga']\nSplit: ['gam']", 2)], "token string, output string, position long")
    paths = spark.createDataFrame([("fox", 1, 2, [("lexical", "fo", 0.9), ("noise", "x", -0.5)]), ("fox", 2, 0, [("lexical", "fx", 0.9)])], "token string, rank int, skipped_chars int, steps array<struct<kind:string,normalized:string,score:double>>")
    known = spark.createDataFrame([("fo",)], "part string")
    more = context.parser_candidates(chosen, probes).unionByName(context.split_candidates_of(chosen, paths, known, most=2))
    flat = lambda windows: windows.withColumn("context_score", F.lit(0.5))
    found = context.ranked(chosen, more, flat, radius=1)
    rows = {(r.observed_token, r.source): r for r in found.collect()}
    assert rows["fox", "parser_split"].surface == "ग" and rows["fox", "parser_split"].local_score == 0.5
    assert rows["fox", "dp_split"].local_score == pytest.approx(0.9 - 0.16) and ("fox", "dp_split") in rows
    assert rows["fox", "observed"].context_window == ["quick", "fox", "lazy"]
    best = {r.observed_token: r.source for r in context.best_of_each(found).collect()}
    assert best["fox"] == "dp_split" and best["quick"] == "lexicon"
    long = context.ranked(chosen, more, flat, radius=3, most_chars=5).filter("not skipped").count()
    assert long == 0
    assert context.context_edges(found).count() == context.context_nodes(found).count() == more.count() + chosen.count()


# Review


def test_variant_rules(spark):
    def choose(*variants):
        rows = [(1, i, *v) for i, v in enumerate(variants)]
        df = spark.createDataFrame(rows, "line int, position int, variant string, text string, heuristic_score double, mean_score double, non_whitespace_characters int, script_ratio double, lexicon_ratio double")
        r = review.choose_variant(df, ["line"]).first()
        return r.variant, r.selected_by, r.text

    assert choose(("raw", "", 0.1, 0.0, 0, 0.0, 0.0), ("x", "abc", 0.9, 0.0, 3, 1.0, 0.0)) == ("raw", "blank_suppression", "")
    assert choose(("raw", "abc", 0.1, 0.0, 3, 0.0, 0.0), ("x", "abcd", 0.9, 0.0, 4, 1.0, 0.0)) == ("raw", "raw_anchor", "abc")
    assert choose(("raw", "abc", 0.5, 0.0, 3, 0.0, 0.0), ("x", "abcdefgh", 0.55, 0.0, 8, 1.0, 0.5)) == ("raw", "raw_anchor", "abc")
    assert choose(("raw", "abc", 0.5, 0.0, 3, 0.0, 0.0), ("x", "abcdefgh", 0.6, 0.0, 8, 1.0, 0.5)) == ("x", "heuristic_best", "abcdefgh")


def test_views_and_annotations(spark):
    chosen, _ = matched(spark)
    best = chosen.select("id", F.lit("lexicon").alias("source"), F.upper("token").alias("surface"), F.lit(0.1).alias("local_score"), F.lit(0.0).alias("context_score"), F.when(F.col("token") == "lazyy", 0.6).otherwise(0.1).alias("combined_score"))
    found = review.suggestions(chosen, best)
    assert {r.confidence for r in found.collect()} == {"low", "high"}
    seg = segments(spark)
    rebuilt = graph.reconstruct(seg, chosen, script=LATIN).select("line_index", "segment_index", "reconstructed_text", "strategy")
    views = review.line_views(review.segment_views(seg, rebuilt, found))
    assert {r.line_index: r.preferred_text for r in views.collect()} == {1: "quick ?? 12", 2: "LAZYY", 3: "quick"}
    log = spark.createDataFrame([(1, "a", "edited", "x", "", "2024-01-01"), (1, "b", "accept-draft", "y", "", "2024-02-01")], "line_index int, reviewer string, verdict string, final_text string, notes string, updated_at string")
    rows = {r.line_index: (r.reviewer, r.verdict) for r in review.attached(views, log).collect()}
    assert rows == {1: ("b", "accept-draft"), 2: ("", "unreviewed"), 3: ("", "unreviewed")}
    assert review.line_sheet(review.attached(views, log)).count() == 3 and review.token_sheet(found).count() == 7


def test_stale(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "b", None), (1, "b", "c"), (1, "b", "a"), (1, None, "a"), (None, None, None)], "n int, made string, changed string")
    assert [r[0] for r in df.select(review.is_stale(F.col("n"), F.col("made"), F.col("changed"))).collect()] == [True, False, True, False, True, True]


def test_draft(spark):
    lines = spark.createDataFrame([(1, "dog, dog fox dog"), (2, "none")], "line_index int, text string")
    found = spark.createDataFrame([(1, "dog", "DOG", 0.9, 1), (1, "dog", "hound", 0.1, 2), (1, "fox", "vixen", 0.3, 3)], "line_index int, token string, best_surface string, combined_score double, position int")
    assert {r.line_index: r.draft_text for r in review.replaced_in_line(lines, found, "[a-z]+").collect()} == {1: "DOG, dog vixen dog", 2: "none"}


def test_records_and_prompts(spark):
    df = spark.sql("select 1 as line_index, 'edited' as verdict, '' as final_text, 'p' as preferred_text, cast(null as string) as notes, array(named_struct('normalized_text', 'n', 'interpretation', repeat('x', 400), 'uncertainty_notes', '')) as candidates")
    row = review.summary_record(df).first()
    assert (row.final_text, row.preferred_text, row.notes, row.uncertainty_notes) == ("none", "p", "none", "none") and len(row.interpretation) == 362
    assert df.select(review.prompt("Title", {"raw": F.col("preferred_text"), "notes": F.col("notes")})).first()[0] == "Title\nraw: p\nnotes: none"
    runs = spark.createDataFrame([("r", "a", 1, 5), ("r", "b", 1, 5), ("r", "c", None, 9)], "k string, path string, s1 int, s2 int").withColumn("position", F.ascii("path"))
    assert review.best_run(runs, ["k"], ["s1", "s2"], "position").first().path == "a"


def test_injected_functions(spark):
    chosen, _ = matched(spark)

    def score(window):
        if "fox" in window:
            raise RuntimeError("no answer")
        return 0.5

    found = context.ranked(chosen, None, context.by_function(score))
    rows = {r.observed_token: r.context_score for r in found.collect()}
    assert rows["fox"] == 0.0 and rows["quick"] == 0.5
    assert tuple(context.summary(found).first()) == (7, 7, 0, 0, 6, 0)
    batches = review.fixed_batches(spark.range(1, 7).withColumnRenamed("id", "line_index"), "line_index", 4)

    def tell(records):
        if len(records) < 4:
            raise ValueError("too few")
        return "-".join(str(r["line_index"]) for r in records)

    assert sorted(tuple(r) for r in review.summarised(batches, ["batch_index"], tell, "line_index").collect()) == [(1, "1-2-3-4", "ok", None), (2, None, "error", "too few")]


def test_small_ones(spark):
    chosen, _ = matched(spark)
    row = spark.range(1).select(geometry.remapped_tile(F.struct(F.lit(1).alias("tile_index"), F.lit(3).alias("x"), F.lit(4).alias("y"), F.lit(5).alias("width"), F.lit(6).alias("height")), F.lit(0.5), F.lit(10), F.lit(20)).alias("t")).first()
    assert tuple(row.t) == (1, 16, 28, 10, 12) and geometry.confident(entries(spark), 0.8).count() == 3
    lines = spark.createDataFrame([(1,)], "line int")
    assert [(r.position, r.variant) for r in review.with_variants(lines, ("raw", "gray", "clean"), ("gray",)).collect()] == [(0, "raw"), (1, "clean")]
    wanted = spark.createDataFrame([(1, 1), (None, 1)], "line_index int, segment_index int")
    assert [r.token for r in review.segment_tokens(wanted, chosen).orderBy("token_order").collect()] == ["The", "quick", "fox"]
    probes = spark.createDataFrame([("a", "Split: ['x']"), ("b", "Morphological tags:\n(n)\n"), ("c", None)], "token string, output string")
    assert tuple(splits.probe_summary(probes, spark.createDataFrame([("a",), ("a",)], "token string")).first()) == (3, 1, 1, 1)


def test_trimmed_and_upscaled(spark):
    images = spark.createDataFrame([(1, 100, 60), (2, 50, 40)], "image int, width int, height int")
    cells = spark.createDataFrame([(1, 30, 10), (1, 70, 59)], "image int, x int, y int")
    assert sorted(tuple(r) for r in geometry.trimmed(images, cells, ["image"]).collect()) == [(1, 10, 0, 91, 60), (2, 0, 0, 50, 40)]
    assert tuple(spark.range(1).select(geometry.upscaled(F.lit(3), F.lit(1), 0.1).alias("s")).first().s) == (1, 1)
    with pytest.raises(ValueError, match="positive"):
        geometry.upscaled(F.lit(3), F.lit(1), 0)


def test_tree_of_summaries(spark):
    rows = spark.range(1, 11).select(F.col("id").alias("line"), F.col("id").cast("string").alias("text"))
    joined = lambda records: "(" + " ".join(r["text"] for r in records) + ")"
    assert tuple(review.reduced(rows, joined, "line", 4).first()) == ("((1 2 3 4) (5 6 7 8) (9 10))", "ok", None, 2, 3)

    def some(records):
        if len(records) < 4:
            raise ValueError("too few")
        return "x"

    assert review.reduced(rows.limit(2), some, "line", 4).first().status == "error"


def test_parts_in_either_quotes(spark):
    row = spark.range(1).select(text.split_candidates(F.lit("""Split: ["it's", 'b']\nSplit: []\nSplit: [a]\nSplit: ['x',]""")).alias("x"), text.digit_ratio(F.lit("①a²5")).alias("d"), text.numeric_confidence(F.lit(0.0001)).alias("c")).first()
    assert row.x == [["it's", "b"], []] and row.d == 0.75 and row.c == "0.00"
