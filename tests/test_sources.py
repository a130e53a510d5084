"""Readers, writers, streams, and the driver's contract."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import LATIN
from palimpsest.operators import bands
from palimpsest.sources import readers, writers
from palimpsest.streaming import jobs


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("# token\tlemma\tpos\tgloss\n\nनमः\tनमस्\tind\tbow\n???\ta\tb\tc\nगण\tगण\tn\ttroop\n")
    rows = readers.lexicon(spark, str(tmp_path / "l.tsv")).orderBy("position").collect()
    assert [(r.token, r.lemma, r.position, r.skeleton) for r in rows] == [("नमः", "नमस्", 1, "नम"), ("गण", "गण", 2, "गण")]
    (tmp_path / "bad.tsv").write_text("नमः\tx\n")
    assert readers.lexicon(spark, str(tmp_path / "bad.tsv"), strict=False).count() == 0
    with pytest.raises(Exception, match="without 4 columns"):
        readers.lexicon(spark, str(tmp_path / "bad.tsv")).collect()


def test_page_scans(spark, tmp_path):
    entry = {"box": [[0, 0], [1, 0], [1, 1], [0, 1]], "text": "a", "confidence": 0.5, "tile_index": 1}
    (tmp_path / "page_scan.json").write_text(json.dumps({"metadata": {"source_image": "page_001.png", "windows_scanned": 1}, "windows": [], "entries": [entry, entry]}, indent=1))
    rows = readers.scan_entries(readers.page_scans(spark, str(tmp_path / "page_scan.json"))).orderBy("position").collect()
    assert [(r.position, r.text, r.box[2]) for r in rows] == [(1, "a", [1.0, 1.0]), (2, "a", [1.0, 1.0])]


def test_recognition_of_either_kind(spark, tmp_path):
    line = lambda t: {"line_image": "l.png", "text": t, "segments": [t]}
    models = {"tesseract": {"available": False, "reason": "none"}, "other": {"available": True, "line_results": [line("o")]}, "easyocr": {"available": True, "line_results": [line("x"), line(" "), line("y")]}}
    (tmp_path / "a.json").write_text(json.dumps({"source_image": "p", "models": models}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"entries": [{"box": [[0, 0]], "text": "z", "confidence": 1.0}, {"box": [], "text": " "}]}, indent=1))
    rows = {Path(r.path).name: r.entries for r in readers.recognized_entries(readers.recognition(spark, f"{tmp_path}/*.json")).collect()}
    assert [(e.text, e.line_index) for e in rows["a.json"]] == [("x", 1), ("y", 3)]
    assert [(e.text, e.line_index, e.box) for e in rows["b.json"]] == [("z", None, [[0.0, 0.0]])]
    (tmp_path / "c.json").write_text(json.dumps({"models": {"tesseract": {"available": False}}}))
    with pytest.raises(Exception, match="no recognition result"):
        readers.recognized_entries(readers.recognition(spark, f"{tmp_path}/c.json")).collect()
    assert readers.optional_documents(spark, [f"{tmp_path}/none.json"], "a int").count() == 0
    assert readers.optional_documents(spark, [f"{tmp_path}/none.json", f"{tmp_path}/b.json"], "source_image string").count() == 1


def test_zip_stops_at_the_shortest(spark):
    row = spark.sql("select array(array(array(1D))) as b, array('x', 'y') as t, array(0.5D, 0.6D, 0.7D) as s")
    assert [r.text for r in row.select(readers.zipped_result(F.col("b"), F.col("t"), F.col("s")).alias("e")).first().e] == ["x"]


def test_images_and_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "page_012.png").write_bytes(b"x")
    (tmp_path / "other.png").write_bytes(b"y")
    assert [r.page for r in readers.images(spark, str(tmp_path)).collect()] == [12]
    monkeypatch.setenv("B", "env")
    assert readers.settings(["A='1'", "# C=2", "B=3", "junk"], ["A", "B", "C"]) == {"A": "1", "B": "env", "C": None}


def test_writers(spark, tmp_path):
    table = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")
    for kind in ("parquet", "json", "csv", "orc"):
        writers.write_tables({"t": table}, f"{tmp_path}/{kind}", kind)
    assert spark.read.json(f"{tmp_path}/json/t").count() == spark.read.orc(f"{tmp_path}/orc/t").count() == 2
    writers.write_texts(table.filter("t is not null"), f"{tmp_path}/text", "t")
    assert spark.read.text(f"{tmp_path}/text").first().value == "a|b"
    assert "| 1 | a\\|b |" in writers.report("R", {"S": table.orderBy("n")})
    log = spark.createDataFrame([(1, "r", "edited", "x", "", "2024")], "line_index int, reviewer string, verdict string, final_text string, notes string, updated_at string")
    writers.append_annotations(log, f"{tmp_path}/log"), writers.append_annotations(log, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    manifest = spark.createDataFrame([(1, "done"), (2, "failed")], "page int, status string")
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page int")
    assert sorted(r.page for r in writers.unfinished(pages, manifest).collect()) == [2, 3] and writers.unfinished(pages, manifest, overwrite=True).count() == 3


def test_word_lexicon(spark):
    docs = spark.createDataFrame([("The the fox ab",), ("fox cat",)], "text string")
    assert [(r.token, r.n) for r in readers.word_lexicon(docs, 2).orderBy("position").collect()] == [("fox", 2), ("the", 2)]


def run(df, name, mode="complete"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def test_streamed_sessions_equal_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    run(jobs.sessions(stream, "1 hour"), "sessions_out")
    batch = bands.merged(events.select("user_id", F.col("ts").alias("start"), F.col("ts").alias("end")), ["user_id"], F.expr("interval 1 hour - interval 1 microsecond"))
    assert spark.table("sessions_out").groupBy("user_id").count().orderBy("user_id").collect() == batch.groupBy("user_id").count().orderBy("user_id").collect()
    run(jobs.first_seen(stream, ["user_id"], late="3650 days"), "first_out", "append")
    assert spark.table("first_out").count() == events.select("user_id").distinct().count()


def test_packing_skips_what_is_done(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    source = f"{tmp_path}/in"
    docs.filter("doc_id < 50").write.mode("append").parquet(source)
    for wanted in ("doc_id < 50", "doc_id < 100"):
        stream = spark.readStream.schema(docs.schema).parquet(source)
        jobs.pack_new(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").select("doc_id").distinct().count() == docs.filter(wanted).count()
        docs.filter("doc_id >= 50 and doc_id < 100").write.mode("append").parquet(source) if wanted == "doc_id < 50" else None


def test_entry_and_queries(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for name in ("chunk_pack", "window_grid", "sequence_edges", "stream_windows", "graph_edges", "split_kbest"):
        assert queries[name](spark, sf_dir).count() > 0


def test_queries_equal_their_sql(spark, sf_dir):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"create view {path.stem} as select * from '{path}'")
    text = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op") or name == "pipeline":
            continue
        ours = entry.queries()[name](spark, sf_dir)
        columns = sorted(ours.columns)
        theirs = db.sql(sql)
        assert sorted(theirs.columns) == columns, name
        a = sorted(tuple(map(text, r)) for r in ours.select(*columns).collect())
        b = sorted(tuple(map(text, r)) for r in theirs.select(", ".join(f'"{c}"' for c in columns)).fetchall())
        assert a == b, name


def test_empty_lexicon(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("# token\tlemma\tpos\tgloss\n123\ta\tb\tc\n")
    with pytest.raises(ValueError, match="no usable entry"):
        readers.lexicon(spark, str(tmp_path / "l.tsv"))
    assert readers.lexicon(spark, str(tmp_path / "l.tsv"), required=False).count() == 0


def test_nested_results(spark):
    item = '[[[1,2],[3,2],[3,4],[1,4]],["ab",0.5]]'
    rows = spark.createDataFrame([(f"[{item},{item}]",), (f"[[{item}]]",), ("[[[1,2]],3]",), ("none",), (None,)], "r string")
    found = [[(e.box[0], e.text, e.confidence) for e in r.x] for r in rows.select(readers.nested_result(F.col("r")).alias("x")).collect()]
    assert found == [[([1.0, 2.0], "ab", 0.5)] * 2, [([1.0, 2.0], "ab", 0.5)], [], [], []]
