import zipfile

from pyspark.sql import functions as F

from kgloom.operators import corpus as B
from kgloom.sources import documents as D
from kgloom.streaming import documents as SD
from kgloom.streaming import runs as SR

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def write_docx(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


def test_files(spark, rows, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one two \xff")
    (tmp_path / "b.md").write_text("# three")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / "d.txt").write_bytes(b"%PDF-1.7 x")
    write_docx(tmp_path / "e.docx", ["first", "  ", "second"])
    files = D.read_files(spark, str(tmp_path))
    ok, bad = D.route_by_mime(files)
    assert rows(ok.select(F.element_at(F.split("path", "/"), -1))) == [("a.txt",), ("b.md",), ("d.txt",), ("e.docx",)]
    assert bad.count() == 1
    assert rows(D.read_text_documents(spark, str(tmp_path)), "filename", "raw_text", "word_count") == [("a.txt", "one two �", 3), ("b.md", "# three", 2)]
    assert rows(D.read_docx_documents(spark, str(tmp_path)), "filename", "raw_text") == [("e.docx", "first\n\nsecond")]
    assert rows(D.IngesterChain().ingest(files), "filename", "mime_type")[0] == ("a.txt", "text/plain")
    assert D.IngesterChain().ingest(files).count() == 3


def test_ingest_text(spark, rows):
    df = spark.createDataFrame([(" a  b ", None), ("   ", "x"), ("c", "n.txt")], "t string, fn string")
    assert rows(D.ingest_text(df, "t", "fn"), "filename", "raw_text", "word_count") == [("n.txt", "c", 1), ("raw_text", "a  b", 2)]


def gaz(spark):
    return spark.createDataFrame([("acme", "Company", 0.9), ("kubernetes", "Technology", 0.8)], "name string, entity_type string, confidence double")


def test_document_stream_equals_batch(spark, rows, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "id string, filename string, raw_text string, ts timestamp"

    def arrive(data):
        spark.createDataFrame(data, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)

    def drain():
        SD.stream_documents(spark.readStream.schema(schema).parquet(src), gaz(spark), out, ck).awaitTermination()
    arrive([("1", "a", "acme  uses kubernetes", "2024-01-01 00:00:00"), ("2", "b", "nothing here", "2024-01-01 00:00:00")])
    drain()
    arrive([("1", "a", "now only acme", "2024-01-02 00:00:00"), ("1", "a", "older text kubernetes", "2024-01-01 12:00:00"), ("3", "c", "kubernetes", "2024-01-02 00:00:00")])
    drain()
    final = spark.createDataFrame([("1", "a", "now only acme"), ("2", "b", "nothing here"), ("3", "c", "kubernetes")], "id string, filename string, raw_text string")
    want = SD.document_tables(final, gaz(spark))
    for name, cols in [("documents", ["document_id", "raw_text", "word_count"]), ("chunks", ["document_id", "chunk_index", "text"]), ("entities", ["document_id", "name", "id"])]:
        assert rows(SD.current_table(spark, out, name), *cols) == rows(want[name], *cols)
    # a repeated batch overwrites itself
    SD.compact(spark, out, str(tmp_path / "small"))
    assert rows(SD.current_table(spark, str(tmp_path / "small"), "entities"), "document_id", "name") == [("1", "acme"), ("3", "kubernetes")]


def test_new_checkpoint_does_not_overwrite(spark, rows, tmp_path):
    out, schema = str(tmp_path / "out"), "id string, filename string, raw_text string"
    for k, data in enumerate([[("1", "a", "acme"), ("2", "b", "kubernetes")], [("1", "a", "kubernetes")]]):
        src = str(tmp_path / f"in{k}")
        spark.createDataFrame(data, schema).write.parquet(src)
        SD.stream_documents(spark.readStream.schema(schema).parquet(src), gaz(spark), out, str(tmp_path / f"ck{k}")).awaitTermination()
    assert rows(SD.current_table(spark, out, "documents"), "document_id", "raw_text") == [("1", "kubernetes"), ("2", "kubernetes")]


def test_stream_skips_repeated_content(spark, rows, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    df = spark.createDataFrame([("1", "a", "acme", "2024-01-01 00:00:00")] * 3, "id string, filename string, raw_text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(src)
    SD.stream_documents(spark.readStream.schema(df.schema).parquet(src), gaz(spark), out, ck, late="1 day").awaitTermination()
    assert SD.current_table(spark, out, "documents").count() == 1


def test_run_stream_equals_batch(spark, rows, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    events = [(i, i % 5, ["step_start", "step_complete", "run_complete", "step_failed", "run_failed"][(i * 7) % 5], f"s{i % 3}", f"2024-01-01 00:{i:02d}:00", None, None) for i in range(40)]
    df = spark.createDataFrame(events, "event_id long, run_id long, type string, step string, ts string, summary string, error string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.filter("event_id < 25").write.parquet(src)
    SR.monitor_runs(SR.read_run_events(spark, src), out, ck).awaitTermination()
    df.filter("event_id >= 25").write.mode("append").parquet(src)
    SR.monitor_runs(SR.read_run_events(spark, src), out, ck).awaitTermination()
    late = rows(SR.stuck_in_stream(spark.read.parquet(out), "2024-01-01 01:30:00"), "run_id")
    assert late == [(0,), (3,), (4,)] and SR.stuck_in_stream(spark.read.parquet(out), "2024-01-01 00:50:00").count() == 0
    cols = ["run_id", "status", "current_step", "finished"]
    assert rows(SR.latest_status(spark.read.parquet(out)), *cols) == rows(SR.latest_status(SR.stream_run_status(df)), *cols)


RUN_EVENT = "event_id long, run_id long, type string, step string, ts string, summary string, error string"


def put_events(spark, src, data):
    df = spark.createDataFrame([(*d, None, None) for d in data], RUN_EVENT).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.mode("append").parquet(src)


def test_silent_runs_are_told_by_timers(spark, rows, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def drain():
        SR.watch_runs(SR.read_run_events(spark, src), out, ck, minutes=15, late="10 minutes").awaitTermination()
        alerts = spark.read.schema(SR.ALERT_SCHEMA).parquet(out)
        return rows(alerts.select("run_id", "current_step", F.date_format("last_ts", "HH:mm"), F.date_format("stuck_at", "HH:mm")))
    put_events(spark, src, [(1, 1, "step_start", "a", "2024-01-01 00:00:00"), (2, 2, "step_start", "a", "2024-01-01 00:00:00"),
                            (3, 2, "run_complete", None, "2024-01-01 00:01:00"), (4, 3, "step_complete", "a", "2024-01-01 00:02:00"), (5, None, "step_start", "a", "2024-01-01 00:02:00")])
    assert drain() == []
    # an older event of run 3 and a newer one of run 4: the clock of the stream is 00:20 now
    put_events(spark, src, [(0, 3, "step_start", "a", "2024-01-01 00:01:30"), (6, 4, "step_start", "b", "2024-01-01 00:30:00")])
    assert drain() == [(1, "a", "00:00", "00:15"), (3, None, "00:02", "00:17")]
    # run 4 goes on and ends, run 1 comes back and falls silent again: told once more; run 3 is not repeated
    put_events(spark, src, [(7, 4, "run_failed", None, "2024-01-01 00:40:00"), (8, 1, "step_start", "c", "2024-01-01 00:41:00"), (9, 5, "run_complete", None, "2024-01-01 02:00:00")])
    assert drain() == [(1, "a", "00:00", "00:15"), (1, "c", "00:41", "00:56"), (3, None, "00:02", "00:17")]


def test_wall_clock_tells_without_any_event(spark, tmp_path):
    import time
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put_events(spark, src, [(1, 1, "step_start", "a", "2024-01-01 00:00:00"), (2, 2, "run_complete", None, "2024-01-01 00:00:00")])
    stream = SR.watch_runs(SR.read_run_events(spark, src), out, ck, available_now=False, minutes=1 / 60, wall_clock=True)
    try:
        end = time.monotonic() + 60
        while time.monotonic() < end and spark.read.schema(SR.ALERT_SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).isEmpty():
            time.sleep(1)
        assert [r.run_id for r in spark.read.schema(SR.ALERT_SCHEMA).parquet(out).collect()] == [1]
    finally:
        stream.stop()


def test_corpus_build(spark, rows, tmp_path):
    docs = spark.createDataFrame([("1", "a", "today acme uses kubernetes"), ("2", "b", "nothing here"), ("3", "c", None)], "id string, filename string, raw_text string")
    cues = spark.createDataFrame([("uses", "USES", "Company", "Technology", 0.7)], "cue string, relationship_type string, source_type string, target_type string, confidence double")
    t = B.build_corpus(docs, gaz(spark), cues, "2024-01-01 00:00:00")
    runs = {r.document_id: r for r in t["runs"].collect()}
    assert [runs[d].status for d in "123"] == ["completed", "completed", "failed"]
    assert [s.output_summary for s in runs["1"].steps] == ["2 entities extracted", "1 relationships discovered", "Ontology v1: 2 classes, 1 relationships", "2 nodes, 1 edges", "1 chunks embedded"]
    assert [s.output_summary for s in runs["2"].steps] == ["0 entities extracted"] + [B.SKIPPED] * 3 + ["1 chunks embedded"]
    assert runs["3"].error_message == f"entity_extraction: {B.NO_TEXT}; vector_memory: {B.NO_TEXT}"
    B.write_corpus(t, str(tmp_path / "kg"))
    assert rows(spark.read.parquet(str(tmp_path / "kg/edges")), "type") == [("USES",)]


def test_export_leaves_null_statements_out(spark):
    from kgloom.sources import tables
    nodes = spark.createDataFrame([("n 1", None, None), ("n2", "Person", "B")], "id string, label string, name string")
    edges = spark.createDataFrame([("n 1", "n2", None), ("n 1", "n2", "USES")], "src string, tgt string, type string")
    lines = sorted(r.value for r in tables.ntriples(nodes, edges).collect())
    assert lines == sorted(['<urn:kg:node:n%201> <urn:kg:prop:USES> <urn:kg:node:n2> .', '<urn:kg:node:n2> <urn:kg:prop:name> "B" .',
                            '<urn:kg:node:n2> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:kg:type:Person> .'])
    assert sum('"@id":"urn:kg:node:n%201"' in r.value for r in tables.jsonld(nodes, edges).collect()) == 2


def test_damaged_word_file_has_no_text(spark):
    from kgloom.sources import documents
    files = spark.createDataFrame([("/x/a.docx", bytearray(b"PK\x03\x04 no zip"), 12), ("/x/b.docx", bytearray(b""), 0)], "path string, content binary, length long")
    assert [r.raw_text for r in documents.docx_from_files(files).collect()] == [None, None]


def test_files_are_picked_by_name(spark, tmp_path):
    from kgloom.sources import documents
    for name in ("a.txt", "B.TXT", "c.md", "d.bin", "e.docx"):
        (tmp_path / name).write_text("hello")
    assert sorted(r.filename for r in documents.read_text_documents(spark, str(tmp_path)).collect()) == ["B.TXT", "a.txt", "c.md"]


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from kgloom import session
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    frame = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d)))
    with pytest.raises(RuntimeError):
        session.cut_lineage(frame)


def stored_files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_replace_by_key_rewrites_touched_buckets_only(spark, rows, tmp_path):
    from kgloom.sources import tables
    path, schema = tmp_path / "chunks", "document_id string, chunk_index int, text string"
    first = spark.createDataFrame([(f"d{i}", k, f"old {k}") for i in range(40) for k in range(3)] + [(None, 0, "no id")], schema)
    tables.write_by_key(first, str(path), buckets=16)
    assert rows(tables.read_by_key(spark, str(path))) == rows(first)
    before = stored_files(path)
    again = spark.createDataFrame([("d3", 0, "new"), ("d99", 0, "added"), (None, 5, "other")], schema)
    tables.write_by_key(again, str(path), buckets=16)
    want = rows(tables.replace_by_key(first.filter("document_id is not null"), again))
    assert rows(tables.read_by_key(spark, str(path))) == want
    after = stored_files(path)
    kept = {n for n in before if after.get(n) == before[n]}
    buckets = [r.key_bucket for r in spark.read.parquet(str(path)).filter("text in ('new', 'added', 'other')").select("key_bucket").distinct().collect()]
    assert {n.split("/")[0] for n in before if n not in kept} <= {f"key_bucket={b}" for b in buckets}
    assert len(buckets) <= 3 and len({n.split("/")[0] for n in kept}) >= 10
    # a repeated call changes no row, an empty one no file
    tables.write_by_key(again, str(path), buckets=16)
    assert rows(tables.read_by_key(spark, str(path))) == want
    last = stored_files(path)
    tables.write_by_key(again.limit(0), str(path), buckets=16)
    assert stored_files(path) == last


def test_broken_replacement_is_finished(spark, rows, tmp_path, monkeypatch):
    from kgloom.sources import tables
    path, schema = tmp_path / "t", "document_id long, v string"
    tables.write_by_key(spark.createDataFrame([(i, "old") for i in range(20)], schema), str(path), buckets=4)
    monkeypatch.setattr(tables, "_put_in_place", lambda *a: 1 / 0)
    try:
        tables.write_by_key(spark.createDataFrame([(1, "new")], schema), str(path), buckets=4)
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    # part of the buckets is gone already, as when the driver is lost between delete and rename
    gone = spark.read.parquet(str(path)).filter("document_id = 1").first().key_bucket
    import shutil
    shutil.rmtree(path / f"key_bucket={gone}")
    assert tables.finish_write(spark, str(path)) and not tables.finish_write(spark, str(path))
    assert rows(tables.read_by_key(spark, str(path)), "document_id", "v") == sorted([(i, "new" if i == 1 else "old") for i in range(20)], key=repr)


def test_rows_of_one_hot_key_are_replaced(spark, tmp_path):
    from kgloom.sources import tables
    path = str(tmp_path / "hot")
    many = spark.range(30000).select(F.lit("hot").alias("document_id"), F.col("id").alias("v"))
    tables.write_by_key(many, path)
    tables.write_by_key(many.filter("v < 10"), path)
    assert tables.read_by_key(spark, path).count() == 10
    tables.write_by_key(many.limit(0), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0
