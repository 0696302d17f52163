"""Ingestion of all kinds, the library, navigation over it, and streams."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import layout, navigation, store
from quillspark.queries import cases
from quillspark.sources import html, ingest, positioned
from quillspark.streaming import progress

NOW = datetime.datetime(2024, 5, 20, 12)


def test_import_and_reextraction(spark):
    files = cases.sample_files(spark)
    extracted = ingest.extract_files(files).cache()
    tables = ingest.imported(extracted, files, F.lit(NOW))
    assert {r.doc_id for r in tables["docs"].collect()} == {"docx", "epub", "html", "text"}
    assert {r.doc_id: r.error.split(":")[0] for r in tables["failed"].collect()} == {
        "broken": "unreadable", "pdf": ingest.UNPLACED, "image": ingest.UNPLACED, "empty": ingest.NO_TEXT, "other": ingest.NO_TEXT}
    assert tables["files"].count() == 4 and {r.text for r in ingest.block_rows(tables["content"]).collect()} >= {"Top of it", "First chapter.", "Second part."}
    placed = ingest.extract_positioned(*positioned.extract_runs(*cases.runs(spark)))
    old = spark.createDataFrame([("p", "Old title", False, True, 3, 1), ("q", "Other", False, False, 1, 1)], "doc_id string, title string, ocr boolean, needs_ocr boolean, words int, minutes int")
    stored = spark.createDataFrame([("p", [])], f"doc_id string, blocks array<{ingest.BLOCK}>")
    new = ingest.reextracted({"docs": old, "content": stored, "progress": old.select("doc_id")}, placed)
    got = {r.doc_id: r for r in new["docs"].collect()}
    assert got["p"].title == cases.RUNS[0][0] and not got["p"].needs_ocr and got["p"].words > 30 and got["q"].title == "Other" and new["progress"].count() == 2
    assert new["content"].filter("size(blocks) = 2").count() == 1


def test_recognised_pages(spark):
    word = lambda k, t, y, conf=90.0: (t, conf, (50.0 + 60 * (k % 5), y, 100.0 + 60 * (k % 5), y + 12.0), False, False)
    kind = "struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>,is_bold:boolean,is_italic:boolean>"
    words = [word(k, f"word{k}", 50.0 + 14 * (k // 5)) for k in range(20)] + [word(0, "dim", 400.0, 10.0)]
    pages = spark.createDataFrame([("a", 1, [([([(words,)],)],)], []), ("b", 1, [], words)], f"doc_id string, page int, blocks array<struct<paragraphs:array<struct<lines:array<struct<words:array<{kind}>>>>>>>, words array<{kind}>")
    geometry = spark.createDataFrame([("a", 1, 567.0, 756.0), ("b", 1, 567.0, 756.0)], "doc_id string, page int, width double, height double")
    x = ingest.extract_positioned(*positioned.extract_recognised(pages, geometry, image=True), kind="image", ocr=True).collect()
    assert len(x) == 2 and all(r.ocr and r.blocks[0].text.startswith("word0 word1") and "dim" not in r.blocks[-1].text and r.title == r.blocks[0].text[:120] for r in x)


def test_addresses(spark):
    rows = [("a", "https://x.org/p/a%20b", b"%PDF", "application/pdf"), ("b", "ftp://x.org/c", b"", None), ("c", "http://x.org", b"", "text/html"), ("d", "not an address", b"", None)]
    got = {r.doc_id: r for r in ingest.url_files(spark.createDataFrame([(a, b, bytearray(c), d) for a, b, c, d in rows], "doc_id string, url string, content binary, mime string")).collect()}
    assert got["a"].name == "a b.pdf" and got["a"].host == "x.org" and got["a"].error is None and got["c"].name == "page" and got["b"].error and got["d"].error


def test_shelf(spark):
    at = [NOW - datetime.timedelta(hours=h) for h in (1, 30, 80, 24 * 9)]
    rows = [("a", "A, B", 0, 0, at[0]), ("b", "C", 59, 1023, at[1]), ("c", None, 60, 1536, at[2]), ("d", "D", 125, 3 << 20, at[3])]
    docs = spark.createDataFrame(rows, "doc_id string, author string, minutes int, bytes long, added_at timestamp")
    got = store.shelf(docs, spark.createDataFrame([("b", 1, 3)], "doc_id string, index int, total int"), F.lit(NOW)).collect()
    assert [(r.doc_id, r.by, r.length, r.when, r.size) for r in got] == [
        ("a", "A et al.", "", "Today", ""), ("b", "C", "59 min listen", "Yesterday", "1023 B"), ("c", None, "1 h listen", "3 days ago", "2 KB"), ("d", "D", "2 h 5 min listen", "May 11", "3.0 MB")]
    assert round(got[1].percent, 2) == 33.33 and got[0].percent is None
    title = spark.createDataFrame([("  A   b ",), ("x" * 201,), ("ab",), (None,)], "t string").select(store.clean_title(F.coalesce("t", F.lit("")), F.lit("name")).alias("t"))
    assert [r.t for r in title.collect()] == ["A b", "x" * 197 + "…", "name", "name"]


def test_audio_plan_renders_each_text_once(spark):
    s = spark.createDataFrame([("d", k, t, False) for k, t in enumerate(["One.", "Two.", "One."])], "doc_id string, i int, speak string, skip boolean")
    plan = navigation.audio_plan(s)
    assert plan.count() == 2 and plan.select("key").distinct().count() == 2
    long = spark.createDataFrame([("d", 0, "word " * 40_000, False)], s.schema)
    assert len(navigation.audio_plan(long).head().key) > 10


def test_running_head_predicate(spark):
    lines = ["12", "xiv", "Page 3 of 9", "Downloaded from a site", "© 2020 Them", "3 May 2021", "https://x.org/a", "Elsevier Ltd", "A line of prose"]
    frame = spark.createDataFrame([("d", 1, k, t, True, False) for k, t in enumerate(lines)], "doc_id string, page int, ord int, text string, in_top boolean, in_bot boolean")
    assert [r.text for r in layout.strip_running_heads(frame, spark.createDataFrame([("d", 1)], "doc_id string, n_pages int")).collect()] == ["A line of prose"]


def test_deep_pages_are_read_once():
    deep = "<div>" * 3000 + "<p>" + "Some text, and more of it; " * 20 + "</p>" + "</div>" * 3000
    meta, blocks = html.extract(deep)
    assert len(blocks) == 1 and html.html_text("<p>a<script>x</script> b</p><nav>c</nav>") == "a b"
    for text in (("a ", " b"), ("", " "), (" ", "x"), ("x", ""), ("a", "b"), (" a", "\n")):
        assert html._beside(html._shape(text[0]), html._shape(text[1]))[0] == html._shape("".join(text))[0]


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")


def test_stream_of_positions(spark, folders):
    source, out, state = folders
    schema = "user_id long, ts timestamp, event_id long, value double"
    at = lambda m: NOW + datetime.timedelta(minutes=m)
    for rows in ([(1, at(0), 1, 5.0), (2, at(1), 2, 7.0)], [(1, at(5), 3, 9.0), (1, at(3), 4, 8.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        progress.save_positions(spark.readStream.schema(schema).parquet(source), out, state).awaitTermination()
    assert {r.user_id: r.position for r in progress.positions(spark, out).collect()} == {1: 9.0, 2: 7.0}
    daily = progress.latest_positions(spark.readStream.schema(schema).parquet(source))
    query = daily.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.user_id: r.position for r in spark.table("daily").collect()} == {1: 9.0, 2: 7.0}


def test_debounced_positions(spark, folders):
    """A timer that each event of a user sets anew, as one reads it, over a table and over a stream in two batches."""
    source, out, state = folders
    schema, rng, rows = "user_id long, ts timestamp, event_id long, event_type string, value double", random.Random(3), []
    for user in range(12):
        at = 0
        for k in range(40):
            at += rng.choice([200, 700, 1400, 1600, 5000])
            rows.append((user, NOW + datetime.timedelta(milliseconds=at), user * 100 + k, rng.choice(["play", "play", "pause"]), float(k)))
    want = set()
    for user in range(12):
        own = [r for r in rows if r[0] == user]
        for r, after in zip(own, [*own[1:], None]):
            if r[3] == "pause" or after is None or (after[1] - r[1]).total_seconds() > 1.5:
                want.add((user, r[2], r[1] if r[3] == "pause" else r[1] + datetime.timedelta(milliseconds=1500)))
    frame = spark.createDataFrame(rows, schema)
    assert {(r.user_id, r.event_id, r.written_at) for r in progress.debounced(frame).collect()} == want
    frame.coalesce(1).write.parquet(source)
    progress.save_debounced(spark.readStream.schema(schema).parquet(source), out, state).awaitTermination()
    # An event a day later lets the last waits of the stream end.
    spark.createDataFrame([(99, NOW + datetime.timedelta(days=1), 9999, "pause", 0.0)], schema).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        progress.save_debounced(spark.readStream.schema(schema).parquet(source), out, state).awaitTermination()
    got = [(r.user_id, r.event_id, r.written_at) for r in spark.read.parquet(out).collect() if r.user_id != 99]
    assert len(got) == len(set(got)) and set(got) == want


def test_stream_of_files(spark, folders, tmp_path):
    source, out, state = folders
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text(f"# Head {k}\n\nText of file {k}.")
        progress.import_texts(spark, source, out, state).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["Head 0", "Head 1", "Text of file 0.", "Text of file 1."]


def test_stream_of_files_of_all_kinds(spark, folders, tmp_path):
    source, out, state = folders
    (tmp_path / "in").mkdir()
    given = [("a.txt", b"# Head\n\nText of a file."), ("b.html", cases.PAGE.encode()), ("c.zip", b"PK\x03\x04broken"), ("again.txt", b"# Head\n\nText of a file.")]
    for name, content in given:
        (tmp_path / "in" / name).write_bytes(content)
        progress.import_files(spark, source, out, state).awaitTermination()
    docs = {r.title: r for r in progress.imported_table(spark, out, "docs").collect()}
    assert set(docs) == {"a", "A study of things"} and docs["a"].words == 5
    assert [len(r.blocks) for r in progress.imported_table(spark, out, "content").collect()] == [2, 2]
    assert [r.error for r in progress.imported_table(spark, out, "failed").collect()][0].startswith("unreadable")


def test_stream_of_sentences_to_render(spark, folders):
    source, _, _ = folders
    schema = "doc_id long, i long, speak string, skip boolean, ts timestamp"
    rows = [(1, 0, "One text.", False, NOW), (1, 1, "Other text.", False, NOW), (1, 2, "One text.", False, NOW), (1, 3, "Skipped.", True, NOW), (2, 0, "One text.", False, NOW)]
    spark.createDataFrame(rows, schema).write.parquet(source)
    done = navigation.audio_plan(spark.createDataFrame(rows, schema).filter("i = 1"))
    plan = progress.render_plan(spark.readStream.schema(schema).parquet(source).withWatermark("ts", "1 minute"), done)
    plan.writeStream.format("memory").queryName("render").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.doc_id, r.speak) for r in spark.table("render").collect()) == [(1, "One text."), (2, "One text.")]
