"""Web pages, archives and the kinds of files."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import queries
from quillspark.sources import files, html, ingest

PAGE = """<html><head><title>A study of things | Journal site</title><meta name="citation_author" content="A One"><meta name="citation_author" content="B Two"></head>
<body><nav><p>Menu entry that is long enough to be found</p></nav><script>var x = "</p>";</script><article><h1>A study of things</h1>
<p>First paragraph, with <b>bold text, that is long enough.<p>Second one; also rather long, with words.</p><ul><li>an item</li></ul>
<figure><figcaption>Figure 1 shows it</figcaption></figure><table><tr><td>short</td></tr></table></article><div class="ad"><p>Buy, buy, buy this thing now, please.</p></div></body></html>"""


def test_page():
    meta, blocks = html.extract(PAGE, "https://x.org/a")
    assert meta["title"] == "A study of things" and meta["author"] == "A One, B Two"
    assert [b[0] for b in blocks] == ["para", "para", "para", "caption"]
    assert blocks[2][1] == "• an item" and all("Buy" not in b[1] and "Menu" not in b[1] for b in blocks)
    assert html.extract(None)[1] == [] and html.extract("")[0]["title"] == "Web page"


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t><w:tab/><w:t>end</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Title', 'Top')}{p('Heading3', 'Part')}{p('Normal', 'Text')}</w:body></w:document>")
    return out.getvalue()


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package><metadata><title>Book</title></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/>'
                   '<item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("OPS/a.xhtml", "<html><body><h1>A</h1><p>Last.</p></body></html>")
        z.writestr("OPS/b.xhtml", "<html><body><p>First.</p></body></html>")
    return out.getvalue()


def extracted(spark, rows):
    frame = spark.createDataFrame([(p, n, bytearray(c)) for p, c, n in rows], "doc_id string, name string, content binary")
    return {r.doc_id: r for r in ingest.extract_files(frame).collect()}


def test_archives(spark):
    rows = [("1", docx(), "a.docx"), ("2", epub(), "b"), ("3", b"PK\x03\x04broken", "c.zip"), ("4", b"%PDF-1", "d"), ("5", b"<!doctype html><p>x", "e"), ("6", b"plain", "f.txt")]
    frame = spark.createDataFrame([(p, bytearray(c), n) for p, c, n in rows], "path string, content binary, name string")
    frame = frame.withColumn("kind", files.sniff(F.col("content"), F.col("name")))
    assert [r.kind for r in frame.orderBy("path").collect()] == ["docx", "epub", "zip", "pdf", "html", "text"]
    assert [r.l for r in frame.orderBy("path").select(files.kind_label(F.col("kind")).alias("l")).collect()][:2] == ["DOCX", "EPUB"]
    got = extracted(spark, rows)
    assert [(b.type, b.text, b.level) for b in got["1"].blocks] == [("heading", "Top end", 1), ("heading", "Part end", 2), ("para", "Text end", None)]
    assert [b.text for b in got["2"].blocks] == ["First.", "A", "Last."] and got["2"].title == "Book"
    assert got["3"].error and not got["3"].blocks


def test_no_file_ends_the_job(spark):
    """A damaged stream, an encrypted entry and very deep markup: each is an error of its own file, or is read."""
    whole = docx()
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        squeezed = io.BytesIO()
        with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as out:
            out.writestr("word/document.xml", z.read("word/document.xml") * 1)
    damaged = bytearray(squeezed.getvalue())
    start = damaged.index(b"word/document.xml") + len("word/document.xml")
    damaged[start : start + 40] = b"\xff" * 40
    locked = bytearray(whole)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + at] |= 1
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    deep = io.BytesIO()
    with zipfile.ZipFile(deep, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p>{'<w:r>' * 5000}<w:t>Words</w:t>{'</w:r>' * 5000}</w:p></w:body></w:document>")
    got = extracted(spark, [("good", whole, "a.docx"), ("damaged", bytes(damaged), "b.docx"), ("locked", bytes(locked), "c.docx"), ("deep", deep.getvalue(), "d.docx")])
    assert [b.text for b in got["good"].blocks][:1] == ["Top end"] and [b.text for b in got["deep"].blocks] == ["Words"]
    assert got["damaged"].error.startswith("unreadable") and got["locked"].error.startswith("unreadable: RuntimeError")


def test_what_inflates_too_far_is_an_error(monkeypatch):
    monkeypatch.setattr(files, "MOST_INFLATED", 1000)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 1001)
        z.writestr("b", "y" * 900)
    archive = files.Archive(out.getvalue())
    assert len(archive.read("b")) == 900
    with pytest.raises(ValueError):
        archive.read("a")


def test_every_query_runs(spark):
    for name, query in queries.QUERIES.items():
        assert query(spark, "/root/testdata/sf0.001").limit(5).count() >= 0, name
    assert set(queries.ORACLE) <= set(queries.QUERIES)
