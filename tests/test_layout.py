"""The document passes of layout over hand-built lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import layout

SCHEMA = (
    "doc_id string, page int, region_idx int, ord int, text string, size double, base double, top double, bot double, x0 double, x1 double, bold boolean, "
    "gap_max double, col_left double, col_right double, col_width double, in_top boolean, in_bot boolean"
)


def line(ord, text, y, page=1, size=10.0, x0=50.0, x1=248.0, left=50.0, bold=False, region=0, gap=0.1, width=198.0, band=""):
    return ("d", page, region, ord, text, size, float(y), y - 0.86 * size, y + 0.26 * size, x0, x1, bold, gap, left, left + width, width, band == "top", band == "bot")


def made(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def blocks(spark, *rows):
    return [(r.type, r.text, r.furniture) for r in layout.line_blocks(made(spark, *rows)).orderBy("ord").collect()]


def test_paragraphs(spark):
    got = blocks(
        spark, line(0, "A Title In Big Type", 20, size=20.0), line(1, "This is the first line of a para-", 60), line(2, "graph that goes on and", 72),
        line(3, "ends here.", 84, x1=100.0), line(4, "Another one starts at this place and", 96), line(5, "runs over the column", 108),
        line(6, "break into the next.", 60, left=300.0, x0=300.0, x1=400.0), line(7, "Figure 1. A caption", 84, left=300.0, x0=300.0, x1=400.0),
    )
    assert got == [
        ("heading", "A Title In Big Type", None), ("para", "This is the first line of a paragraph that goes on and ends here.", None),
        ("para", "Another one starts at this place and runs over the column break into the next.", None), ("caption", "Figure 1. A caption", None),
    ]


def test_tables_and_runs(spark):
    prose = [line(k, f"Prose line number {k} which fills the whole of the measure and goes", 20 + 12 * k) for k in range(8)]
    table = [line(10, "Table 1. Patients at baseline", 200, size=8.0, region=1, x1=180.0), line(11, "Age 61 62", 216, size=8.0, region=2, gap=4.0, x1=180.0),
             line(12, "Sex 1 2", 232, size=8.0, region=2, gap=4.0, x1=150.0), line(13, "Numbers are means.", 248, size=8.0, region=3, x1=170.0),
             line(14, "Body text again after the table has ended here.", 280, region=4)]
    got = blocks(spark, *prose, *table)
    assert [(t, f) for t, _, f in got][1:] == [("caption", None), ("para", "table"), ("para", "table"), ("para", "table"), ("para", None)]


def test_running_heads(spark):
    rows = [line(3 * p, f"Journal of things {p}", 10, page=p, band="top") for p in range(1, 5)] + [line(3 * p + 1, f"Text of page {p}", 100, page=p) for p in range(1, 5)]
    rows += [line(3 * p + 2, str(p), 740, page=p, band="bot") for p in range(1, 5)] + [line(50, "One of its kind", 12, page=2, band="top")]
    pages = spark.createDataFrame([("d", 4)], "doc_id string, n_pages int")
    got = layout.strip_running_heads(made(spark, *rows), pages).orderBy("ord").collect()
    assert [r.text for r in got] == [*(f"Text of page {p}" for p in range(1, 5)), "One of its kind"]
    two = layout.strip_running_heads(made(spark, *rows[:2], line(9, "12", 740, band="bot")), spark.createDataFrame([("d", 1)], pages.schema))
    assert two.count() == 2


def test_titles_and_scans(spark):
    rows = [("d", 0, "heading", 1, 22.0, "The Journal"), ("d", 1, "heading", 1, 18.0, "A trial of many things in a good many people"), ("d", 2, "para", 1, 10.0, "Body text. " * 30), ("e", 0, "para", 1, 10.0, "Too short")]
    frame = spark.createDataFrame(rows, "doc_id string, ord int, type string, page int, size double, text string")
    assert {r.doc_id: r.title for r in layout.choose_titles(frame).collect()} == {"d": rows[1][5], "e": None}
    geometry = spark.createDataFrame([("d", p, 567.0, 756.0) for p in (1, 2, 3)], "doc_id string, page int, width double, height double")
    r = layout.needs_ocr(made(spark, line(0, "x" * 500, 10)), geometry).head()
    assert (r.n_pages, r.n_scanned, r.needs_ocr) == (3, 2, True)


def test_word_atoms(spark):
    words = spark.createDataFrame([("d", 1, 0, "kept", 40.0, 0.0, 0.0, 30.0, 10.0), ("d", 1, 1, "lost", 39.0, 0.0, 0.0, 30.0, 10.0), ("d", 1, 2, " ", 90.0, 0.0, 0.0, 3.0, 1.0)],
                                  "doc_id string, page int, ord int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    got = layout.word_atoms(words.withColumns({"bold": F.lit(False), "italic": F.lit(False)}), 2.0).collect()
    assert [(r.text, r.base, r.size) for r in got] == [("kept", 4.0, 3.9000000000000004)]
