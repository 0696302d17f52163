"""Queries that splice written cases into the rows of the tables: each row takes the case that its id deals to it, together with
words of its own, and SQL puts the same words into the rows that must come out of the case.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout
from ..operators.segment import sentences
from ..operators.text_blocks import text_blocks, text_documents, titles
from ..plans import script
from ..sources import files, ingest, positioned
from ..tables import spread

SPOKEN = [
    ("mg/dL", "milligrams per deciliter"), ("95% CI 1.2–3.4", "95 percent confidence interval 1.2 to 3.4"), ("p < 0.05", "p less than 0.05"),
    ("HbA1c", "hemoglobin A one C"), ("500 mg BID", "500 milligrams twice daily"), ("8× deeper", "8 times deeper"), ("112×112", "112 by 112"),
    ("Fig. 3", "Figure 3"), ("et al.", "and colleagues"), ("phase II and Phase III", "phase two and Phase III"), ("37°C or 37 °C", "37 degrees Celsius or 37 °C"),
    ("5µg/mL", "5micrograms per milliliter"), ("2020-01-05", "2020 to 01 to 05"), ("HR = 0.68, HR alone", "hazard ratio = 0.68, HR alone"), ("plain words", "plain words"),
    ("low/mid/high and/or on/off", "low mid high and or on or off"), ("approximately approx. 5", "approximately approximately 5"), ("3 hrs, 5 min", "3 hours, 5 minutes"),
    ("an RCT in the ICU", "an randomised controlled trial in the intensive care unit"), ("IL-6 and TNF", "interleukin 6 and tumour necrosis factor"),
]
CITED = [
    ("It works [12, 15] well (Smith et al., 2019).", "It works well."), ("Kept (p = 0.03) and (95% CI 1.2–3.4).", "Kept (p = 0.03) and (95% CI 1.2–3.4)."),
    ("A phrase (in ordinary words from 1999 onwards here) stays.", "A phrase (in ordinary words from 1999 onwards here) stays."),
    ("Shown before, Jones and Brown (2004).", "Shown before."), ("See (reviewed in Adams & Cole, 2010; Dove, 2011) there.", "See there."), ("Range [1–3] of [a] kind", "Range of [a] kind"),
]
NORMAL = [
    ("Ko ¨ tter", "Kötter"), ("ﬁne “quotes” – a…", 'fine "quotes", a...'), ("soft­hyphen x", "softhyphen x"), ("  a \n b  ", "a b"), ("5 − 3", "5 - 3"),
    ("e ´ t ` e", "ét̀e"), ("na¨ ıve", "näıve"), ("x ¨ 2", "ẍ2"),
]
SPLIT = [
    ("Smith et al. showed p < 0.05. See Fig. 3 for this. E. coli grew! On Jan. 5 it ended.", "Smith et al. showed p < 0.05.|See Fig. 3 for this.|E. coli grew!|On Jan. 5 it ended."),
    ("Table 1. Baseline characteristics.", "Table 1. Baseline characteristics."), ("He has a Ph.D. in 2010. Done", "He has a Ph.D. in 2010.|Done"), ("", ""),
    ("What?! He said \"No.\" (Really.) Then… he left... Now", "What?!|He said \"No.\" (Really.) Then… he left...|Now"), ("1. First item. Second one.", "1. First item.|Second one."),
    ("2.1. Methods are here. 40 mg. 30 patients", "2.1. Methods are here.|40 mg. 30 patients"), ("Dr. A. B. Cole vs. the U.S. Army in approx. 5 min. It ended.", "Dr. A. B. Cole vs. the U.S. Army in approx. 5 min. It ended."),
    ("no capital. after the stop.Next has none", "no capital. after the stop.|Next has none"), ("Es war so. Über alles.", "Es war so. Über alles."), ("• One. • Two.", "• One.|• Two."),
    ("Supplementary Table 3. Values of all.", "Supplementary Table 3. Values of all."),
    (" ".join(["word"] * 58) + " end; " + " ".join(["more"] * 20), " ".join(["word"] * 58) + " end;|" + " ".join(["more"] * 20)),
    (" ".join(["word"] * 40) + "; " + " ".join(["more"] * 40), " ".join(["word"] * 40) + ";|" + " ".join(["more"] * 40)),
    ("x" * 650, "x" * 300 + "|" + "x" * 300 + "|" + "x" * 50),
]
MARKDOWN = (
    "# A first heading\n\nHere is one sentence. Here is another one [4].\n\nMETHODS\n\nWe gave 5 mg of the drug to every patient.\nThen everyone waited.\n\nFigure 1. What was seen\n\n- an item of the list\n  goes on\n\n"
    "References\n\nSmith, AB. A study of things. Lancet 2019; 12: 33-40.\n\n## Appendix\n\nMore of it here."
)
SCRIPT = [
    (0, 0, "heading", "body", "A first heading", "A first heading", False, 550), (1, 1, "para", "body", "A first heading", "Here is one sentence.", False, 0),
    (2, 1, "para", "body", "A first heading", "Here is another one.", False, 0), (3, 2, "heading", "body", "METHODS", "METHODS", False, 550),
    (4, 3, "para", "body", "METHODS", "We gave 5 milligrams of the drug to every patient.", False, 0), (5, 3, "para", "body", "METHODS", "Then everyone waited.", False, 0),
    (6, 4, "caption", "body", "METHODS", "Figure 1. What was seen", False, 0), (7, 5, "para", "body", "METHODS", "• an item of the list goes on", False, 0),
    (8, 6, "heading", "references", "References", "References", True, 550), (9, 7, "para", "references", "References", "Smith, AB.", True, 0),
    (10, 7, "para", "references", "References", "A study of things.", True, 0), (11, 7, "para", "references", "References", "Lancet 2019; 12: 33 to 40.", True, 0),
    (12, 8, "heading", "backmatter", "Appendix", "Appendix", True, 550), (13, 9, "para", "backmatter", "Appendix", "More of it here.", True, 0),
]
OUTLINE = [(0, "A first heading", 1, 0, "body"), (1, "METHODS", 2, 3, "body"), (2, "References", 2, 8, "references"), (3, "Appendix", 1, 12, "backmatter")]
PAGE = (
    "<html><head><title>A study of things | Journal site</title><meta name='citation_author' content='A One'></head><body><nav><p>Menu entry long enough to be found</p></nav>"
    "<article><h1>A study of things</h1><p>First paragraph, with some text that is long enough.<p>Second one; also rather long, with words.</p></article></body></html>"
)


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: Three words of each document, without those that are notation; a document with fewer takes these.
_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FEW = "no such words"


def _dealt(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """doc_id, three words of the document, the number of its case."""
    found = F.regexp_extract_all(F.expr(_SMALL), F.lit("[a-z]{3,9}"), F.lit(0))
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", found.alias("w"))
    return d.select("doc_id", F.when(F.size("w") < 3, FEW).otherwise(F.array_join(F.slice("w", 1, 3), " ")).alias("words"), (F.col("doc_id") % n).cast("int").alias("k"))


def _case(values: list[str], k: str = "k") -> Column:
    return F.get(F.array(*map(F.lit, values)), F.col(k))


def _last(text: str) -> bool:
    """Whether a sentence can follow."""
    return text.endswith((".", "!", "?")) and len(text) < 200


def sentence_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the cases with a sentence of the document's words behind them, cut at the usual limit."""
    more = F.when(_case([_last(a) for a, _ in SPLIT]), F.concat(F.lit(" The "), "words", F.lit(" end here."))).otherwise("")
    d = _dealt(spark, sf_dir, len(SPLIT)).select("doc_id", F.concat(_case([a for a, _ in SPLIT]), more).alias("text"))
    return d.select("doc_id", F.array_join(sentences(F.col("text")), "|").alias("result"))


def limit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each document as one sentence, cut at spaces within 60 characters: how many parts, and the longest and the
    whole of them."""
    words = F.regexp_extract_all(F.expr(_SMALL), F.lit("[a-z]{1,20}"), F.lit(0))
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.array_join(words, " ").alias("text"))
    d = d.select("doc_id", sentences(F.col("text"), 60).alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), (F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)) <= 60).alias("within"), F.sha2(F.array_join("s", " "), 256).alias("digest"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.lit(MARKDOWN), F.lit("Here is one sentence."), F.concat(F.lit("Here is one "), "words", F.lit(" sentence.")))
    return script.zone_documents(text_documents(_dealt(spark, sf_dir, 1).select("doc_id", text.alias("text"))))


def script_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.build_sentences(_markdown(spark, sf_dir)).select("doc_id", "i", "block_idx", "type", "zone", "section", "speak", "skip", "pause_before")


def outline_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.outline(_markdown(spark, sf_dir)).select("doc_id", "ord", "title", "level", "sentence_index", "zone")


def _zipped(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def sample_files(spark: SparkSession) -> DataFrame:
    """A file of each kind."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = {"word/document.xml": f"<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Top of it</w:t></w:r></w:p><w:p><w:r><w:t>Words.</w:t></w:r></w:p></w:body></w:document>"}
    epub = {
        "mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
        # Not well-formed: the ampersand.
        "OPS/p.opf": '<package><metadata><dc:title>Book & more</dc:title></metadata><manifest><item id="a" href="./.text/a.xhtml" media-type="application/xhtml+xml"/></manifest>'
                     '<spine><itemref idref="a"/></spine></package>',
        "OPS/.text/a.xhtml": "<html><body><h1>One</h1><p>First <b>chapter.<p>Second part.</body></html>",
    }
    rows = [
        ("docx", "letter.docx", _zipped(docx)), ("epub", "book", _zipped(epub)), ("html", "page", PAGE.encode()), ("broken", "c.zip", b"PK\x03\x04broken"), ("pdf", "d", b"%PDF-1"),
        ("text", "My notes.txt", b"\xef\xbb\xbf" + MARKDOWN.encode() + b"\xff"), ("image", "e", b"\x89PNG"), ("empty", "nothing.txt", b""), ("other", "f.zip", _zipped({"a.txt": "x"})),
    ]
    return _frame(spark, [(a, b, bytearray(c)) for a, b, c in rows], "doc_id string, name string, content binary")


FILES = [
    ("docx", "docx", "DOCX", "Top of it", 2, None), ("epub", "epub", "EPUB", "Book & more", 3, None), ("html", "html", "WEB", "A study of things", 2, None), ("broken", "zip", "ZIP", None, 0, "unreadable"),
    ("pdf", "pdf", "PDF", None, 0, "needs its"), ("text", "text", "TXT", "My notes", 10, None), ("image", "image", "IMG", None, 0, "needs its"), ("empty", "text", "TXT", "nothing", 0, None),
    ("other", "text", "TXT", None, 0, None),
]


def dealt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: one of the samples, a text file with the document's words in place of the sample's title."""
    d, samples = _dealt(spark, sf_dir, len(FILES)), sample_files(spark).collect()
    made = F.broadcast(spark.createDataFrame([(k, r.doc_id, r.name, r.content) for k, r in enumerate(samples)], "k int, sample string, name string, content binary"))
    title = F.replace(F.decode(F.col("content"), "ISO-8859-1"), F.lit("A first heading"), "words")
    own = F.when(F.col("sample") == "text", F.encode(title, "ISO-8859-1")).otherwise(F.col("content"))
    return d.join(made, "k").select(F.col("doc_id").cast("string").alias("doc_id"), "sample", "name", own.alias("content"))


def file_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = dealt_files(spark, sf_dir)
    x = ingest.extract_files(f.drop("sample")).join(f.select("doc_id", "sample"), "doc_id")
    return x.select(F.col("doc_id").cast("long").alias("doc_id"), "sample", "kind", files.kind_label(F.col("kind")).alias("label"), "title", F.size("blocks").alias("n_blocks"), F.regexp_extract("error", "^(unreadable|needs its)", 1).alias("error"))


LIBRARY = [
    ("docx", "Top of it", "DOCX", 4, "letter.docx"), ("epub", "Book & more", "EPUB", 4, "book"), ("html", "A study of things", "WEB", 16, "page"), ("text", "My notes", "TXT", 39, "My notes.txt"),
]


def library_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dealt_files(spark, sf_dir).drop("sample")
    docs = ingest.imported(ingest.extract_files(kept), kept, F.lit("2024-01-01"))["docs"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "kind_label", "words", "source")


PASTED = [
    ("a", "<p>A paragraph of markup that is pasted.</p><p>And one more of them.</p>", None, "html", "Web page", 2), ("b", "Plain text that is pasted in.\n\nTwo paragraphs of it.", None, "text", "Plain text that is pasted in.", 2),
    ("c", "<not really markup at all>", "Given", "text", "Given", 1), ("d", "too short", "x", "text", None, 0), ("e", "# Heading of it\n\nand its text", "", "text", "Heading of it", 2),
]


def pasted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted texts, those that are long enough with a last paragraph of the document's words."""
    d = _dealt(spark, sf_dir, len(PASTED))
    more = F.when(F.col("k") == 0, F.concat(F.lit("<p>The "), "words", F.lit(" end here.</p>"))).when(_case([len(p[1]) >= 20 for p in PASTED]), F.concat(F.lit("\n\nThe "), "words", F.lit(" end here."))).otherwise("")
    rows = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(_case([p[1] for p in PASTED]), more).alias("text"), _case([p[2] for p in PASTED]).alias("title"))
    return ingest.extract_pasted(rows).select(F.col("doc_id").cast("long").alias("doc_id"), "kind", "title", F.size("blocks").alias("n_blocks"), F.when(F.size("blocks") > 0, F.try_element_at("blocks", F.lit(-1))["text"]).alias("last"))


#: Runs of a page: text, x, baseline, size, font, angle.
RUNS = [
    ("A Title Set In Large Type Here", 50, 40, 20, "Serif-Bold", 0.0), ("Margin stamp", 20, 300, 10, "Serif", 1.57), ("Tiny", 50, 60, 0.5, "Serif", 0.0), (" ", 50, 70, 10, "Serif", 0.0),
    *((f"line number {k} of the paragraph that runs over the whole", 50, 100 + 12 * k, 10, "Serif", 0.0) for k in range(5)), ("of the column and ends here.", 50, 160, 10, "Serif", 0.0),
]
INFO = [("p", "untitled.indd", "K&#x00F6;tter &amp; S&#246;hne")]


def runs(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, geometry and info of a page."""
    rows = [("p", 1, k, t, size, 0.3 * size if turn else 0.0, 0.0, float(size), float(x), float(y), None, font, None, None, None) for k, (t, x, y, size, font, turn) in enumerate(RUNS)]
    made = _frame(spark, [tuple(float(v) if isinstance(v, int) and i > 3 else v for i, v in enumerate(r)) for r in rows],
                  "doc_id string, page int, ord int, text string, a double, b double, c double, d double, e double, f double, width double, font_name string, black boolean, bold boolean, italic boolean")
    return made, _frame(spark, [("p", 1, 567.0, 756.0)], "doc_id string, page int, width double, height double"), _frame(spark, INFO, "doc_id string, title string, author string")


PLACED = [("p", RUNS[0][0], "Kötter & Söhne", 1, 2, " ".join(r[0] for r in RUNS[4:-1]))]


def positioned_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of a page for each document, its words in place of the last run."""
    d = _dealt(spark, sf_dir, 1)
    made, geometry, info = (d.join(F.broadcast(x.drop("doc_id").withColumn("k", F.lit(0))), "k").drop("k") for x in runs(spark))
    last = F.when(F.col("text").startswith("of the column"), F.concat(F.lit("of the "), "words", F.lit(" and ends here."))).otherwise(F.col("text"))
    x = ingest.extract_positioned(*positioned.extract_runs(made.withColumn("text", last).drop("words"), geometry.drop("words"), info.drop("words")))
    return x.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "author", "pages", F.size("blocks").alias("n_blocks"), F.try_element_at("blocks", F.lit(-1))["text"].alias("body"))


ENTITIES = [("a &lt;b&gt; &amp;amp; &quot;c&quot;", 'a <b> &amp; "c"'), ("&#65;&#x1F600;&#x41;", "A\U0001F600A"), ("o&#x308; &#99999999;", "ö &#99999999;"), ("plain", "plain")]


FONTS = [("Times-Bold", None, None, None, True, False), ("Arial_it", None, None, None, False, True), ("x", True, None, True, True, True), ("Bold", None, False, None, False, False), (None, None, None, None, False, False), ("F700 Oblique", None, None, None, True, True)]


def font_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs in the fonts of the cases."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", (F.col("l_partkey") % len(FONTS)).cast("int").alias("k"))
    traits = positioned.font_traits(*[_case([f[c] for f in FONTS]) for c in range(4)])
    counts = {n: F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in traits.items()}
    return x.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), *counts.values())


TITLED = [
    ("d", 0, "heading", 1, 22.0, "The Journal"), ("d", 1, "heading", 1, 18.0, "A trial of many things in a good many people"), ("d", 2, "para", 1, 10.0, "Body text. " * 30), ("e", 0, "para", 1, 10.0, "Too short"),
    ("f", 0, "heading", 1, 10.0, "Abstract of it all that is long"), ("f", 1, "para", 1, 10.0, "A first paragraph of fitting length."),
]


def title_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the cases for each document, its words at the end of those that are long enough for a title."""
    made = F.broadcast(_frame(spark, [(sorted({r[0] for r in TITLED}).index(r[0]), *r[1:]) for r in TITLED], "k int, ord int, type string, page int, size double, text string"))
    x = _dealt(spark, sf_dir, 3).join(made, "k").withColumn("text", F.when(F.length("text").between(25, 100), F.concat_ws(" ", "text", "words")).otherwise(F.col("text")))
    return _dealt(spark, sf_dir, 3).select("doc_id").join(layout.choose_titles(x.drop("words", "k")), "doc_id", "left")


def text_title_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(_case([MARKDOWN, "only text\n\n## Later", "no heading at all"]), F.when(F.col("k") == 0, "").otherwise(F.concat(F.lit(" "), "words")))
    return titles(text_blocks(_dealt(spark, sf_dir, 3).select("doc_id", text.alias("text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sentence_cases, limit_cases, script_cases, outline_cases, file_cases, library_cases, pasted_cases, positioned_cases, font_cases, title_cases,
        text_title_cases,
    )
}


def _sql(x: object) -> str:
    if x is None:
        return "NULL"
    return str(x) if isinstance(x, (bool, int, float)) else "'" + str(x).replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    typed = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", "))
    return f"SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({names})"


def _list(values: list) -> str:
    return "[" + ", ".join(map(_sql, values)) + "]"


def _own(n: int) -> str:
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all({_SMALL}, '[a-z]{{3,9}}') AS w FROM documents),
        d AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN '{FEW}' ELSE array_to_string(w[1:3], ' ') END AS words, doc_id % {n} AS k FROM w)"""


#: A character six times in a row: of what can repeat in words of small letters.
SIX = "|".join(f"{c}{{6}}" for c in "abcdefghijklmnopqrstuvwxyz")
#: Three words that are noise as a heading.
_NOISE = (
    f"(NOT regexp_matches(words, '[aeiouy]') OR len(list_distinct(string_split(words, ' '))) = 1 OR regexp_matches(words, '{SIX}')"
    " OR regexp_matches(words, '^(this article|open access|creative commons) '))"
)


def _crossed(columns: str, rows: list[tuple], replaced: dict[str, str]) -> str:
    """The rows of a case for each document, some columns with its words."""
    names = [c.split()[0] for c in columns.split(", ")]
    return f"{_own(1)} SELECT doc_id, {', '.join(f'{replaced[c]} AS {c}' if c in replaced else c for c in names)} FROM d, ({_values(columns, rows)})"


ORACLE = {
    "sentence_cases": f"{_own(len(SPLIT))} SELECT doc_id, {_list([b for _, b in SPLIT])}[k + 1] || CASE WHEN {_list([_last(a) for a, _ in SPLIT])}[k + 1] THEN '|The ' || words || ' end here.' ELSE '' END AS result FROM d",
    # Each part takes the words that fit; the first part of what is longer than the limit ends at its last space.
    "limit_cases": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_SMALL}, '[a-z]{{1,20}}') AS w FROM documents),
        e AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d),
        c AS (SELECT doc_id, i, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS ends, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1 AS begins FROM e),
        t AS (SELECT doc_id, max(ends) AS total FROM c GROUP BY doc_id),
        r AS (SELECT doc_id, CAST(0 AS HUGEINT) AS at, 1 AS n FROM t UNION ALL
              SELECT r.doc_id, (SELECT min(c.ends) FROM c WHERE c.doc_id = r.doc_id AND c.ends - r.at > 28), n + 1 FROM r JOIN t USING (doc_id) WHERE t.total - 1 - r.at > 60)
        SELECT d.doc_id, CAST(coalesce((SELECT max(n) FROM r WHERE r.doc_id = d.doc_id), 0) AS INT) AS n, true AS within, sha256(array_to_string(w, ' ')) AS digest FROM d""",
    # A paragraph in which a character stands six times in a row is noise.
    "script_cases": _crossed("i INT, block_idx INT, type VARCHAR, zone VARCHAR, section VARCHAR, speak VARCHAR, skip BOOLEAN, pause_before INT", SCRIPT, {"speak": "replace(speak, 'Here is one sentence.', 'Here is one ' || words || ' sentence.')", "skip": f"skip OR (block_idx = 1 AND regexp_matches(words, '{SIX}'))"}),
    "outline_cases": _crossed("ord INT, title VARCHAR, level INT, sentence_index BIGINT, zone VARCHAR", OUTLINE, {}),
    "file_cases": f"""{_own(len(FILES))}
        SELECT doc_id, sample, kind, label, title, n_blocks, error FROM d JOIN ({_values("k INT, sample VARCHAR, kind VARCHAR, label VARCHAR, title VARCHAR, n_blocks INT, error VARCHAR", [(k, *f) for k, f in enumerate(FILES)])}) USING (k)""",
    # The title of the text sample gave way to three words, as many as it had; those of a title that is noise don't count, and none do after one of back matter.
    "library_cases": f"""{_own(len(FILES))}
        SELECT doc_id, title, label AS kind_label, words, source FROM d JOIN ({_values("k INT, title VARCHAR, label VARCHAR, n BIGINT, source VARCHAR", [([f[0] for f in FILES].index(r[0]), *r[1:]) for r in LIBRARY])}) l USING (k)""".replace("label AS kind_label, words,", f"label AS kind_label, CASE WHEN label <> 'TXT' THEN l.n WHEN words IN ('about the author', 'about the authors') THEN 0 WHEN {_NOISE} THEN l.n - 3 ELSE l.n END AS words,"),
    "pasted_cases": f"""{_own(len(PASTED))}
        SELECT doc_id, kind, title, n + more AS n_blocks, CASE WHEN more = 1 THEN 'The ' || words || ' end here.' END AS last
        FROM d JOIN ({_values("k INT, kind VARCHAR, title VARCHAR, n INT, more INT", [(k, *p[3:], int(len(p[1]) >= 20)) for k, p in enumerate(PASTED)])}) USING (k)""",
    "positioned_cases": _crossed("title VARCHAR, author VARCHAR, pages INT, n_blocks INT, body VARCHAR", [p[1:] for p in PLACED], {"body": "body || ' of the ' || words || ' and ends here.'"}),
    "font_cases": f"""
        WITH f AS ({_values("k INT, bold BOOLEAN, italic BOOLEAN", [(k, *f[4:]) for k, f in enumerate(FONTS)])})
        SELECT l_orderkey, count(*) AS n, count(*) FILTER (bold) AS bold, count(*) FILTER (italic) AS italic FROM lineitem JOIN f ON l_partkey % {len(FONTS)} = k GROUP BY l_orderkey""",
    "title_cases": f"{_own(3)} SELECT doc_id, {_list([TITLED[1][5], None, TITLED[5][5]])}[k + 1] || ' ' || words AS title FROM d",
    "text_title_cases": f"{_own(3)} SELECT doc_id, CASE k WHEN 0 THEN 'A first heading' WHEN 1 THEN 'Later ' || words ELSE 'no heading at all ' || words END AS title FROM d",
}
