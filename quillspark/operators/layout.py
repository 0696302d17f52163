"""From positioned lines to blocks: the passes over whole documents, as windows and joins.

Lines: doc_id, page, region_idx, ord (order in the document), text, size, base, top, bot, x0, x1, bold, gap_max (in ems),
col_left, col_right, col_width, in_top, in_bot (in the margin bands of the page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import jvm
from ..functions.text import trimmed

#: The tuning of the layout.
HEAD_SHARE, CELL_GAP, TABLE_LINES, SMALL, OFF_MEASURE, FIGURE_REGIONS, TABLE_RUN = 0.34, 1.5, 0.34, 0.9, 0.15, 3, 0.95
#: The size of headings and of first-level ones against the body, and what parts paragraphs: a step against the
#: usual one, a gap, an indent and a short line before, all but the first in ems.
BIG, FIRST_LEVEL, WIDE_STEP, WIDE_GAP, INDENT, SHORT_LINE = 1.13, 1.35, 1.32, 0.78, 1.1, 2.2
#: Lines of margins that are no text.
JUNK = (
    jvm(r"^\s*\d{1,4}\s*$"), jvm(r"^\s*[ivxlcdm]{1,7}\s*$", True), jvm(r"^page\s+\d+(\s+of\s+\d+)?$", True), jvm(r"downloaded\s+from", True),
    jvm(r"this\s+content\s+downloaded", True), jvm(r"all\s+rights?\s+reserved", True), jvm(r"^\s*(https?://|www\.)\S+\s*$", True),
    jvm(r"^\s*doi:?\s*10\.\d{4,}", True), jvm(r"©\s*\d{4}"), jvm(r"^\s*\d{1,4}\s+[A-Z][a-z]+\s+\d{4}\s*$"),
    jvm(r"jstor|springer nature|elsevier ltd|wolters kluwer", True),
)
#: Words that begin a heading.
NAMED = jvm(
    r"^(abstract|summary|background|introduction|objectives?|aims?|methods?|materials?\s+and\s+methods?|study\s+design|participants?"
    r"|patients?\s+and\s+methods?|statistical\s+analysis|results?|findings?|discussion|conclusions?|limitations?|implications?|references?"
    r"|bibliography|acknowledge?ments?|funding|conflicts?\s+of\s+interest|competing\s+interests?|author\s+contributions?|data\s+availability"
    r"|supplementary(\s+\w+)*|appendix|keywords?|highlights?)\b",
    True,
)
#: How captions, titles of tables and list items begin.
CAPTION = jvm(r"^(fig(ure)?\.?\s*\d|table\s*\d|chart\s*\d|scheme\s*\d|exhibit\s*\d|box\s*\d|supplementary\s+(fig|table))", True)
TABLE_TITLE = jvm(r"^\s*(table|tabla|tableau)\s*\d+\s*[.:)—-]?\s+\S", True)
MARKER = jvm(r"^([•·▪◦‣–—-]|\(?[a-z]\)|\(?\d{1,2}[.)])\s+", True)


def _half(size: Column) -> Column:
    return F.floor(size * 2 + 0.5) / 2


def weighted_mode(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """The value with most characters in each document; of equal ones the first seen."""
    sums = lines.groupBy("doc_id", value.alias(name)).agg(F.sum(F.length("text")).alias("w"), F.min("ord").alias("first"))
    return sums.groupBy("doc_id").agg(F.max_by(name, F.struct("w", -F.col("first"))).alias(name))


def running_heads(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Keys of the lines that recur in a margin band over a third of the pages (doc_id, n_pages), and their pages. With fewer
    than three pages there are none."""
    seen = lines.select("doc_id", "page", _band_key().alias("key")).filter("key IS NOT NULL")
    seen = seen.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("n")).join(pages.select("doc_id", "n_pages"), "doc_id")
    often = (F.col("n_pages") >= 3) & (F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") * HEAD_SHARE)))
    return seen.filter(often).select("doc_id", "key", "n")


def _band_key() -> Column:
    """Of a line in a margin band: which one, and its text with digits and signs alike."""
    plain = F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"[^A-Za-z0-9_#]+", " ")
    return F.when(F.col("in_top") | F.col("in_bot"), F.concat(F.when(F.col("in_top"), "T:").otherwise("B:"), F.trim(plain)))


def strip_running_heads(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines without heads and feet: those of :func:`running_heads`, and junk in the margin bands."""
    junk = F.lit(False)
    for pattern in JUNK:
        junk = junk | F.col("text").rlike(pattern)
    x = lines.filter(~((F.col("in_top") | F.col("in_bot")) & junk)).withColumn("_key", _band_key())
    heads = running_heads(lines, pages).select("doc_id", F.col("key").alias("_key"))
    return x.join(heads, ["doc_id", "_key"], "left_anti").drop("_key")


def region_kinds(lines: DataFrame) -> DataFrame:
    """Regions that are furniture: doc_id, page, region_idx, kind (table or figure)."""
    measure = weighted_mode(lines, F.floor(F.coalesce("col_width", F.lit(0.0)) / 4 + 0.5) * 4, "measure")
    body = weighted_mode(lines, _half(F.col("size")), "body")
    g = lines.filter("region_idx IS NOT NULL").groupBy("doc_id", "page", "region_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap_max") >= CELL_GAP).alias("celled"), F.median("size").alias("size"),
        F.min_by("col_width", "ord").alias("width"), F.bool_or(F.col("text").rlike(jvm("[.!?][\"'’”)\\]]?$"))).alias("ends"),
    )
    g = g.join(measure, "doc_id").join(body, "doc_id")
    table = (F.col("n") >= 2) & (F.col("celled") / F.col("n") >= TABLE_LINES)
    off = (F.col("measure") > 0) & (F.abs(F.col("width") - F.col("measure")) > OFF_MEASURE * F.col("measure"))
    g = g.withColumn("kind", F.when(table, "table").when(~F.col("ends") & off & (F.col("size") <= SMALL * F.col("body")), "figure"))
    near = F.count_if(F.col("kind") == "figure").over(W.partitionBy("doc_id", "page"))
    return g.withColumn("near", near).filter((F.col("kind") == "table") | ((F.col("kind") == "figure") & (F.col("near") >= FIGURE_REGIONS))).select(
        "doc_id", "page", "region_idx", "kind"
    )


def line_blocks(lines: DataFrame) -> DataFrame:
    """Blocks: doc_id, ord, type, text, page, size, level, furniture."""
    order = W.partitionBy("doc_id").orderBy("ord")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    lag = lambda c: F.lag(c).over(order)
    x = lines.join(weighted_mode(lines, _half(F.col("size")), "body"), "doc_id").join(region_kinds(lines), ["doc_id", "page", "region_idx"], "left")
    same = F.coalesce((lag("page") == F.col("page")) & (F.abs(lag("col_left") - F.col("col_left")) < 2), F.lit(False))
    x = x.withColumns({"same": same, "step": F.col("base") - lag("base"), "gap": F.col("top") - lag("bot"), "before": lag("text")})
    usual = F.when(F.col("same") & (F.col("step") > 0) & (F.col("step") < 4 * F.col("body")), F.col("step"))
    x = x.withColumn("pitch", F.coalesce(F.median(usual).over(W.partitionBy("doc_id")), F.lit(0.0)))
    t, n = trimmed(F.col("text")), F.length(trimmed(F.col("text")))
    air = F.when(F.col("same"), F.col("gap")).otherwise(F.col("size"))
    big, clean, dot = F.col("size") >= F.col("body") * BIG, ~t.rlike(jvm("[,;:]$")), t.rlike(jvm(r"\.$"))
    caps = t.rlike(jvm("^[^a-z]{4,}$")) & t.rlike("[A-Z]{3}") & (n <= 90)
    heading = (n <= 130) & (
        (big & (n <= 90) & clean) | (t.rlike(NAMED) & (n <= 70) & (F.col("bold") | big | caps | (air > F.col("size") * 0.9)))
        | (t.rlike(jvm(r"^\d+(\.\d+)*\.?\s+\S")) & (n <= 90) & (F.col("bold") | big)) | (caps & (air > F.col("size") * 0.8) & ~dot)
        | (F.col("bold") & (n <= 90) & clean & (air > F.col("size") * 0.85) & ~dot)
    )
    runs_on = F.coalesce(~F.col("before").rlike(jvm("[.!?:;][\"'’”)\\]]?$")) & F.col("text").rlike(r"^\p{Ll}"), F.lit(False))
    x = x.withColumns({"heading": F.coalesce(heading, F.lit(False)), "caption": t.rlike(CAPTION), "runs_on": runs_on})
    spaced = F.when(F.col("pitch") > 0, F.col("step") > F.col("pitch") * WIDE_STEP).otherwise(F.col("gap") > F.col("size") * WIDE_GAP)
    indented = F.col("x0") > lag("x0") + F.col("size") * INDENT
    ended = (lag("x1") < lag("col_right") - F.col("size") * SHORT_LINE) & ~F.col("runs_on")
    inner = spaced | indented | ended | F.col("text").rlike(MARKER) | F.col("caption")
    first = F.col("heading") | F.coalesce(lag("heading"), F.lit(True))
    hard = first | (~F.col("same") & (~F.col("runs_on") | F.col("caption"))) | (F.col("same") & inner)
    x = x.withColumn("hard", F.coalesce(hard, F.lit(True)))
    # A line that runs on in a new column joins a paragraph, but leaves a caption.
    x = x.withColumn("group", F.sum(F.col("hard").cast("int")).over(so_far))
    within = W.partitionBy("doc_id", "group").orderBy("ord")
    soft = ~F.col("same") & ~F.col("hard")
    x = x.withColumns({"opened": F.first("caption").over(within), "softs": F.sum(soft.cast("int")).over(within.rowsBetween(W.unboundedPreceding, 0))})
    x = x.withColumn("begins", F.col("hard") | (soft & F.col("opened") & (F.col("softs") == 1)))
    x = x.withColumn("block", F.sum(F.col("begins").cast("int")).over(so_far))
    g = x.groupBy("doc_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("ord", "text", "kind"))).alias("l"), F.min_by(F.struct("heading", "caption", "page", "size", "body"), "ord").alias("f"),
    )
    joined = F.aggregate(
        F.transform("l", lambda v: v["text"]), F.lit(None).cast("string"),
        lambda a, b: F.when(a.isNull(), b).when(a.endswith("­"), F.concat(F.substr(a, F.lit(1), F.length(a) - 1), b))
        .when(a.rlike(r"\p{L}-\z"), F.when(b.rlike(r"^[\p{Lu}\d]"), F.concat(a, b)).otherwise(F.concat(F.substr(a, F.lit(1), F.length(a) - 1), b)))
        .otherwise(F.concat(a, F.lit(" "), b)),
    )
    kind = F.when(F.col("f.heading"), "heading").when(F.col("f.caption"), "caption").otherwise("para")
    marked = F.filter(F.transform("l", lambda v: v["kind"]), lambda k: k.isNotNull())
    g = g.select(
        "doc_id", "block", kind.alias("type"), joined.alias("text"), F.col("f.page").alias("page"), F.col("f.size").alias("size"), F.col("f.body").alias("body"),
        F.when(F.col("f.heading"), F.when(F.col("f.size") >= F.col("f.body") * FIRST_LEVEL, 1).otherwise(2)).alias("level"),
        F.when(kind == "para", F.element_at(marked, F.when(F.size(marked) > 0, -1))).alias("furniture"),
    ).filter(trimmed(F.col("text")) != "")
    return _table_runs(g)


def _table_runs(blocks: DataFrame) -> DataFrame:
    """What is set small after a table's title, up to the next heading, page or body-size block, belongs to the table."""
    order = W.partitionBy("doc_id").orderBy("block")
    opens = (F.col("type") == "caption") & F.col("text").rlike(TABLE_TITLE)
    closes = (F.col("type") == "heading") | ~F.coalesce(F.col("size") <= F.col("body") * TABLE_RUN, F.lit(False))
    b = blocks.withColumn("event", F.when(opens, F.col("page")).when(closes, F.lit(-1)))
    last = F.last("event", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    inside = F.col("event").isNull() & (F.col("type") != "caption") & (last == F.col("page"))
    b = b.withColumn("furniture", F.when(inside, F.coalesce("furniture", F.lit("table"))).otherwise(F.col("furniture")))
    return b.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), "type", "text", "page", "size", "level", "furniture")


def choose_titles(blocks: DataFrame) -> DataFrame:
    """doc_id and title: the largest display-type phrase of the first two pages, else the first block of fitting length."""
    text = trimmed(F.regexp_replace("text", jvm(r"\s+"), " "))
    x = blocks.join(weighted_mode(blocks, _half(F.coalesce("size", F.lit(0.0))), "body"), "doc_id").withColumn("t", text)
    x = x.withColumn("start", F.min_by("page", "ord").over(W.partitionBy("doc_id")))
    n = F.length("t")
    fit = F.col("type").isin("heading", "para") & ~F.col("text").rlike(jvm(r"^(abstract|summary|introduction|keywords?|highlights?)\b", True))
    display = fit & (F.col("page") <= F.col("start") + 1) & (F.col("size") > F.col("body") * 1.15) & n.between(15, 220)
    phrase = display & (n >= 25) & (F.size(F.split("t", " ")) >= 4)
    best = F.struct("size", -F.col("ord"))
    first = F.min_by("t", F.when(fit & F.length("text").between(15, 219), F.col("ord")))
    return x.groupBy("doc_id").agg(
        F.coalesce(F.max_by("t", F.when(phrase, best)), F.max_by("t", F.when(display, best)), first).alias("title")
    )


def needs_ocr(lines: DataFrame, geometry: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_scanned, needs_ocr. ``geometry``: doc_id, page, width, height in 1/72 inch, every page."""
    chars = lines.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    p = geometry.join(chars, ["doc_id", "page"], "left")
    least = F.greatest(F.lit(80.0), 2.5 * F.col("width") / 72 * F.col("height") / 72)
    g = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.coalesce("chars", F.lit(0)) < least).alias("n_scanned"))
    return g.withColumn("needs_ocr", F.col("n_scanned") >= F.greatest(F.lit(1), F.ceil(F.col("n_pages") * 0.6)))


def recognised_words(pages: DataFrame) -> DataFrame:
    """Words of recognised pages, ready for :func:`word_atoms`: of the blocks' paragraphs' lines, or the flat list of a page
    without blocks. Pages: doc_id, page, blocks, words; words are structs of text, confidence, bbox, is_bold, is_italic."""
    within = F.flatten(F.transform("blocks", lambda b: F.flatten(F.transform(b["paragraphs"], lambda p: F.flatten(F.transform(p["lines"], lambda x: x["words"]))))))
    words = F.when(F.size(F.coalesce(within, F.array())) > 0, within).otherwise(F.col("words"))
    x = pages.select("doc_id", "page", F.posexplode(words).alias("ord", "w"))
    box = [F.col(f"w.bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
    flags = [F.coalesce(f"w.is_{c}", F.lit(False)).alias(c) for c in ("bold", "italic")]
    return x.select("doc_id", "page", "ord", "w.text", F.coalesce(F.col("w.confidence").cast("double"), F.lit(100.0)).alias("confidence"), *box, *flags)


def word_atoms(words: DataFrame, scale: float = 1.0) -> DataFrame:
    """Positioned text from recognised words (doc_id, page, ord, text, confidence, x0, y0, x1, y1, bold, italic)."""
    h = F.col("y1") - F.col("y0")
    w = words.filter((trimmed(F.col("text")) != "") & (F.col("confidence") >= 40) & (h > 0) & (F.col("x1") > F.col("x0")))
    return w.select(
        "doc_id", "page", "ord", trimmed(F.col("text")).alias("text"), (F.col("x0") / scale).alias("x0"), (F.col("x1") / scale).alias("x1"),
        (F.col("y0") / scale).alias("top"), (F.col("y1") / scale).alias("bot"), ((F.col("y1") - 0.2 * h) / scale).alias("base"), (0.78 * h / scale).alias("size"), "bold", "italic",
    )
