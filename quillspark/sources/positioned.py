"""Documents of positioned text: from the runs of a page description to blocks, and from recognised words.

Runs: doc_id, page, ord, text, the matrix a to f that places them on the page (y grows downward), width (null if unknown), and
their font: font_name, and black, bold, italic where the font itself tells (else null). Geometry: doc_id, page, width, height
of every page. Info: doc_id, title, author as the file gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import bind, jvm
from ..functions.text import composed, trimmed
from ..operators import layout
from ..operators.page_lines import page_lines
from ..tables import saved

#: How far runs may be turned (radians), their sizes, and the box around a baseline and the width of a
#: character in ems.
TURNED, LEAST_SIZE, MOST_SIZE, ABOVE, BELOW, CHARACTER = 0.12, 1, 300, 0.86, 0.26, 0.5
#: Names of bold and italic fonts, and titles that say nothing.
BOLD = jvm(r"bold|black|heavy|semib|demib|[-_]bd\b|700|800|900", True)
ITALIC = jvm(r"italic|oblique|[-_]it\b", True)
JUNK_TITLE = jvm(r"^(untitled|microsoft word|document\d*|manuscript|paper|\d+\.(pdf|doc)|.*\.(indd|tex|dvi|qxd))", True)
#: Named entities, the ampersand first.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def font_traits(name: Column, black: Column, bold: Column, italic: Column) -> dict[str, Column]:
    """Whether a font is bold and italic: what the font tells goes before its name."""
    told = F.coalesce(black, F.lit(False)) | bold.isNotNull()
    named = F.coalesce(name, F.lit(""))
    return {
        "bold": F.when(F.coalesce(black, F.lit(False)), True).otherwise(F.coalesce(bold, named.rlike(BOLD))),
        "italic": F.when(told, F.coalesce(italic, F.lit(False))).otherwise(named.rlike(ITALIC)),
    }


def run_atoms(runs: DataFrame) -> DataFrame:
    """Atoms of the upright runs of ordinary size; turned ones are labels of axes, watermarks and stamps."""
    size = F.coalesce(F.nullif(F.hypot("c", "d"), F.lit(0.0)), F.nullif(F.abs("d"), F.lit(0.0)), F.lit(10.0))
    x = runs.filter((F.length("text") > 0) & (F.abs(F.atan2("b", "a")) <= TURNED)).withColumn("size", size)
    x = x.filter(F.col("size").between(LEAST_SIZE, MOST_SIZE))
    width = F.coalesce(F.nullif("width", F.lit(0.0)), F.length("text") * F.col("size") * CHARACTER)
    traits = font_traits(F.col("font_name"), F.col("black"), F.col("bold"), F.col("italic"))
    return x.select(
        "doc_id", "page", "ord", "text", F.col("e").alias("x0"), (F.col("e") + width).alias("x1"), (F.col("f") - ABOVE * F.col("size")).alias("top"),
        (F.col("f") + BELOW * F.col("size")).alias("bot"), F.col("f").alias("base"), "size", *[c.alias(k) for k, c in traits.items()],
    )


def decode_entities(c: Column) -> Column:
    """Character references as characters: by number, and the five named ones."""

    def character(ref: Column) -> Column:
        hexa = F.lower(F.substr(ref, F.lit(3), F.lit(1))) == "x"
        number = F.when(hexa, F.conv(F.regexp_extract(ref, "(?i)&#x([0-9a-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(ref, "&#([0-9]+)", 1)).cast("long")
        # Numbers beyond the last character stay as they are.
        return F.when(number < 0x110000, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(ref)

    pattern = "(?i)&#x[0-9a-f]{1,6};|&#[0-9]{1,7};"

    def rebuilt(x: Column) -> Column:
        new = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), character)
        return bind(new, lambda n: F.array_join(F.transform(F.split(x, pattern, -1), lambda g, i: F.concat(g, F.coalesce(F.get(n, i), F.lit("")))), ""))

    out = bind(c, lambda x: F.when(x.rlike(pattern), rebuilt(x)).otherwise(x))
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return composed(out)


def metadata(info: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, title, author: the file's own title, unless it says nothing and the blocks have a better one."""
    own = trimmed(decode_entities(F.col("title")))
    x = info.select("doc_id", F.when(F.length(trimmed(F.col("title"))) > 3, own).alias("own"), F.nullif(trimmed(decode_entities(F.col("author"))), F.lit("")).alias("author"))
    x = blocks.select("doc_id").distinct().join(x, "doc_id", "full").join(layout.choose_titles(blocks), "doc_id", "left")
    useless = F.col("own").isNull() | F.col("own").rlike(JUNK_TITLE)
    return x.select("doc_id", F.when(useless, F.coalesce("title", "own")).otherwise(F.col("own")).alias("title"), "author")


def atom_blocks(atoms: DataFrame, geometry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks, and per document n_pages, n_scanned and needs_ocr: lines, running heads off, regions, paragraphs.

    Lines and blocks are read several times, so they are written first (see ``tables``).
    """
    lines = saved(page_lines(atoms, geometry))
    verdict = layout.needs_ocr(lines, geometry)
    return saved(layout.line_blocks(saved(layout.strip_running_heads(lines, verdict)))), verdict


def extract_runs(runs: DataFrame, geometry: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks, and one row for each document: title, author, pages, needs_ocr."""
    blocks, verdict = atom_blocks(run_atoms(runs), geometry)
    about = verdict.join(metadata(info, blocks), "doc_id", "left")
    return blocks, about.select("doc_id", "title", "author", F.col("n_pages").cast("int").alias("pages"), "needs_ocr")


def extract_recognised(pages: DataFrame, geometry: DataFrame, scale: float = 1.0, image: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same for recognised pages (see ``layout.recognised_words``). The title is the first heading of over 12 characters,
    else the first block; of an image always that."""
    blocks, verdict = atom_blocks(layout.word_atoms(layout.recognised_words(pages), scale), geometry)
    first = F.min_by("text", "ord")
    head = F.min_by("text", F.when((F.col("type") == "heading") & (F.length("text") > 12), F.col("ord")))
    title = F.substr(first, F.lit(1), F.lit(120)) if image else F.substr(F.coalesce(head, first), F.lit(1), F.lit(160))
    about = verdict.join(blocks.groupBy("doc_id").agg(title.alias("title")), "doc_id", "left")
    return blocks, about.select("doc_id", "title", F.lit(None).cast("string").alias("author"), F.col("n_pages").cast("int").alias("pages"), F.lit(False).alias("needs_ocr"))
