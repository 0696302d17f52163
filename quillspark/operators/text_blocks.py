"""Blocks of plain text and Markdown, within the row of each document: nothing is exploded or shuffled.

Each line becomes a letter for what it is by itself, so that a document is a word over eight letters, and one pattern cuts that
word to blocks from left to right: an item takes the indented lines after it, a line of ``=`` under exactly one open line makes
that a heading, and open lines run on to a line of another kind or one that ends early. All steps are linear in the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import bind, jvm, unfolded
from ..functions.text import spaced, trimmed

#: How lines of Markdown and plain text are told.
RULE = jvm(r"^\s*([-*_])(\s*\1){2,}\s*$")
HEADING = jvm(r"^(#{1,6})\s+(.*\S)\s*#*$")
SETEXT = jvm(r"^\s*(=|-){3,}\s*$")
ITEM = jvm(r"^\s*([-*+•]|\d{1,3}[.)])\s+")
CAPTION = jvm(r"^(fig(ure)?\.?\s*\d|table\s*\d)", True)
SECTION = jvm(r"^(abstract|introduction|methods?|results?|discussion|conclusions?|references?)\b", True)
CAPITALS, NUMBERED, INDENTED = jvm(r"^[^a-z]{4,}$"), jvm(r"^\d+(\.\d+)*\.?\s+\S"), jvm(r"^\s{2,}")
ENDED, SENTENCE_END, SHORT, EARLY = jvm(r"[.!?]$"), jvm(r"[.!?][\"')\]]?\s*$"), 78, 62
#: What most lines lack: how those begin that may be a rule, heading, underline, item or caption.
SPECIAL = jvm(r"^\s*(?:[-*_+•#=\d]|f|t)", True)
#: Letters: break, heading, caption, item, isolated heading, underline, open line that ends early, open line; small if the line
#: may go on an item. A word over them is cut to blocks by this pattern.
CUT = "I[a-z]*|[BbHhCcXx]|[OoUu][Uu]|[OoUu]+[Ee]?|[Ee]"
#: Of the blocks those that are an open line and its underline.
UNDERLINED = "^[OoUu][Uu]$"
BLOCK = "struct<type string, text string, level int>"


def is_hard_wrapped(lines: Column) -> Column:
    """Most lines run to one width and stop inside a sentence."""
    ending = jvm(r"[.!?:;\"')\]]\s*$")
    solid = F.filter(lines, lambda x: F.length(trimmed(x)) > 20)

    def judged(solid: Column) -> Column:
        n = F.greatest(F.size(solid), F.lit(1))
        lens = F.transform(solid, lambda x: F.length(F.regexp_replace(x, jvm(r"\s+$"), "")))

        def near(lens: Column) -> Column:
            mean = F.aggregate(lens, F.lit(0.0), lambda a, x: a + x) / n
            return bind(mean, lambda m: m.between(40, 110) & (F.size(F.filter(lens, lambda x: F.abs(x - m) < m * 0.22)) / n > 0.55))

        is_open = F.size(F.filter(solid, lambda x: ~x.rlike(ending))) / n > 0.5
        return F.when(F.size(solid) >= 6, bind(lens, near) & is_open).otherwise(F.lit(False))

    return bind(solid, judged)


def lines_of(text: Column) -> Column:
    """The lines of a text as an array; a null text has one empty line."""
    return F.split(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\u00a0", " "), "\n", -1)


def text_lines(docs: DataFrame) -> DataFrame:
    """doc_id, ord, line and whether the document is hard-wrapped."""
    lines = docs.select("doc_id", lines_of(F.col("text")).alias("lines")).withColumn("wrapped", is_hard_wrapped(F.col("lines")))
    return unfolded(lines, "lines", "ord", "line", "doc_id", "wrapped")


def _letter(line: Column, t: Column, alone: Column, wrapped: Column) -> Column:
    """What a line is by itself; ``alone``: between blank lines."""
    isolated = alone & (F.length(t) <= SHORT) & ~t.rlike(ENDED) & (t.rlike(CAPITALS) | t.rlike(NUMBERED) | t.rlike(SECTION))
    early = wrapped & (F.length(F.regexp_replace(line, jvm(r"\s+$"), "")) < EARLY) & line.rlike(SENTENCE_END)
    plain = F.when(isolated, "X").when(early, "E").otherwise("O")
    special = (
        F.when(line.rlike(RULE), "B").when(t.rlike(HEADING), "H").when(t.rlike(SETEXT), F.when(isolated, "X").otherwise("U"))
        .when(t.rlike(CAPTION), "C").when(line.rlike(ITEM), "I").otherwise(plain)
    )
    letter = F.when(t == "", "B").when(line.rlike(SPECIAL), special).otherwise(plain)
    return bind(letter, lambda x: F.when((t != "") & (x != "I") & line.rlike(INDENTED), F.lower(x)).otherwise(x))


def line_letters(lines: Column, trimmed_lines: Column, wrapped: Column) -> Column:
    """The word of a document: the letter of each line."""
    blank = lambda i: F.coalesce(F.get(trimmed_lines, i) == "", F.lit(True))
    letters = F.transform(lines, lambda x, i: _letter(x, F.get(trimmed_lines, i), blank(i - 1) & blank(i + 1), wrapped))
    return F.array_join(letters, "")


def _joined(pieces: Column) -> Column:
    """Lines as one text. Of a word cut at the end of a line the hyphen goes, and the next line follows without a space."""
    broken = lambda a, p: F.coalesce(a.endswith("-") & a.rlike(r"\p{L}-\z") & p.rlike(r"^\p{Ll}"), F.lit(False))

    def piece(p: Column, i: Column) -> Column:
        whole = F.when(broken(p, F.get(pieces, i + 1)), F.substr(p, F.lit(1), F.length(p) - 1)).otherwise(p)
        return F.when((i == 0) | broken(F.get(pieces, i - 1), p), whole).otherwise(F.concat(F.lit(" "), whole))

    return spaced(F.when(F.size(pieces) == 1, F.get(pieces, F.lit(0))).otherwise(F.array_join(F.transform(pieces, piece), "")))


def _block(kind: Column, pieces: Column) -> Column:
    """A block from its letters and its trimmed lines."""
    first, first_kind = F.get(pieces, F.lit(0)), F.upper(F.substr(kind, F.lit(1), F.lit(1)))
    bare = lambda kind, text, level=F.lit(None): F.struct(F.lit(kind).alias("type"), text.alias("text"), level.cast("int").alias("level"))
    level = F.when(F.length(F.regexp_extract(first, "^#+", 0)) <= 2, 1).otherwise(2)
    item = F.concat(F.array(F.regexp_replace(first, ITEM, "• ")), F.slice(pieces, F.lit(2), F.size(pieces)))
    return (
        F.when(first_kind == "H", bare("heading", F.regexp_extract(first, HEADING, 2), level)).when(first_kind == "X", bare("heading", first, F.lit(2)))
        .when(kind.rlike(UNDERLINED), bare("heading", first, F.when(F.get(pieces, F.lit(1)).startswith("="), 1).otherwise(2)))
        .when(first_kind == "C", bare("caption", spaced(first))).when(first_kind == "I", bare("para", bind(item, _joined))).otherwise(bare("para", _joined(pieces)))
    )


def blocks_of(text: Column) -> Column:
    """The blocks of a text in order, as an array of BLOCK."""

    def cut(trimmed_lines: Column, word: Column) -> Column:
        # Where blocks end: the letters, each with a mark after the last one of a block.
        marked = F.regexp_extract_all(F.regexp_replace(word, CUT, "$0|"), F.lit(r"[^|]\|?"), F.lit(0))
        ends = bind(marked, lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.length(F.get(m, i)) == 2))
        kinds = F.regexp_extract_all(word, F.lit(CUT), F.lit(0))

        def block(ends: Column) -> Column:
            start = lambda k: F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
            own = lambda k: F.slice(trimmed_lines, start(k) + 1, F.get(ends, k) - start(k) + 1)
            solid = F.filter(F.transform(kinds, lambda kind, k: F.struct(kind.alias("kind"), k.alias("k"))), lambda x: F.lower(x["kind"]) != "b")
            return F.transform(solid, lambda x: bind(own(x["k"]), lambda pieces: _block(x["kind"], pieces)))

        return bind(ends, block)

    def of_lines(lines: Column) -> Column:
        word = lambda t: bind(is_hard_wrapped(lines), lambda wrapped: line_letters(lines, t, wrapped))
        return bind(F.transform(lines, trimmed), lambda t: bind(word(t), lambda w: cut(t, w)))

    return bind(lines_of(text), of_lines)


def text_documents(docs: DataFrame) -> DataFrame:
    """doc_id and ``blocks``, the array of a document's blocks; without text an empty one."""
    return docs.select("doc_id", blocks_of(F.col("text")).alias("blocks"))


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks: doc_id, ord, type (heading, para, caption), text, level."""
    return unfolded(text_documents(docs), "blocks", "ord", "block", "doc_id").select("doc_id", "ord", "block.*")


def titles(blocks: DataFrame, most: int = 140) -> DataFrame:
    """doc_id and title: the first heading, else the first block."""
    first = F.coalesce(F.min_by("text", F.when(F.col("type") == "heading", F.col("ord"))), F.min_by("text", "ord"))
    return blocks.groupBy("doc_id").agg(F.substr(first, F.lit(1), F.lit(most)).alias("title"))
