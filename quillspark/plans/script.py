"""Blocks to scripts: zones, sentences, outline and statistics, within the row of each document.

A document is a row with the array of its blocks, as text extraction and the library's content table have it; blocks in rows of
their own are gathered first, which is the only shuffle. Zones are found in a word with one letter for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import bind, jvm, unfolded
from ..operators.segment import sentences as split_sentences
from .settings import Settings

WORDS_PER_MINUTE, PAUSE_MS = 165, 550
#: Headings that end the body.
REFERENCES = jvm(r"^\s*(references?|reference\s+list|bibliography|literature\s+cited|works\s+cited|citations)\s*[:.]?\s*$", True)
BACK_MATTER = jvm(
    r"^\s*(acknowledge?ments?|funding(\s+(statement|sources?))?|conflicts?\s+of\s+interest|competing\s+interests?"
    r"|declarations?(\s+of\s+interest)?|disclosures?|author\s+contributions?|data\s+availability(\s+statement)?"
    r"|ethics(\s+(statement|approval))?|supplementary(\s+\w+)*|appendi(x|ces)|abbreviations?|orcid|about\s+the\s+authors?)\s*[:.]?\s*$",
    True,
)


#: Letters of blocks: headings of references, of back matter and others (R, K, P), paragraphs that look like a reference or not
#: (c, o). The body ends with the third reference in a row after an ordinary heading; headings don't break the row.
THIRD = "^[^P]*P(?s:.*?)c[^co]*c[^co]*c"
SECTIONS = "[PRK][co]*|[co]+"


def documents_of(blocks: DataFrame, place: str = "ord", *fields: str) -> DataFrame:
    """Blocks in rows of their own as one row for each document; a table that has the array already stays as it is."""
    if "blocks" in blocks.columns:
        return blocks
    for name, kind in (("level", "int"), ("furniture", "string")):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    own = F.sort_array(F.collect_list(F.struct(place, "type", "text", "level", "furniture", *fields)))
    return blocks.groupBy("doc_id").agg(own.alias("blocks"))


def _letter(b: Column) -> Column:
    heading = F.when(b["text"].rlike(REFERENCES), "R").when(b["text"].rlike(BACK_MATTER), "K").otherwise("P")
    return F.when(b["type"] == "heading", heading).otherwise("o")


def _zones(word: Column) -> Column:
    """For the word of a document the zone of each block, as B (body), r (references) or k (back matter)."""
    by_heading = F.when(word.rlike("[RK]"), F.length(F.regexp_extract(word, "^[^RK]*", 0)))
    by_run = F.nullif(F.length(F.regexp_extract(word, THIRD, 0)), F.lit(0)) - 1
    whole = F.length(word)

    def split(e: Column) -> Column:
        head, tail = F.substr(word, F.lit(1), e["exit"]), F.substr(word, e["exit"] + 1, whole)
        # The two paragraphs before the third reference go with it.
        back = F.when(e["run"], F.length(F.regexp_extract(head, r"[co]{0,2}\z", 0))).otherwise(0)
        zone = lambda t: F.repeat(F.when(t.rlike("^[PK]"), "k").otherwise("r"), F.length(t))
        ends = F.array_join(F.transform(F.regexp_extract_all(tail, F.lit(SECTIONS), F.lit(0)), zone), "")
        return F.concat(F.repeat(F.lit("B"), e["exit"] - back), F.repeat(F.lit("r"), back), ends)

    exit_at = F.struct(F.coalesce(F.least(by_heading, by_run), whole).alias("exit"), F.coalesce(by_run < F.coalesce(by_heading, whole), F.lit(False)).alias("run"))
    return bind(exit_at, split)


def _sections(word: Column, blocks: Column) -> Column:
    """For each block the text of the last heading, its own if it is one."""
    headings = F.transform(F.filter(blocks, lambda b: b["type"] == "heading"), lambda b: b["text"])
    parts = F.regexp_extract_all(word, F.lit(SECTIONS), F.lit(0))
    first = F.when(word.rlike("^[co]"), 1).otherwise(0)
    return bind(headings, lambda h: F.flatten(F.transform(parts, lambda t, k: F.array_repeat(F.get(h, k - first), F.length(t)))))


def zoned(blocks: Column) -> Column:
    """Normalised blocks of an array with ``zone`` (body, references, backmatter) and ``section``.

    The body ends at the first reference or back-matter heading, or at the third reference-like paragraph in a row after
    an ordinary heading; then the latest heading since decides. Up to two paragraphs before such a run go with it.
    """
    clean = F.filter(
        F.transform(blocks, lambda b: F.struct(b["type"].alias("type"), T.normalize(b["text"]).alias("text"), b["level"].alias("level"), b["furniture"].alias("furniture"))),
        lambda b: b["text"] != "",
    )
    full = lambda b, zone, section: F.struct(b["type"].alias("type"), b["text"].alias("text"), b["level"].alias("level"), b["furniture"].alias("furniture"), zone.alias("zone"), section.alias("section"))
    plain = lambda bs: F.transform(bs, lambda b: full(b, F.lit("body"), F.lit(None).cast("string")))

    def cut(bs: Column, word: Column) -> Column:
        # Paragraphs are looked at only in documents with an ordinary heading.
        def letters(w: Column) -> Column:
            own = F.transform(bs, lambda b, i: F.when((b["type"] != "heading") & T.looks_like_reference(b["text"]), "c").otherwise(F.substr(w, i + 1, F.lit(1))))
            return F.when(w.contains("P"), F.array_join(own, "")).otherwise(w)

        def placed(w: Column, zones: Column, sections: Column) -> Column:
            zone = lambda i: F.when(F.substr(zones, i + 1, F.lit(1)) == "B", "body").when(F.substr(zones, i + 1, F.lit(1)) == "r", "references").otherwise("backmatter")
            return F.transform(bs, lambda b, i: full(b, zone(i), F.get(sections, i)))

        return bind(letters(word), lambda w: bind(_zones(w), lambda z: bind(_sections(w, bs), lambda s: placed(w, z, s))))

    def judged(bs: Column) -> Column:
        word = F.array_join(F.transform(bs, _letter), "")
        return F.when(F.exists(bs, lambda b: b["type"] == "heading"), bind(word, lambda w: cut(bs, w))).otherwise(plain(bs))

    return bind(clean, judged)


def zone_documents(blocks: DataFrame) -> DataFrame:
    """doc_id and ``blocks``, the zoned blocks; of blocks in rows, or of documents with arrays of type, text, level (furniture)."""
    d = documents_of(blocks)
    if "furniture" not in d.schema["blocks"].dataType.elementType.names:
        d = d.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), b["level"].alias("level"), F.lit(None).cast("string").alias("furniture"))))
    return d.select("doc_id", zoned(F.col("blocks")).alias("blocks"))


def zone_blocks(blocks: DataFrame) -> DataFrame:
    """The zoned blocks in rows: doc_id, block_idx, type, text, level, furniture, zone, section."""
    return unfolded(zone_documents(blocks), "blocks", "block_idx", "block", "doc_id").select("doc_id", "block_idx", "block.*")


def _pieces(blocks: Column, s: Settings) -> Column:
    """All sentences of a document in order, each with what its block tells; k counts within the block."""
    b_fields = ("type", "zone", "section", "level")

    def judged(b: Column, at: Column) -> Column:
        noise = F.coalesce(T.is_noise(b["text"], b["type"]) | T.is_acronym_soup(b["text"]), F.lit(False))
        table = b["furniture"].isNotNull() & F.lit(s.skip_tables)
        structural = (b["zone"].isin("references", "backmatter") & F.lit(s.skip_references)) | ((b["type"] == "caption") & F.lit(s.skip_captions)) | table
        flags = bind(noise, lambda n: F.struct(n.alias("noise"), table.alias("table"), (n | structural).alias("left_out")))
        piece = lambda f: lambda p, k: F.struct(
            at.cast("int").alias("block_idx"), k.alias("k"), *[b[c].alias(c) for c in b_fields], *[f[c].alias(c) for c in ("noise", "table", "left_out")],
            F.when(k == 0, b["text"]).alias("title"), p.alias("text"),
        )
        return bind(flags, lambda f: F.transform(split_sentences(b["text"]), piece(f)))

    return F.flatten(F.transform(blocks, judged))


def build_sentences(blocks: DataFrame, settings: Settings | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per sentence: doc_id, i, block_idx, type, zone, section, text, speak, skip, pause_before.

    ``blocks``: zoned blocks in rows or by document. With ``keep_empty`` a document without sentences has one row of nulls.
    """
    s = settings or Settings()
    d = documents_of(blocks, "block_idx", "zone", "section").select("doc_id", _pieces(F.col("blocks"), s).alias("pieces"))
    x = d.select("doc_id", F.posexplode_outer("pieces").alias("i", "p")) if keep_empty else unfolded(d, "pieces", "i", "p", "doc_id")
    x = x.select("doc_id", "i", "p.*")
    x = x.withColumn("speak", T.spoken(F.col("text"), s.skip_citations, s.expand_abbreviations))
    pause = F.when((F.col("type") == "heading") & F.lit(s.announce_headings), PAUSE_MS).otherwise(0)
    return x.select(
        "doc_id", "i", "block_idx", "type", "zone", "section", "text", "speak",
        (F.col("left_out") | ~F.coalesce(T.is_speakable(F.col("speak")), F.lit(False))).alias("skip"), pause.alias("pause_before"),
    )


def outline(blocks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Headings that are no noise: doc_id, ord, title, level, sentence_index, zone."""
    d = documents_of(blocks, "block_idx", "zone", "section").select("doc_id", _pieces(F.col("blocks"), settings or Settings()).alias("pieces"))
    entries = F.filter(
        F.transform("pieces", lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda x: (x["p"]["k"] == 0) & (x["p"]["type"] == "heading") & ~x["p"]["noise"] & ~x["p"]["table"],
    )
    x = unfolded(d, entries, "ord", "e", "doc_id")
    return x.select("doc_id", "ord", F.col("e.p.title").alias("title"), F.coalesce("e.p.level", F.lit(2)).alias("level"), F.col("e.i").cast("long").alias("sentence_index"), F.col("e.p.zone").alias("zone"))


def script_stats(sentences: DataFrame) -> DataFrame:
    """Per document: words (of playable sentences), sentences, playable, minutes; rows without a number count as none."""
    words = F.size(F.split("text", jvm(r"\s+"), -1))
    g = sentences.groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(~F.col("skip") & F.col("i").isNotNull(), words)), F.lit(0)).alias("words"), F.count("i").alias("sentences"),
        F.count_if(~F.col("skip") & F.col("i").isNotNull()).alias("playable"),
    )
    return g.withColumn("minutes", F.greatest(F.lit(1), F.floor(F.col("words") / WORDS_PER_MINUTE + 0.5)).cast("long"))
