"""From files, pages and pasted text to the tables of the library, through one call for all kinds.

Files: doc_id, name, content (bytes), mime and url (nullable). Every kind gives the same columns: doc_id, kind, title, author,
published, journal, doi, pages, needs_ocr, ocr, error, blocks. Texts are cut to blocks in the JVM, archives and pages by a
parser in Arrow batches; page descriptions and images come in as positioned text (see ``positioned``), their rows here say so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..operators import store
from ..operators.text_blocks import text_blocks, titles
from ..plans import script
from ..plans.settings import Settings
from ..tables import saved
from . import files as kinds
from . import html

LEAST_PASTED = 20
BLOCK = "struct<type:string,text:string,level:int,src:string,furniture:string>"
COLUMNS = {
    "doc_id": "string", "kind": "string", "title": "string", "author": "string", "published": "string", "journal": "string", "doi": "string",
    "pages": "int", "needs_ocr": "boolean", "ocr": "boolean", "error": "string", "blocks": f"array<{BLOCK}>",
}
#: What tells pasted markup, and what is said of files without text.
MARKUP = r"(?i)</(p|div|section|article|h[1-6]|li)>|^\s*<"
NO_TEXT, NO_LAYER, UNPLACED = "No readable text found in this file.", "No text layer found; it looks like a scan.", "needs its positioned text"


def _shaped(df: DataFrame, **values: Column) -> DataFrame:
    """The common columns; those that are missing are null or false."""
    rest = {"needs_ocr": F.lit(False), "ocr": F.lit(False)}
    have = {c: F.col(c) for c in df.columns} | values
    return df.select(*[F.coalesce(have.get(k, F.lit(None)), rest.get(k, F.lit(None))).cast(t).alias(k) for k, t in COLUMNS.items()])


def _gathered(blocks: DataFrame) -> DataFrame:
    """Blocks of each document as an array."""
    have = lambda k, t: F.col(k).cast(t) if k in blocks.columns else F.lit(None).cast(t)
    block = F.struct("ord", "type", "text", have("level", "int").alias("level"), have("src", "string").alias("src"), have("furniture", "string").alias("furniture"))
    g = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(block)).alias("b"))
    return g.select("doc_id", F.transform("b", lambda x: F.struct(*[x[k].alias(k) for k in ("type", "text", "level", "src", "furniture")])).alias("blocks"))


def block_rows(content: DataFrame) -> DataFrame:
    """The blocks of stored content as rows: doc_id, ord, type, text, level, src, furniture."""
    return content.select("doc_id", F.posexplode("blocks").alias("ord", "b")).select("doc_id", "ord", "b.*")


def _stats(content: DataFrame, settings: Settings | None) -> DataFrame:
    """Words and minutes of stored documents, within their rows."""
    return script.script_stats(script.build_sentences(script.zone_documents(content), settings)).select("doc_id", "words", "minutes")


def _parse(kind: str, content: bytes, url: str | None) -> tuple[str, dict, list]:
    if kind == "zip":
        names = kinds.Archive(content).names
        kind = "docx" if "word/document.xml" in names else "epub" if any(n.lower().endswith(".opf") for n in names) else "text"
    if kind == "html":
        meta, blocks = html.extract(content.decode("utf-8-sig", "replace"), url)
        return kind, meta, [(*b, None) for b in blocks]
    if kind == "text":
        return kind, {}, []
    meta, blocks = {"docx": kinds.read_docx, "epub": kinds.read_epub}[kind](content)
    return kind, meta, blocks


def _parsed(rows: DataFrame) -> DataFrame:
    """Archives and pages (doc_id, kind, content, url), each read on its own; a broken one has an error and no blocks."""
    fields = ("title", "author", "published", "journal", "doi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for doc_id, kind, content, url in zip(part["doc_id"], part["kind"], part["content"], part["url"]):
                meta, blocks, error = {}, [], None
                try:
                    kind, meta, blocks = _parse(kind, content, url)
                except Exception as e:  # noqa: BLE001  whatever a file holds, the others are read
                    error = f"unreadable: {type(e).__name__}: {e}"
                rows = [{"type": t, "text": x, "level": n, "src": s, "furniture": None} for t, x, n, s in blocks]
                out.append((doc_id, kind, *(meta.get(k) for k in fields), error, rows))
            yield pd.DataFrame(out, columns=["doc_id", "kind", *fields, "error", "blocks"])

    types = ", ".join(f"{k} {t}" for k, t in COLUMNS.items() if k not in ("pages", "needs_ocr", "ocr"))
    return rows.select("doc_id", "kind", "content", "url").mapInPandas(run, types)


def _texts(rows: DataFrame) -> DataFrame:
    """Plain texts (doc_id, text, given: the title to take if there is one)."""
    blocks = text_blocks(rows)
    x = rows.select("doc_id", "given").join(_gathered(blocks), "doc_id", "left").join(titles(blocks), "doc_id", "left")
    return _shaped(x, kind=F.lit("text"), title=F.coalesce(F.nullif("given", F.lit("")), "title"), blocks=F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")))


def bare_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.[a-z0-9]+$", "")


def extract_files(files: DataFrame) -> DataFrame:
    """Every file, whatever its kind, in the common columns."""
    f = files.select("doc_id", "name", "content", *[F.col(c) if c in files.columns else F.lit(None).cast("string").alias(c) for c in ("mime", "url")])
    f = f.withColumn("kind", kinds.sniff(F.col("content"), F.col("name"), F.col("mime")))
    parsed = _shaped(_parsed(f.filter(F.col("kind").isin("html", "epub", "docx", "zip"))))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\\uFEFF", "")
    texts = _texts(f.filter("kind = 'text'").select("doc_id", text.alias("text"), bare_name(F.col("name")).alias("given")))
    placed = _shaped(f.filter(F.col("kind").isin("pdf", "image")).select("doc_id", "kind"), error=F.lit(UNPLACED), blocks=F.array())
    return parsed.unionByName(texts).unionByName(placed)


def extract_positioned(blocks: DataFrame, about: DataFrame, kind: str = "pdf", ocr: bool = False) -> DataFrame:
    """The common columns for what ``positioned`` gives."""
    return _shaped(about.join(_gathered(blocks), "doc_id", "left"), kind=F.lit(kind), ocr=F.lit(ocr), blocks=F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")))


def extract_pasted(rows: DataFrame) -> DataFrame:
    """Pasted texts (doc_id, text, title) in the common columns; those of fewer than LEAST_PASTED characters have an error.

    What looks like markup is read as a page, and as text if that gives no blocks. A given title goes before any other.
    """
    x = rows.select("doc_id", trimmed(F.coalesce("text", F.lit(""))).alias("text"), "title")
    short = _shaped(x.filter(F.length("text") < LEAST_PASTED).select("doc_id"), kind=F.lit("text"), error=F.lit("That is too short to read."), blocks=F.array())
    x = x.filter(F.length("text") >= LEAST_PASTED).withColumn("markup", F.col("text").rlike(MARKUP))
    pages = _parsed(x.filter("markup").select("doc_id", F.lit("html").alias("kind"), F.col("text").cast("binary").alias("content"), F.lit(None).cast("string").alias("url")))
    # Read once: for what is good, and for what has to be read as text.
    pages = saved(pages.filter(F.size("blocks") > 0))
    good = _shaped(pages.join(x.select("doc_id", F.col("title").alias("given")), "doc_id"), title=F.coalesce(F.nullif("given", F.lit("")), "title"))
    plain = x.join(pages.select("doc_id"), "doc_id", "left_anti")
    texts = _texts(plain.select("doc_id", "text", F.col("title").alias("given")))
    return good.unionByName(texts).unionByName(short)


def url_files(fetched: DataFrame) -> DataFrame:
    """Fetched addresses (doc_id, url, content, mime) as files; others than http and https have an error."""
    host, path = F.try_parse_url("url", F.lit("HOST")), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    last = F.try_url_decode(F.element_at(F.filter(F.concat(F.array(F.lit("page")), F.split(path, "/")), lambda p: p != ""), -1))
    pdf = F.coalesce(F.col("mime"), F.lit("")).rlike("(?i)pdf") & ~last.rlike(r"(?i)\.pdf$")
    wrong = ~F.coalesce(F.lower(F.try_parse_url("url", F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))
    return fetched.select(
        "doc_id", "url", "content", "mime", F.when(pdf, F.concat(last, F.lit(".pdf"))).otherwise(last).alias("name"), host.alias("host"),
        F.when(wrong, "Only http and https addresses work here.").alias("error"),
    )


def imported(extracted: DataFrame, files: DataFrame, at: Column, settings: Settings | None = None) -> dict[str, DataFrame]:
    """The tables docs, content and files for what was extracted, and ``failed`` (doc_id, error) for what has no text.

    ``files``: doc_id, name, content, and optionally source (what the library shows; the name without it). The title is the
    document's own, cleaned, else the file's name without its ending.
    """
    extracted = saved(extracted)
    good = extracted.filter(F.size("blocks") > 0)
    failed = extracted.filter(F.coalesce(F.size("blocks"), F.lit(0)) < 1)
    failed = failed.select("doc_id", F.coalesce("error", F.when(F.col("needs_ocr"), NO_LAYER).otherwise(NO_TEXT)).alias("error"))
    content = good.select("doc_id", "blocks")
    stats = _stats(content, settings)
    source = F.col("source") if "source" in files.columns else F.col("name")
    about = files.select("doc_id", "name", F.octet_length("content").cast("long").alias("bytes"), source.alias("source"))
    x = good.join(about, "doc_id").join(stats, "doc_id", "left")
    docs = x.select(
        "doc_id", store.clean_title(F.coalesce("title", F.lit("")), bare_name(F.col("name"))).alias("title"), "author", "kind", kinds.kind_label(F.col("kind")).alias("kind_label"),
        "pages", at.cast("timestamp").alias("added_at"), "bytes", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("minutes", F.lit(1)).alias("minutes"),
        "ocr", "needs_ocr", "source",
    )
    return {"docs": docs, "content": content, "files": files.join(good.select("doc_id"), "doc_id", "left_semi").select("doc_id", "name", "content"), "failed": failed}


def reextracted(tables: dict[str, DataFrame], extracted: DataFrame, settings: Settings | None = None) -> dict[str, DataFrame]:
    """The library with new content for documents that gave text again; progress, audio and all else of them stay.

    A title read anew goes before the old one, but recognised text (``ocr``) keeps the old title.
    """
    good = saved(extracted.filter(F.size("blocks") > 0))
    content = good.select("doc_id", "blocks")
    stats = _stats(content, settings)
    new = good.select("doc_id", F.col("title").alias("_title"), F.col("ocr").alias("_ocr"), F.col("needs_ocr").alias("_needs")).join(stats, "doc_id", "left")
    x = tables["docs"].drop("words", "minutes").join(new, "doc_id")
    own = store.clean_title(F.coalesce("_title", F.lit("")), F.col("title"))
    docs = x.withColumns(
        {"title": F.when(F.col("_ocr") & (F.length("title") > 0), F.col("title")).otherwise(own), "ocr": F.col("ocr") | F.col("_ocr"), "needs_ocr": ~F.col("_ocr") & F.col("_needs")}
    ).select(*tables["docs"].columns)
    return tables | {"docs": store.upsert(tables["docs"], docs), "content": store.upsert(tables["content"], content)}
