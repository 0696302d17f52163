"""Files of any supported format: telling the kind, and reading archives (EPUB, DOCX) one file per row."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import CAPTION_TEXT, Node, blocks_of, parsed, summed

#: Labels of kinds.
LABELS = {"pdf": "PDF", "epub": "EPUB", "docx": "DOCX", "html": "WEB", "text": "TXT", "image": "IMG", "zip": "ZIP"}


def sniff(content: Column, name: Column, mime: Column | None = None) -> Column:
    """The kind of a file by its first bytes, then its name and type."""
    mime = F.lower(F.coalesce(mime if mime is not None else F.lit(""), F.lit("")))
    head, name = F.substring(content, 1, 512), F.lower(F.coalesce(name, F.lit("")))
    magic = F.hex(F.substring(content, 1, 4))
    raw = F.decode(head, "ISO-8859-1")
    text = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"^(?:\xEF\xBB\xBF)?\s+", "")
    archive = (
        F.when(F.regexp_replace(raw, r"\s", "").contains("mimetypeapplication/epub+zip"), "epub").when(name.endswith(".epub") | mime.contains("epub"), "epub")
        .when(name.endswith(".docx") | mime.contains("wordprocessingml"), "docx").otherwise("zip")
    )
    markup = text.rlike(r"(?i)^<(!doctype\s+html|html|\?xml[^>]*\?>\s*<(!doctype\s+html|html))") | (
        text.rlike(r"(?i)^<\?xml") & text.rlike(r"(?i)<(body|section|article)\b")
    )
    return (
        F.when(magic == "25504446", "pdf").when(magic.isin("504B0304", "504B0506"), archive)
        .when((magic == "89504E47") | magic.startswith("FFD8FF"), "image").when(markup, "html")
        .when(name.rlike(r"\.(html?|xhtml)$") | mime.contains("text/html"), "html")
        .when(name.endswith(".pdf") | mime.contains("application/pdf"), "pdf").otherwise("text")
    )


def kind_label(kind: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(labels[kind], F.lit("DOC"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, content and kind of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.withColumn("kind", sniff(F.col("content"), F.col("name")))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _find(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in root.iter() if isinstance(x.tag, str) and _local(x.tag) == name]


def _attribute(x: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in x.attrib.items() if _local(k).rpartition(":")[2] == name), None)


#: An entry of an archive may hold this many bytes, a file's entries together four times as many.
MOST_INFLATED = 256 << 20


class Archive:
    """Entries of a ZIP by path, with forward slashes; folders are left out. What inflates beyond MOST_INFLATED is an error."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.inflated = 0
        self.names = {x.orig_filename.replace("\\", "/"): x for x in self.zip.infolist() if not x.is_dir()}

    def xml(self, path: str) -> ElementTree.Element:
        """The tree of an entry; if it isn't well-formed, what a page parser makes of it."""
        try:
            return ElementTree.fromstring(self.read(path))
        except ElementTree.ParseError:
            return _as_element(parsed(self.text(path)))

    def text(self, path: str) -> str:
        return self.read(path).decode("utf-8", "replace")

    def read(self, path: str) -> bytes:
        """An entry's bytes; its stated size isn't trusted."""
        with self.zip.open(self.names[path]) as entry:
            data = entry.read(min(MOST_INFLATED, 4 * MOST_INFLATED - self.inflated) + 1)
        self.inflated += len(data)
        if len(data) > MOST_INFLATED or self.inflated > 4 * MOST_INFLATED:
            raise ValueError(f"{path} inflates to more than is read of a file")
        return data


def _as_element(root: Node) -> ElementTree.Element:
    """A page tree as elements without prefixes, as a lenient stand-in for strict XML."""
    made = {id(root): ElementTree.Element(root.tag)}
    for node in root.walk():
        own = ElementTree.SubElement(made[id(node.parent)], node.tag.rpartition(":")[2], {k: v or "" for k, v in node.attrs.items()})
        own.text = "".join(c for c in node.children if isinstance(c, str))
        made[id(node)] = own
    return made[id(root)]


def _paragraph(p: ElementTree.Element) -> str:
    out, todo = [], [p]
    while todo:
        node = todo.pop()
        kind = _local(node.tag) if node is not p else ""
        if kind == "t":
            out.append("".join(node.itertext()))
        elif kind in ("tab", "br", "noBreakHyphen"):
            out.append({"tab": "\t", "br": " ", "noBreakHyphen": "-"}[kind])
        elif kind not in ("softHyphen", "instrText", "delText"):
            todo += reversed(node)
    return " ".join("".join(out).split())


def read_docx(data: bytes) -> tuple[dict, list[tuple]]:
    """Metadata and blocks (type, text, level, src) of a DOCX."""
    z, blocks = Archive(data), []
    for p in _find(z.xml("word/document.xml"), "p"):
        text = _paragraph(p)
        if not text:
            continue
        marks = {_local(x.tag): x for part in p if _local(part.tag) == "pPr" for x in part}
        style = (_attribute(marks["pStyle"], "val") or "") if "pStyle" in marks else ""
        depth = _attribute(marks["outlineLvl"], "val") if "outlineLvl" in marks else None
        numbered = re.match(r"heading(\d)", style, re.I)
        if style.lower() == "title":
            blocks.append(("heading", text, 1, None))
        elif numbered:
            blocks.append(("heading", text, 1 if int(numbered[1]) <= 2 else 2, None))
        elif depth is not None and int(depth) < 6:
            blocks.append(("heading", text, 1 if int(depth) <= 1 else 2, None))
        elif style.lower() == "caption" or CAPTION_TEXT.match(text):
            blocks.append(("caption", text, None, None))
        else:
            blocks.append(("para", f"• {text}" if "numPr" in marks and text[0] not in "•-*–" else text, None, None))
    core = z.xml("docProps/core.xml") if "docProps/core.xml" in z.names else ElementTree.Element("x")
    named = {k: next((("".join(x.itertext())).strip() for x in _find(core, k)), None) or None for k in ("title", "creator")}
    first = next((b for b in blocks if b[0] == "heading"), blocks[0] if blocks else None)
    return {"title": named["title"] or (first[1][:160] if first else None), "author": named["creator"]}, blocks


def _resolved(base: str, rel: str) -> str:
    """A path relative to that of another entry; one with a scheme stays."""
    if re.match(r"[a-z]+:", rel, re.I):
        return rel
    return posixpath.normpath(posixpath.join("/", posixpath.dirname(base), *unquote(rel).lstrip("/").split("/"))).lstrip("/")


def _is_contents(body: Node) -> bool:
    return any(x.tag == "nav" and (x.attrs.get("epub:type") == "toc" or x.attrs.get("id") == "toc") for x in body.walk())


def read_epub(data: bytes) -> tuple[dict, list[tuple]]:
    """Metadata and blocks of an EPUB, chapters in the order of its spine."""
    z = Archive(data)
    roots = _find(z.xml("META-INF/container.xml"), "rootfile") if "META-INF/container.xml" in z.names else []
    package = (_attribute(roots[0], "full-path") if roots else None) or next(n for n in z.names if n.lower().endswith(".opf"))
    opf = z.xml(package)
    items = {_attribute(x, "id"): x for x in _find(opf, "item")}
    spine = [items[k] for x in _find(opf, "itemref") if (k := _attribute(x, "idref")) in items]
    paths = [_resolved(package, _attribute(x, "href") or "") for x in spine if re.search("html|xml", _attribute(x, "media-type") or "xhtml", re.I)]
    blocks = []
    for path in paths or sorted(n for n in z.names if re.search(r"\.x?html?$", n, re.I)):
        if path in z.names:
            root = parsed(z.text(path))
            summed(root)
            body = next((x for x in root.walk() if x.tag == "body"), root)
            if not _is_contents(body):
                blocks += [(*b, path) for b in blocks_of(body)]
    named = {k: next(((x.text or "").strip() for x in _find(opf, k)), None) or None for k in ("title", "creator", "date")}
    return {"title": named["title"] or "EPUB", "author": named["creator"]}, blocks
