"""From positioned text to lines: a page is cut to regions in reading order, a region to lines.

Atoms (runs of text): doc_id, page, ord, text, x0, x1, top, bot, base, size, bold; y grows downward. Geometry: doc_id, page,
width, height. Atoms of a page meet in one row; ``page_arrays`` parts those of many pages at once in Python.

Atoms without text or coordinates and pages without geometry give no lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..tables import small_batches
from . import page_arrays
from .page_cut import ATOM

NUMBERS = ["x0", "x1", "top", "bot", "base", "size"]
LINES = (
    "n int, region_idx int, text string, size double, base double, top double, bot double, x0 double, x1 double, bold boolean, gap_max double, gap_at double, col_left double, "
    "col_right double, col_width double, in_top boolean, in_bot boolean, dropped_citations int"
)


def _gathered(atoms: DataFrame, geometry: DataFrame) -> DataFrame:
    """doc_id, page, width, height and ``atoms``, the array of a page's atoms in their order."""
    small_batches(atoms.sparkSession)
    usable = atoms.select("doc_id", "page", "ord", "text", *[F.col(c).cast("double").alias(c) for c in NUMBERS], "bold")
    usable = usable.filter(trimmed(F.col("text")) != "").dropna(subset=NUMBERS)
    in_order = F.sort_array(F.collect_list(F.struct("ord", *NUMBERS, "text", "bold")))
    pages = usable.groupBy("doc_id", "page").agg(in_order.alias("atoms"))
    pages = pages.join(geometry.select("doc_id", "page", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")), ["doc_id", "page"])
    return pages.withColumn("atoms", F.transform("atoms", lambda a: F.struct(*[a[c].alias(c) for c in (*NUMBERS, "text", "bold")])))


def _kept(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def page_regions(atoms: DataFrame, geometry: DataFrame) -> DataFrame:
    """doc_id, page, width, height and ``regions``: the arrays of atoms of each region, in reading order."""
    pages = _gathered(atoms, geometry)
    return pages.mapInArrow(page_arrays.region_batches, f"{_kept(pages, 'doc_id', 'page', 'width', 'height')}, regions array<array<{ATOM}>>")


def page_lines(atoms: DataFrame, geometry: DataFrame) -> DataFrame:
    """Lines in reading order, as the passes of ``layout`` take them, with gap_at and dropped_citations.

    One shuffle gathers pages, another (the order in the document) documents.
    """
    pages = _gathered(atoms, geometry)
    x = pages.mapInArrow(page_arrays.line_batches, f"{_kept(pages, 'doc_id', 'page')}, {LINES}")
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "n")) - 1
    return x.select("doc_id", "page", "region_idx", order.alias("ord"), *[c for c in x.columns if c not in ("doc_id", "page", "region_idx", "n")])
