"""Queries over pages that are set from the words of ``documents``: columns with narrow or wide gutters, titles over them, drop
caps, notes and list markers in the margin. SQL knows by construction where each word must be read.

Six words make a line, thirty lines a column, and one to three columns a page; what doesn't fill a page is set in one column. A
line is justified: widths go by the lengths of words, found by their prefix sums, with three points between words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import bind, unfolded
from ..operators import page_cut
from ..operators.page_lines import page_lines, page_regions
from ..tables import spread

WIDTH, HEIGHT, LEFT, MEASURE, SPACE = 567.0, 1400.0, 60.0, 450.0, 3.0
WORDS, ROWS, TOP, PITCH = 6, 30, 110.0, 12.0
_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _set_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line: its words, page, column, row, and how many lines the page has."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr("doc_id", f"regexp_extract_all({_SMALL}, '[a-z]+', 0) AS w", "doc_id % 3 + 1 AS columns")
    n = F.ceil(F.size("w") / WORDS).cast("int")
    # Word by word: a slice copies the whole array first.
    row = lambda i: F.filter(F.array(*[F.get("w", i * WORDS + k) for k in range(WORDS)]), lambda w: w.isNotNull())
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), row))
    x = unfolded(docs.select("doc_id", "columns", n.alias("n"), rows.alias("rows")), "rows", "i", "ws", "doc_id", "columns", "n")
    x = x.selectExpr("*", f"{ROWS} * columns AS room").selectExpr("*", "cast(i div room AS int) AS page")
    x = x.selectExpr("*", "(page + 1) * room <= n AS full", "least(room, n - page * room) AS n_lines")
    return x.selectExpr(
        "doc_id", "page", "ws", "n_lines", "CASE WHEN full THEN columns ELSE 1 END AS columns", f"cast(CASE WHEN full THEN i % room div {ROWS} ELSE 0 END AS int) AS col",
        f"cast(CASE WHEN full THEN i % room % {ROWS} ELSE i % room END AS int) AS row", "CASE WHEN doc_id % 2 = 0 THEN 18.0D ELSE 9.0D END AS gutter",
        "(doc_id + page) % 3 = 0 AND n_lines >= 3 AS capped", "(doc_id + page) % 4 = 1 AND n_lines >= 5 AS noted", "(doc_id + page) % 4 = 2 AND (doc_id + page) % 3 <> 0 AS marked",
        "page = 0 AND n_lines >= 5 AS titled",
    )


def _atom(text: Column, x0: Column, x1: Column, base: Column, size: float) -> Column:
    box = {"text": text, "x0": x0, "x1": x1, "top": base - 0.86 * size, "bot": base + 0.26 * size, "base": base, "size": F.lit(size)}
    return F.struct(*[c.cast("string" if k == "text" else "double").alias(k) for k, c in box.items()], F.lit(size > 12).alias("bold"))


def set_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Atoms and geometry of all pages."""
    x = _set_lines(spark, sf_dir)
    measure = (F.lit(MEASURE) - F.col("gutter") * (F.col("columns") - 1)) / F.col("columns")
    inset = F.when(F.col("capped") & (F.col("col") == 0) & (F.col("row") < 2), 21.0).otherwise(0.0)
    x = x.withColumns({"left": LEFT + F.col("col") * (measure + F.col("gutter")) + inset, "m": measure - inset, "base": TOP + PITCH * F.col("row")})
    total, free = F.length(F.array_join("ws", "")), F.col("m") - SPACE * (F.size("ws") - 1)
    before = lambda i: F.length(F.array_join(F.slice("ws", F.lit(1), i), ""))
    at = lambda i: F.col("left") + SPACE * i + free * before(i) / total
    words = F.transform("ws", lambda w, i: _atom(w, at(i), at(i) + free * F.length(w) / total, F.col("base"), 10.0))
    at_start, own = (F.col("col") == 0) & (F.col("row") == 0), lambda test, atom: F.when(test, F.array(atom)).otherwise(F.array().cast("array<struct<text string, x0 double, x1 double, top double, bot double, base double, size double, bold boolean>>"))
    at_x = lambda a: F.lit(float(a))
    extra = [
        own(at_start & F.col("titled"), _atom(F.concat(F.lit("Title of "), F.col("doc_id")), at_x(60), at_x(510), at_x(60), 18.0)),
        own(at_start & F.col("capped"), _atom(F.lit("Q"), at_x(60), at_x(80), at_x(TOP + PITCH), 30.0)),
        *[own(at_start & F.col("noted"), _atom(F.lit(f"note {k}"), at_x(5), at_x(45), at_x(TOP + 6 + PITCH * k), 7.0)) for k in range(3)],
        own((F.col("col") == 0) & (F.col("row") < 6) & F.col("marked"), _atom(F.concat((F.col("row") + 1).cast("string"), F.lit(".")), at_x(40), at_x(50), F.col("base"), 10.0)),
    ]
    atoms = unfolded(x.withColumn("atoms", F.concat(words, *extra)), "atoms", "k", "a", "doc_id", "page", "col", "row")
    atoms = atoms.select("doc_id", "page", (F.col("col") * 100_000 + F.col("row") * 100 + F.col("k")).alias("ord"), "a.*")
    pages = x.groupBy("doc_id", "page").agg(F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    return atoms, pages


def set_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of each page in reading order: how many atoms, and a digest of their texts."""
    x = unfolded(page_regions(*set_pages(spark, sf_dir)), "regions", "region_idx", "r", "doc_id", "page")
    texts = F.array_join(F.transform("r", lambda a: a["text"]), " ")
    return x.select("doc_id", "page", "region_idx", F.size("r").cast("long").alias("n_atoms"), F.sha2(texts, 256).alias("digest"))


def set_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each page: rows of atoms by their baselines, drop caps before the words that they begin."""
    lines = page_lines(*set_pages(spark, sf_dir))
    return lines.select("doc_id", "page", "region_idx", "ord", "text", "size", F.round("base", 3).alias("base"), F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"), "bold")


def _pages(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("base", "x0", "k", "x1", "top", "bot", "size", "text", "bold")) -> DataFrame:
    """Each page's atoms in the order of page_cut, without a cut."""
    atoms, _ = set_pages(spark, sf_dir)
    one = F.struct("base", "x0", F.col("ord").cast("int").alias("k"), "x1", "top", "bot", "size", "text", "bold")
    return atoms.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(one)).alias("atoms"))


def set_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large initials, each with the word that it begins: the highest of those that wrap around it."""
    x = _pages(spark, sf_dir)
    x = unfolded(x.withColumn("caps", page_cut.drop_caps(F.col("atoms"))), "caps", "i", "c", "doc_id", "page", "atoms")
    word = F.get(F.filter("atoms", lambda a: a["k"] == F.col("c.target")), F.lit(0))["text"]
    return x.select("doc_id", "page", F.col("c.text").alias("cap"), word.alias("word"))


def set_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands left of the columns: rows, and how many share a baseline with a row of the columns."""
    side = lambda outside: page_cut._edges(page_cut.baseline_rows(F.filter("atoms", lambda a: (a["x1"] < LEFT) == outside)))
    x = _pages(spark, sf_dir).select("doc_id", "page", side(True).alias("mine"), side(False).alias("theirs"))
    return x.select("doc_id", "page", F.size("mine").alias("n_rows"), page_cut.shared_rows(F.col("mine"), F.col("theirs")).alias("n_shared"))


def set_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces of each page between words of a row, but for those across a gutter: their number and the usual one."""
    body = F.filter("atoms", lambda a: (a["size"] == 10.0) & (a["x0"] >= LEFT))

    def spaces(atoms: Column) -> Column:
        gaps = page_cut.channels(F.transform(atoms, lambda a: F.struct(a["x0"].alias("low"), a["x1"].alias("high"))), F.lit(5.0))
        rows = page_cut.baseline_rows(atoms)
        told = lambda r, g: F.struct(F.size(r).alias("n_rows"), F.size(page_cut.word_spaces(r, g)).alias("n_spaces"), F.round(page_cut.typical_space(r, g), 6).alias("usual"))
        return bind(gaps, lambda g: bind(rows, lambda r: told(r, g)))

    return _pages(spark, sf_dir).select("doc_id", "page", bind(body, spaces).alias("s")).select("doc_id", "page", "s.*")


_LINES = f"""
        d AS (SELECT doc_id, regexp_extract_all({_SMALL}, '[a-z]+') AS w, doc_id % 3 + 1 AS columns FROM documents),
        n AS (SELECT *, CAST(ceil(len(w) / {WORDS}.0) AS BIGINT) AS n, {ROWS} * columns AS room FROM d),
        i AS (SELECT *, unnest(range(0, n)) AS i FROM n),
        p AS (SELECT doc_id, w[i * {WORDS} + 1:i * {WORDS} + {WORDS}] AS ws, i, CAST(i // room AS INT) AS page, room, n, columns, (i // room + 1) * room <= n AS whole, least(room, n - i // room * room) AS n_lines FROM i),
        l AS (SELECT doc_id, page, ws, n_lines, CASE WHEN whole THEN columns ELSE 1 END AS columns, CASE WHEN whole THEN i % room // {ROWS} ELSE 0 END AS col,
                     CASE WHEN whole THEN i % room % {ROWS} ELSE i % room END AS row, CASE WHEN doc_id % 2 = 0 THEN 18.0 ELSE 9.0 END AS gutter, (doc_id + page) % 3 = 0 AND n_lines >= 3 AS capped,
                     (doc_id + page) % 4 = 1 AND n_lines >= 5 AS noted, (doc_id + page) % 4 = 2 AND (doc_id + page) % 3 <> 0 AS marked, page = 0 AND n_lines >= 5 AS titled FROM p)"""
#: The lines in reading order: notes, title, columns.
_READ = _LINES + f"""
        , m AS (SELECT *, (450.0 - gutter * (columns - 1)) / columns AS measure FROM l),
        t AS (
          SELECT doc_id, page, 2 + col AS part, row, CASE WHEN capped AND col = 0 AND row = 0 THEN 'Q' WHEN marked AND col = 0 AND row < 6 THEN (row + 1) || '. ' ELSE '' END || array_to_string(ws, ' ') AS text,
                 10.0 AS size, {TOP} + {PITCH} * row AS base,
                 CASE WHEN marked AND col = 0 AND row < 6 THEN 40.0 ELSE {LEFT} + col * (measure + gutter) + CASE WHEN capped AND col = 0 AND row < 2 THEN 21 ELSE 0 END END AS x0,
                 {LEFT} + col * (measure + gutter) + measure AS x1, false AS bold,
                 len(ws) + (marked AND col = 0 AND row < 6)::INT + (capped AND col = 0 AND row = 0)::INT AS n_atoms, list_concat(CASE WHEN marked AND col = 0 AND row < 6 THEN [(row + 1) || '.'] ELSE [] END,
                 CASE WHEN capped AND col = 0 AND row = 1 THEN ['Q'] ELSE [] END, ws) AS texts FROM m
          UNION ALL SELECT doc_id, page, 1, 0, 'Title of ' || doc_id, 18.0, 60.0, 60.0, 510.0, true, 1, ['Title of ' || doc_id] FROM m WHERE titled AND col = 0 AND row = 0
          UNION ALL SELECT doc_id, page, 0, k, 'note ' || k, 7.0, {TOP} + 6 + {PITCH} * k, 5.0, 45.0, false, 1, ['note ' || k] FROM m, (SELECT unnest([0, 1, 2]) AS k) WHERE noted AND col = 0 AND row = 0),
        r AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY part) - 1 AS INT) AS region_idx FROM t)"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (set_regions, set_lines, set_caps, set_margins, set_spaces)}
ORACLE: dict[str, str] = {
    "set_regions": f"""WITH {_READ}
        SELECT doc_id, page, region_idx, CAST(sum(n_atoms) AS BIGINT) AS n_atoms, sha256(string_agg(array_to_string(texts, ' '), ' ' ORDER BY row)) AS digest FROM r GROUP BY ALL""",
    "set_lines": f"""WITH {_READ}
        SELECT doc_id, page, region_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, region_idx, row) - 1 AS INT) AS ord, text, CAST(size AS DOUBLE) AS size,
               round(CAST(base AS DOUBLE), 3) AS base, round(CAST(x0 AS DOUBLE), 3) AS x0, round(CAST(x1 AS DOUBLE), 3) AS x1, bold FROM r""",
    "set_caps": f"WITH {_LINES} SELECT doc_id, page, 'Q' AS cap, ws[1] AS word FROM l WHERE capped AND col = 0 AND row = 0",
    "set_margins": f"""WITH {_LINES}
        SELECT doc_id, page, CAST(CASE WHEN bool_or(noted) THEN 3 ELSE count(*) FILTER (marked AND col = 0 AND row < 6) END AS INT) AS n_rows,
               CAST(count(*) FILTER (marked AND NOT noted AND col = 0 AND row < 6) AS INT) AS n_shared FROM l GROUP BY ALL""",
    "set_spaces": f"""WITH {_LINES},
        g AS (SELECT doc_id, page, row, sum(len(ws) - 1) AS n FROM l GROUP BY ALL)
        SELECT doc_id, page, CAST(count(*) AS INT) AS n_rows, CAST(sum(n) AS INT) AS n_spaces, CASE WHEN sum(n) >= greatest(8, 2 * count(*)) THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS usual
        FROM g GROUP BY doc_id, page""",
}
