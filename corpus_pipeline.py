"""A corpus pipeline: each stage takes the documents that its predecessor kept and returns those it keeps.

All stages: columns other than those a stage is about pass through untouched, whatever their names; an empty table gives an
empty table of the same columns; null texts and null ids are documents like others, as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import decontamination, mixing, ngram_join, pseudonyms, queries, toxicity
from quillspark.llm.common import discard, read, saved

ROW, KEY = "_row", "_key"


def _free(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that the documents don't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _packed(docs: DataFrame) -> DataFrame:
    """Documents as doc_id, text, and one column of all the others, so that no name clashes with what operators add."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(None).alias("none")]
    return docs.select("doc_id", "text", F.struct(*rest).alias(ROW))


def _unpacked(packed: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from what :func:`_packed` made."""
    return packed.select(*[F.col(c if c in ("doc_id", "text") else f"{ROW}.`{c}`").alias(c) for c in like.columns])


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a key, which tells apart texts of one id and documents without an id, and its name."""
    key = _free(docs, KEY)
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity is below the threshold. Null and blank texts, and without labels of both classes all
    documents, have score 0 and stay; repeated rows share their fate."""
    net = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return _unpacked(toxicity.score(_packed(docs), net).filter("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near copies, and of rows that repeat an id and its text one.

    Documents without words or without an id link with nothing and stay; an id with different texts is one document, all of
    whose texts go if one of them is linked to a document of smaller id.
    """
    # Written, the ids have a known size: few are broadcast, many are joined by a shuffle.
    copies = saved(ngram_join.classes(docs.select("doc_id", "text")).filter("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    repeats = docs.filter("doc_id IS NOT NULL").groupBy(F.xxhash64("doc_id", "text").alias(KEY)).count().filter("count > 1")
    if repeats.limit(1).count():
        (kept, key), row = _keyed(kept), _free(docs, ROW)
        once = F.row_number().over(W.partitionBy(key).orderBy(F.lit(0)))
        kept = kept.withColumn(row, F.when(F.col("doc_id").isNotNull(), once).otherwise(1)).filter(F.col(row) == 1).select(*docs.columns)
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item. Each text is judged by itself, also under a repeated or null id; null
    texts hold nothing; repeated rows share their fate."""
    keyed, key = _keyed(docs)
    found = decontamination.contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    found = saved(found.select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(found, key, "left_anti").select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace private values by pseudonyms. ``n_chars`` follows the text where that has changed; null texts stay null."""
    out = pseudonyms.pseudonymise(_packed(docs), queries.pseudonym_key(spark))
    changed = F.col("n_private") > 0
    columns = {c: F.col(c if c in ("doc_id", "text") else f"{ROW}.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[x.alias(c) for c, x in columns.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, source_size, target and taken: how many of their words the mix takes. Null texts have size 0;
    a column of one of these names keeps it, and the mix's is called ``mix_`` and its name."""
    row = _free(docs, ROW)
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    mixed = mixing.mix(numbered.select("doc_id", "source", "text", row), row=row)
    added = [F.col(f"m.{c}").alias(f"mix_{c}" if c in docs.columns else c) for c in ("size", "source_size", "target", "taken")]
    both = numbered.alias("d").join(mixed.alias("m"), F.col(f"d.{row}") == F.col("m.row"))
    return both.select(*[F.col(f"d.`{c}`") for c in docs.columns], *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pseudonyms", hide_private),
    ("mixing", mix_sources),
]

#: Trained and keyed stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written and read again before the next stage, and then deleted."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = saved(stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
