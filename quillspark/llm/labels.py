"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % n).cast("int")


def sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` rows (doc_id and label) of each value of ``label``, those with the least keyed hash of doc_id.

    Counts come first, a row for each label; only rows whose hash is below a bound, which leaves twice as many as are
    needed, are then ranked, so no task orders all rows of a label.
    """
    rows = rows.select("doc_id", label).distinct()
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    place = F.xxhash64("doc_id", F.lit(7))
    share = place.cast("double") / 2.0**64 + 0.5
    near = rows.join(F.broadcast(counts), label).withColumn("_h", place).filter(share < (2 * most + 64) / F.col("_n"))
    by = W.partitionBy(label).orderBy("_h", "doc_id")
    return near.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= most).select("doc_id", label)
