"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, discard, saved, shared_dir, small_batches

__all__ = ["SPACES", "cut", "discard", "free_names", "let", "nested", "read", "saved", "shared_dir", "slices", "small_batches", "utf8", "words"]

#: Runs of these separate words: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_names(df: DataFrame, *names: str) -> dict[str, str]:
    """For those of these names that columns of a table bear, others that none bears."""
    taken, out = {c.lower() for c in (*df.columns, *names)}, {}
    for c in df.columns:
        if c.lower() in names:
            out[c] = next(f"{c}_{k}" for k in range(len(taken) + 1) if f"{c}_{k}".lower() not in taken)
            taken.add(out[c].lower())
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def slices(batches: Iterator[pa.RecordBatch], size: int, rows: int = 65535, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches to slices of about ``size`` bytes of text and at most ``rows`` rows; a longer text is a slice alone."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(n), 0
        while at < len(n):
            done = int(ends[at - 1]) if at else 0
            end = min(max(at + 1, int(np.searchsorted(ends, done + size, side="right"))), at + rows, len(n))
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of each text; of a null none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def nested(column: pa.Array, *fields: str) -> Iterator[list[tuple]]:
    """For each row of a column of lists of structs, these fields of its structs as tuples; of a null none."""
    lens, flat = pc.fill_null(pc.list_value_length(column), 0).to_pylist(), column.flatten()
    rows, at = list(zip(*(flat.field(f).to_pylist() for f in fields))), 0
    for n in lens:
        yield rows[at : at + n]
        at += n
