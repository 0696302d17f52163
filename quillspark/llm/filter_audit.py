"""Interaction of filters, by a packed bitmap index.

A table of documents with one boolean column a filter becomes an index: for each batch of a partition and each part in it,
the filters and labels as bitmaps of one bit a document. The audit takes AND-NOT and popcount of these for every set of
filters, sums the counts over batches and partitions, and reads all orders of the filters off those sums: what a prefix of
filters leaves depends on its set alone, so k filters need 2^k counts a part and not k! scans.

The text-identity filter compares contents (SHA-256 and length) table-wide: first the smallest id of each content, summed
before the shuffle, then a join that Spark may split where one content holds many rows.

Defined results: a null text counts as empty, a null part as the empty string. A null doc_id is neither smaller than another
nor has a smaller one; it has no labels. Rows that repeat an id are documents of their own. Where labels repeat an id, the
largest value counts. An empty table gives no rows. Only the named columns are read, so others may bear any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved, words

FILTERS = "ABCDE"
#: What is counted in each set: all documents, those of good quality, toxic ones.
COUNTED = ("n", "good", "toxic")
#: Parts whose counts a task holds before it hands them on.
HELD = 4096


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, part, content, and the filters A to D over whole texts: short, repetitive, loud, symbols."""
    t = F.coalesce(F.col(text), F.lit(""))
    counts = let(words(t), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    own = docs.select(
        "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.struct(F.unhex(F.sha2(t, 256)).alias("digest"), F.octet_length(t).alias("bytes")).alias("content"),
        counts.alias("w"), (100 * capitals > 2 * F.length(t)).alias("C"), t.rlike(r"[#$%&*|]").alias("D"),
    )
    return own.select("doc_id", "part", "content", (F.col("w.n") < 200).alias("A"), (100 * F.col("w.distinct") < 50 * F.col("w.n")).alias("B"), "C", "D")


def with_copies(rows: DataFrame) -> DataFrame:
    """Append filter E: whether a row with a smaller id has the same content."""
    first = rows.filter("doc_id IS NOT NULL").groupBy("content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = saved(first.filter("first < last").select("content", "first"))
    return rows.join(first, "content", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("content", "first")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Append ``good`` and ``toxic``; documents without a label are neither."""
    one = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    out = rows.join(saved(one.filter("good OR toxic")), "doc_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})


def _packed(names: tuple[str, ...]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").dictionary_encode()
            code = part.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            n = np.bincount(code, minlength=len(part.dictionary))
            # Each part starts at a byte of its own, so that its bits are a slice of the packed whole.
            room = (n + 7) // 8 * 8
            start = np.cumsum(room) - room
            at = start[code[order]] + np.arange(len(code)) - (np.cumsum(n) - n)[code[order]]
            bits = np.zeros((len(names), int(room.sum())), np.uint8)
            for k, name in enumerate(names):
                bits[k, at] = batch.column(name).to_numpy(zero_copy_only=False)[order]
            maps = np.packbits(bits, axis=1)
            cuts = [slice(a // 8, (a + b) // 8) for a, b in zip(start, room)]
            columns = [pa.array([maps[k, c].tobytes() for c in cuts], pa.binary()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([part.dictionary, pa.array(n, pa.int64()), *columns], ["part", "n", *names])

    return pack


def bitmap_index(rows: DataFrame, filters: str = FILTERS, labels: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """``part``, ``n`` documents, and a bitmap for each filter and label; one row for each batch and part in it."""
    names = (*filters, *labels)
    kind = ", ".join(["part string", "n long", *(f"`{c}` binary" for c in names)])
    return rows.select("part", *names).mapInArrow(_packed(names), kind)


def _counted(filters: str):
    sets = range(1 << len(filters))

    def flush(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        parts = list(sums)
        table = np.concatenate([sums[p] for p in parts])
        columns = [pa.array(np.repeat(np.arange(len(parts)), len(sets))), pa.array(np.tile(np.arange(len(sets)), len(parts)), pa.int32())]
        named = pa.array(parts, pa.string()).take(columns[0])
        return pa.RecordBatch.from_arrays([named, columns[1], *(pa.array(table[:, k], pa.int64()) for k in range(len(COUNTED)))], ["part", "failed", *COUNTED])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            maps = [batch.column(c).to_pylist() for c in (*filters, "good", "toxic")]
            for i, (part, n) in enumerate(zip(batch.column("part").to_pylist(), batch.column("n").to_pylist())):
                own = [np.frombuffer(m[i], np.uint8) for m in maps]
                marks = np.stack([np.packbits(np.arange(len(own[0]) * 8) < n), *own[len(filters) :]])
                marks[1:] &= marks[0]
                into = sums.setdefault(part, np.zeros((len(sets), len(COUNTED)), np.int64))
                failed = [np.zeros(len(own[0]), np.uint8)]
                for s in sets:
                    if s:
                        top = s.bit_length() - 1
                        failed.append(failed[s ^ 1 << top] | own[top])
                    into[s] += np.bitwise_count(marks & ~failed[s]).sum(axis=1, dtype=np.int64)
                if len(sums) >= HELD:
                    yield flush(sums)
                    sums = {}
        if sums:
            yield flush(sums)

    return count


def left_by_set(index: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part and set of filters (bit k of ``failed``: the filter k), the documents that fail none of the set."""
    kind = ", ".join(["part string", "failed int", *(f"{c} long" for c in COUNTED)])
    counts = index.mapInArrow(_counted(filters), kind)
    return counts.groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in COUNTED])


def audit(index: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    k, full = len(filters), (1 << len(filters)) - 1
    sets = F.map_from_entries(F.collect_list(F.struct("failed", F.struct(*COUNTED))))
    by_part = left_by_set(index, filters).groupBy("part").agg(sets.alias("left"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    x = by_part.select("part", "left", F.explode(orders).alias("filter_order"))
    x = x.select("part", "left", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = F.create_map(*[y for i, f in enumerate(filters) for y in (F.lit(f), F.lit(1 << i))])
    own = F.element_at(bit, F.substr("filter_order", F.col("step"), F.lit(1)))
    before = F.aggregate(F.split(F.substr("filter_order", F.lit(1), F.col("step") - 1), ""), F.lit(0), lambda a, f: a.bitwiseOR(F.coalesce(F.try_element_at(bit, f), F.lit(0))))
    x = x.withColumns({"own": own, "before": before})
    left = lambda s, c="n": F.element_at("left", s)[c]
    lost = lambda c: left(F.col("before"), c) - left(F.col("before").bitwiseOR(F.col("own")), c)
    failing = left(F.lit(0)) - left(F.col("own"))

    def shapley() -> Column:
        out = F.lit(0).cast("long")
        for s in range(full + 1):
            n = s.bit_count()
            if n < k:
                weight = factorial(n) * factorial(k - 1 - n)
                gained = F.when(F.lit(s).bitwiseAND(F.col("own")) == 0, left(F.lit(s)) - left(F.lit(s).bitwiseOR(F.col("own")))).otherwise(0)
                out = out + gained * weight
        return out

    rest = F.lit(full).bitwiseXOR(F.col("own"))
    return x.select(
        "part", "filter_order", "step", left(F.col("before").bitwiseOR(F.col("own"))).alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"),
        (left(rest) - left(F.lit(full))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley().alias("shapley"),
    )
