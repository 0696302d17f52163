"""Mix sources to target weights with a low-discrepancy schedule.

Each source's documents form one stream in a keyed shuffled order, cut into blocks of equal words. Golden-ratio points
mapped through the cumulative targets give every slot of the schedule a source; a slot's rank within its source picks the
block (rank modulo the number of blocks), so a source is repeated only after it has been used up. The last slot of a
source is cut so that its words meet the target.

Long prefixes (words before a document within its source, slots of a source before a slot) are summed in two levels: a
source's documents are spread over hash buckets and its slots over chunks, so no task holds a whole source.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of its own, last in order;
repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored. One table
with a row for each source is ordered in one task: its size is the number of distinct sources, not of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, words

BLOCK_WORDS = 256
MAX_REPEATS = 3
BUCKETS = 1024
CHUNK = 16384
#: Cells of the unit interval at least.
CELLS = 1024
#: The modulus of the golden-ratio lattice and the odd whole number nearest to its golden section.
LATTICE, STEP = 1 << 31, 1327217885


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source and size: the number of words of the whole text."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), *more)


def targets(sized: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: sid, source, source_size, target.

    Weights go round ``cycle`` in code-point order, null last. Sources share the sum of all sizes by weight, each at most
    ``max_repeats`` times its size. Ordered by size per weight, the sources that meet that bound come first; the first
    one that doesn't fixes the level at which all others stand.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy()
    named = by_source.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), F.col("sid") % len(cycle) + 1))
    named = named.withColumn("cap", max_repeats * F.col("source_size"))
    up = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("sid"))
    before = up.rowsBetween(W.unboundedPreceding, -1)
    named = named.withColumns(
        {
            "k": F.row_number().over(up),
            "left_size": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = F.col("left_size") / F.col("left_weight")
    free = F.when(F.col("cap") >= level * F.col("weight"), F.struct("k", level.alias("level")))
    named = named.withColumn("level", F.min(free).over(every)["level"])
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double"))
    return named.select("sid", "source", "source_size", "weight", target.alias("target"))


def _quota(src: DataFrame, block_words: int) -> DataFrame:
    """Add what the schedule needs: whole words to take, blocks, slots, and the share of the unit interval."""
    quota = F.least(F.floor(F.col("target") + 0.5), MAX_REPEATS * F.col("source_size")).cast("long")
    src = src.withColumn("quota", quota).filter("quota > 0")
    src = src.withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    slots = F.expr(f"(quota div source_size) * blocks + cast(ceil((quota % source_size) / {block_words}) as bigint)")
    src = src.withColumn("slots", slots)
    total = F.sum("quota").over(W.partitionBy())
    hi = F.sum("quota").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    return src.withColumns({"lo": (hi - F.col("quota")) / total, "hi": F.when(hi == total, 1.0).otherwise(hi / total)})


def schedule(spark: SparkSession, src: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix: slot, sid, rank, block, words. ``src`` comes from :func:`targets`."""
    quota = cut(_quota(src, block_words))
    n, n_sources = quota.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).head()
    # Points are even over the cells, so with four cells for each source a slot meets a source and a quarter on average.
    n_cells = max(CELLS, 4 * n_sources)
    slots = spark.range(0, -(-n // block_words)).withColumnRenamed("id", "slot")
    # Every LATTICE slots the points start anew, shifted by a golden fraction of their distance.
    point = (
        (F.col("slot") % LATTICE) * STEP % LATTICE + (F.expr(f"(slot div {LATTICE})") * 0.6180339887498949) % 1
    ) / LATTICE
    slots = slots.withColumn("u", point).withColumn("cell", F.floor(F.col("u") * n_cells))
    # The unit interval in cells: each source lies in the cells that its share touches, so points meet few sources.
    cells = quota.select(
        "sid", "lo", "hi", "slots", "blocks", "source_size", "quota",
        F.explode(F.sequence(F.floor(F.col("lo") * n_cells), F.least(F.floor(F.col("hi") * n_cells), F.lit(n_cells - 1)))).alias("cell"),
    )
    placed = slots.join(cells, "cell").filter("u >= lo AND u < hi").withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    counts = placed.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn(
        "before", F.sum("n").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    )
    ranked = placed.join(counts.drop("n"), ["sid", "chunk"]).withColumn(
        "rank", F.col("before") + F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
    )
    own = ["sid", "slots", "blocks", "source_size", "quota"]
    kept = ranked.filter("rank < slots").select("slot", "rank", *own)
    # The points give a source a few slots too many or too few (their discrepancy); the few missing come last.
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    late = quota.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    late = late.select(F.explode(F.expr("sequence(got, slots - 1)")).alias("rank"), *own)
    late = late.select((F.lit(n) + F.col("rank")).alias("slot"), "rank", *own)
    out = kept.unionByName(late)
    out = out.withColumn("block", F.expr("rank % blocks"))
    begin = F.expr(f"(rank div blocks) * source_size + block * {block_words}")
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    return out.withColumn("words", F.least(length, F.col("quota") - begin)).select("slot", "sid", "rank", "block", "words")


def pieces(sized: DataFrame, src: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """Where the documents (with their row number) lie in the blocks of their source: a row for each block one touches.

    Columns: doc_id, size, source, sid, source_size, target, block, first (its first word in the block), len. A document
    of size 0 has one row with a null block.
    """
    docs = sized.alias("d").join(
        src.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))
    ).select("d.row", "d.doc_id", "d.source", "d.size", "s.sid", "s.source_size", "s.target")
    docs = docs.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    docs = docs.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn(
        "before", F.sum("n").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    ).drop("n")
    inner = W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "row")
    docs = docs.join(sums, ["sid", "bucket"]).withColumn(
        "a", F.col("before") + F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    )
    touched = F.when(
        F.col("size") > 0, F.expr(f"sequence(a div {block_words}, (a + size - 1) div {block_words})")
    )
    docs = docs.withColumn("block", F.explode_outer(touched))
    start = F.greatest(F.col("a"), F.col("block") * block_words)
    end = F.least(F.col("a") + F.col("size"), (F.col("block") + 1) * block_words)
    return docs.select(
        "row", "doc_id", "size", "source", "sid", "source_size", "target", "block",
        (start - F.col("block") * block_words).alias("first"), (end - start).alias("len"),
    )


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 17, row: str | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words that the schedule takes of it).

    Each row gets a number, so that repeated rows stay apart. ``row`` names a column (long) that numbers the rows already,
    as a stored table may have it; it is then returned as ``row``, to find the documents again.
    """
    spark = docs.sparkSession
    sized = cut(sizes(docs, (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row")))
    src = cut(targets(sized))
    slots = schedule(spark, src, block_words)
    # Slots of a block are summed before they meet documents: whole takes, and the one that the quota cuts.
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    used = slots.join(src.select("sid", "source_size"), "sid")
    used = used.groupBy("sid", "block").agg(
        F.sum(F.when(F.col("words") == length, 1).otherwise(0)).alias("whole"),
        F.max(F.when(F.col("words") < length, F.col("words")).otherwise(0)).alias("part"),
    )
    taken = pieces(sized, src, block_words, seed).join(used, ["sid", "block"], "left")
    part = F.greatest(F.lit(0), F.least(F.col("len"), F.col("part") - F.col("first")))
    taken = taken.withColumn("taken", F.coalesce(F.col("whole") * F.col("len") + part, F.lit(0)).cast("long"))
    out = taken.groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return out if row else out.drop("row")
