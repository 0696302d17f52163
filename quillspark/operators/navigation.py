"""Moving about in a script: windows over the sentences of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import bind, jvm

WORDS_PER_MINUTE, AHEAD = 165, 3
#: Sentences after a heading from which the way back leads past it.
NEAR = 2


def neighbours(sentences: DataFrame) -> DataFrame:
    """Next and previous playable sentence and heading of each sentence (null if there is none)."""
    order = W.partitionBy("doc_id").orderBy("i")
    after, before = order.rowsBetween(1, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, -1)
    playable, heading = F.when(~F.col("skip"), F.col("i")), F.when((F.col("type") == "heading") & ~F.col("skip"), F.col("i"))
    return sentences.select(
        "doc_id", "i", F.min(playable).over(after).alias("next_playable"), F.max(playable).over(before).alias("previous_playable"),
        F.min(heading).over(after).alias("next_heading"), F.max(heading).over(before).alias("previous_heading"),
    )


def time_left(sentences: DataFrame, rate: float = 1.0) -> DataFrame:
    """Words and minutes of playable text from each sentence on."""
    rest = W.partitionBy("doc_id").orderBy("i").rowsBetween(0, W.unboundedFollowing)
    words = F.when(~F.col("skip"), F.size(F.split("text", jvm(r"\s+"), -1))).otherwise(0)
    x = sentences.select("doc_id", "i", F.sum(words).over(rest).alias("words_left"))
    return x.withColumn("minutes_left", F.floor(F.col("words_left") / (WORDS_PER_MINUTE * rate) + 0.5).cast("long"))


def look_ahead(sentences: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """For each playable sentence, itself and the next ``ahead`` playable ones: doc_id, i, ahead (array of i)."""
    order = W.partitionBy("doc_id").orderBy("i").rowsBetween(0, ahead)
    return sentences.filter("NOT skip").select("doc_id", "i", F.collect_list("i").over(order).alias("ahead"))


def section_jumps(sentences: DataFrame) -> DataFrame:
    """Where the previous and next section keys lead from each sentence: doc_id, i, back, forward.

    Back goes to the last heading before, or to the one before that from at most NEAR sentences after it; without one to the
    first sentence. Forward goes to the next heading, without one to the last sentence. Skipped headings count.
    """
    order = W.partitionBy("doc_id").orderBy("i")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    heading = F.when(F.col("type") == "heading", F.col("i"))
    x = sentences.select("doc_id", "i", heading.alias("heading")).withColumns({"last": F.max("heading").over(before), "next": F.min("heading").over(after)})
    # Of the last heading itself, the one before it.
    x = x.withColumn("before", F.last(F.when(F.col("heading").isNotNull(), F.coalesce("last", F.lit(0))), ignorenulls=True).over(before))
    back = F.when(F.col("i") - F.col("last") <= NEAR, F.col("before")).otherwise(F.coalesce("last", F.lit(0)))
    return x.select("doc_id", "i", back.cast("long").alias("back"), F.coalesce("next", F.max("i").over(W.partitionBy("doc_id"))).cast("long").alias("forward"))


def block_spans(sentences: DataFrame, zoned: DataFrame) -> DataFrame:
    """Blocks with their first and last sentence and these sentences in order; an empty block has last = first - 1."""
    own = sentences.groupBy("doc_id", "block_idx").agg(F.sort_array(F.collect_list(F.struct("i", "text", "skip"))).alias("sentences"))
    x = zoned.join(own, ["doc_id", "block_idx"], "left").withColumn("n", F.coalesce(F.size("sentences"), F.lit(0)))
    total = F.sum("n").over(W.partitionBy("doc_id").orderBy("block_idx").rowsBetween(W.unboundedPreceding, 0))
    return x.withColumns({"first": total - F.col("n"), "last": total - 1}).drop("n")


def zone_labels(spans: DataFrame) -> DataFrame:
    """Blocks of :func:`block_spans` with sentences, with the label that stands before those where a zone begins."""
    x = spans.filter("last >= first")
    previous = F.lag("zone", 1, "body").over(W.partitionBy("doc_id").orderBy("block_idx"))
    label = F.when((F.col("zone") != previous) & (F.col("zone") != "body"), F.when(F.col("zone") == "references", "References").otherwise("Back matter"))
    return x.withColumn("label", label)


def script_hash(text: Column) -> Column:
    """FNV-1a over UTF-16 code units, in base 36.

    The units are cut from the text once: four hexadecimal digits each, of an array of pieces.
    """

    def folded(digits: Column) -> Column:
        pieces = F.regexp_extract_all(digits, F.lit("[0-9A-F]{4}"), F.lit(0))
        step = lambda h, c: (h.bitwiseXOR(F.conv(c, 16, 10).cast("long")) * 16777619) % (1 << 32)
        return F.aggregate(pieces, F.lit(2166136261).cast("long"), step)

    return F.lower(F.conv(bind(F.hex(F.encode(text, "UTF-16BE")), folded).cast("string"), 10, 36))


def audio_key(doc_id: Column, speak: Column, voice: str = "default") -> Column:
    return F.concat_ws(":", doc_id, script_hash(speak), F.lit(voice))


def audio_plan(sentences: DataFrame, cached: DataFrame | None = None, voice: str = "default") -> DataFrame:
    """Distinct texts to speak that aren't cached: doc_id, key, speak."""
    s = sentences.filter("NOT skip").select("doc_id", "speak").distinct()
    s = s.withColumn("key", audio_key(F.col("doc_id"), F.col("speak"), voice))
    return s.join(cached.select("key"), "key", "left_anti").select("doc_id", "key", "speak") if cached is not None else s.select("doc_id", "key", "speak")


def current_section(positions: DataFrame, outline: DataFrame) -> DataFrame:
    """The latest outline entry at or before each position (doc_id, i): one ordered pass over both together."""
    marks = outline.select("doc_id", F.col("sentence_index").alias("i"), "ord", "title", F.lit(0).alias("kind"))
    asked = positions.select("doc_id", "i", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("kind"))
    order = W.partitionBy("doc_id").orderBy("i", "kind", "ord").rowsBetween(W.unboundedPreceding, 0)
    x = marks.unionByName(asked).withColumn("section", F.last("title", ignorenulls=True).over(order))
    return x.filter("kind = 1").select("doc_id", "i", "section")


def reanchor(anchors: DataFrame, sentences: DataFrame) -> DataFrame:
    """New index of anchors (doc_id, block_idx, text): the same sentence, else the first at or after the block, else 0."""
    same = sentences.groupBy("doc_id", "block_idx", "text").agg(F.min("i").alias("same"))
    asked = anchors.select("doc_id", "block_idx", "text").distinct().join(same, ["doc_id", "block_idx", "text"], "left")
    # The first sentence of each block, and the anchors before it in the order of blocks.
    starts = sentences.groupBy("doc_id", "block_idx").agg(F.min("i").alias("start"))
    both = asked.withColumn("start", F.lit(None).cast("long")).unionByName(starts.withColumn("start", F.col("start").cast("long")), allowMissingColumns=True)
    order = W.partitionBy("doc_id").orderBy("block_idx").rangeBetween(W.currentRow, W.unboundedFollowing)
    both = both.withColumn("later", F.min("start").over(order)).filter("start IS NULL")
    return both.select("doc_id", "block_idx", "text", F.coalesce("same", "later", F.lit(0)).cast("long").alias("i"))
