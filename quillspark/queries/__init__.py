"""The queries of the engine's own operators, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout, navigation, store
from ..operators.segment import sentences
from ..operators.text_blocks import text_blocks, text_documents, text_lines
from ..plans import script
from ..sources import html, positioned
from ..streaming import progress
from ..tables import spread
from . import cases, paged, spliced
from .oracle import ORACLE as TABLES

__all__ = ["ORACLE", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in ("documents", "pages") else table


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.build_sentences(script.zone_documents(text_documents(_table(spark, sf_dir, "documents"))))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


def strip_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.strip_addresses(F.col("text")).alias("text"))


def line_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_lines(_table(spark, sf_dir, "documents"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(T.trimmed(F.col("line")) != "").alias("n_solid"), F.bool_or("wrapped").alias("wrapped")
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_blocks(_table(spark, sf_dir, "documents"))


def block_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    reasons = T.noise_reasons(F.col("line"), F.lit("para"))
    return docs.groupBy("doc_id").agg(*[F.count_if(test).alias(name) for name, test in reasons.items()])


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.zone_blocks(text_documents(_table(spark, sf_dir, "documents")))


def script_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir)


def script_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    zoned = script.zone_documents(text_documents(_table(spark, sf_dir, "documents")))
    return script.script_stats(script.build_sentences(zoned, keep_empty=True))


def script_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.outline(script.zone_blocks(html.page_blocks(html.pages(_table(spark, sf_dir, "pages")))))


def script_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.neighbours(_sentences(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the form of a script: user turns are the headings, short turns are skipped."""
    c = _table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("i"), F.when(F.col("role") == "user", "heading").otherwise("para").alias("type"), "text",
        (F.length("text") < 60).alias("skip"), F.col("text").alias("speak"),
    )


def next_playable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.neighbours(_turns(spark, sf_dir))


def time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.time_left(_turns(spark, sf_dir))


def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = navigation.look_ahead(_turns(spark, sf_dir))
    return ahead.select("doc_id", "i", F.concat_ws(",", F.transform("ahead", lambda x: x.cast("string"))).alias("ahead"))


def audio_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.audio_plan(_turns(spark, sf_dir))


def audio_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to render when every third turn has been."""
    t = _turns(spark, sf_dir)
    return navigation.audio_plan(t, navigation.audio_plan(t.filter("i % 3 = 0")))


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.pages(_table(spark, sf_dir, "pages")).select("page_id", "title")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_blocks(html.pages(_table(spark, sf_dir, "pages")))


def section_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.section_jumps(_turns(spark, sf_dir))


def turn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.script_stats(_turns(spark, sf_dir))


def _turn_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as sentences of blocks of three, and these blocks; every conversation ends with an empty block."""
    s = _turns(spark, sf_dir).withColumn("block_idx", F.expr("cast(i div 3 as int)"))
    last = s.groupBy("doc_id").agg(F.max("block_idx").alias("last"))
    zoned = last.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("last") + 1)).alias("block_idx"))
    return s, zoned.withColumn("zone", F.element_at(F.array(*map(F.lit, ("body", "references", "backmatter"))), F.col("block_idx") % 3 + 1))


def block_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = navigation.block_spans(*_turn_blocks(spark, sf_dir))
    return x.select("doc_id", "block_idx", "first", "last", F.size(F.coalesce("sentences", F.array())).alias("n"))


def zone_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = navigation.zone_labels(navigation.block_spans(*_turn_blocks(spark, sf_dir)))
    return x.select("doc_id", "block_idx", "label")


def current_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    marks = t.filter("type = 'heading'").select("doc_id", F.col("i").alias("sentence_index"), F.col("i").cast("int").alias("ord"), F.col("text").alias("title"))
    return navigation.current_section(t, marks)


def reanchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as anchors in a script that has lost every fourth one."""
    s, _ = _turn_blocks(spark, sf_dir)
    return navigation.reanchor(s, s.filter("i % 4 <> 1"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the library."""
    d = _table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat_ws(" ", "lang", "source").alias("title"), F.concat_ws(", ", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("author"),
        F.expr("cast(n_chars div 100 as long)").alias("minutes"), (F.col("n_chars") * 97).alias("bytes"), F.timestamp_seconds(1_700_000_000 + F.col("doc_id") * 3600 % 900_000).alias("added_at"),
    )


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return labels.select("doc_id", (F.col("quality") * 40 + F.col("toxic") * 7).alias("index"), F.lit(100).alias("total"))


def library_shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.shelf(_docs(spark, sf_dir), _progress(spark, sf_dir), F.timestamp_seconds(F.lit(1_700_900_000))).drop("added_at")


def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))


def opened_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("blocks")).filter("doc_id % 3 > 0")
    lines = content.select("doc_id", F.explode("blocks"))
    return store.opened(_docs(spark, sf_dir), content, _progress(spark, sf_dir), lines).select("doc_id", "title", F.size("blocks").alias("n_blocks"), F.col("start").cast("long").alias("start"))


def audio_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of each conversation, and how many are left when those of every third conversation are cleared."""
    audio = _turns(spark, sf_dir).filter("NOT skip").select("doc_id", F.concat_ws(":", "doc_id", "i").alias("key"))
    kept = store.audio_counts(store.without_audio(audio, audio.select("doc_id").filter("doc_id % 3 = 0")))
    return store.audio_counts(audio).join(kept.withColumnRenamed("n_audio", "n_left"), "doc_id", "left").fillna(0, ["n_left"])


def audio_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _turns(spark, sf_dir).select("skip", F.concat_ws(":", "doc_id", "i").alias("key"))
    return store.rendered(keys.select("key"), keys.filter("NOT skip"))


def heading_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests for noise that look at the kind, over lines with numbers of which every other is a heading."""
    p = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat_ws(" ", "l_returnflag", F.when(F.col("l_quantity") > 20, F.col("l_partkey")), F.when(F.col("l_tax") > 0.03, F.col("l_suppkey")), F.when(F.col("l_linenumber") > 2, "done."))
        .alias("line"), F.when(F.col("l_linenumber") % 2 == 0, "heading").otherwise("para").alias("kind"),
    )
    reasons = T.noise_reasons(F.col("line"), F.col("kind"))
    counts = [F.count_if(reasons[k]).alias(k) for k in ("short", "numbers", "fragment", "no_vowel", "digits", "one_word", "numbered_heading")]
    return p.groupBy("l_orderkey").agg(*counts, F.count_if(T.is_noise(F.col("line"), F.col("kind"))).alias("noise"))


def line_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that are speakable, acronym soup, or look like a reference; some get notation of these."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    small = "abcdefghijklmnopqrstuvwxyz"
    soup, cited = F.translate("line", small, small.upper()), F.concat("line", F.lit(" Smith, AB. Lancet 2019; 12: 33-40."))
    line = F.when(F.col("k") % 5 == 1, soup).when(F.col("k") % 7 == 2, cited).otherwise(F.col("line"))
    d = d.select("doc_id", line.alias("line"))
    tests = {"speakable": T.is_speakable, "soup": T.is_acronym_soup, "reference": T.looks_like_reference}
    return d.groupBy("doc_id").agg(*[F.count_if(test(F.col("line"))).alias(k) for k, test in tests.items()])


def sentence_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sentence splitting keeps of each text: its characters without spaces, and whether the limit holds."""
    s = _table(spark, sf_dir, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    flat = F.regexp_replace(F.array_join("s", ""), T.jvm(r"\s+"), "")
    return s.select("doc_id", F.sha2(flat, 256).alias("digest"), F.forall("s", lambda x: F.length(x) <= 300).alias("within"))


def run_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs of text, some of them turned, tiny or without a width."""
    x = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("ord"), F.concat_ws("-", "l_returnflag", "l_partkey").alias("text"),
        F.col("l_quantity").alias("a"), (F.col("l_tax") * 100).alias("b"), F.lit(0.0).alias("c"), (F.col("l_quantity") / 4 - 1).alias("d"), (F.col("l_discount") * 1000).alias("e"),
        F.col("l_suppkey").cast("double").alias("f"), F.when(F.col("l_linenumber") > 3, F.col("l_quantity") * 2).alias("width"), F.concat("l_linestatus", F.when(F.col("l_tax") > 0.04, "-Bold").otherwise("")).alias("font_name"),
        F.lit(None).cast("boolean").alias("black"), F.lit(None).cast("boolean").alias("bold"), F.lit(None).cast("boolean").alias("italic"),
    )
    a = positioned.run_atoms(x)
    return a.select("doc_id", "ord", "text", *[F.round(c, 3).alias(c) for c in ("x0", "x1", "top", "bot", "base", "size")], "bold", "italic")


def word_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as recognised words, some of them doubtful or without extent."""
    x = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("ord"), F.concat_ws("-", "l_returnflag", "l_partkey").alias("text"),
        (F.col("l_quantity") * 2).alias("confidence"), F.col("l_suppkey").cast("double").alias("x0"), (F.col("l_suppkey") + F.col("l_linenumber") * 5 - 10).cast("double").alias("x1"), F.col("l_quantity").alias("y0"),
        (F.col("l_quantity") + F.col("l_linenumber") * 4 - 6).alias("y1"), F.lit(False).alias("bold"), F.lit(False).alias("italic"),
    )
    return layout.word_atoms(x, 2.0).select("doc_id", "ord", "text", *[F.round(c, 3).alias(c) for c in ("x0", "x1", "top", "bot", "base", "size")])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source, with the first and last line in the margin bands."""
    d = _table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.split("text", "\n", -1).alias("lines"))
    d = d.select(F.coalesce("doc_id", F.lit("")).alias("doc_id"), "page", F.size("lines").alias("n"), F.posexplode("lines").alias("k", "text"))
    return d.select("doc_id", "page", (F.col("page") * 100_000 + F.col("k")).alias("ord"), F.col("text"), (F.col("k") == 0).alias("in_top"), ((F.col("k") > 0) & (F.col("k") == F.col("n") - 1)).alias("in_bot"))


def needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    pages = _table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("doc_id"), F.col("doc_id").alias("page"), (F.lit(500.0) + F.col("doc_id") % 9 * 50).alias("width"), F.lit(800.0).alias("height"))
    return layout.needs_ocr(lines, pages)


def _headed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lines of :func:`_lines`, under a head on three of five pages of a source and over a foot on four of five."""
    lines = _lines(spark, sf_dir)
    pages = lines.groupBy("doc_id", "page").agg(F.max("ord").alias("last"))
    head = F.concat(F.lit("The Journal of "), F.col("doc_id"), F.lit(", No. "), F.col("page"))
    spliced = [
        pages.filter("page % 5 < 3").select("doc_id", "page", (F.col("page") * 100_000 - 1).alias("ord"), head.alias("text"), F.lit(True).alias("in_top"), F.lit(False).alias("in_bot")),
        pages.filter("page % 5 > 0").select("doc_id", "page", (F.col("last") + 1).alias("ord"), F.concat(F.lit("Page "), F.col("page"), F.lit(" - of - 900")).alias("text"), F.lit(False), F.lit(True)),
    ]
    for more in spliced:
        lines = lines.union(more)
    return lines, lines.groupBy("doc_id").agg(F.countDistinct("page").cast("int").alias("n_pages"))


def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur in the margins, whole lines as keys."""
    return layout.running_heads(*_headed(spark, sf_dir))


def stripped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each page without heads, feet and junk in the margins."""
    x = layout.strip_running_heads(*_headed(spark, sf_dir))
    return x.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("in_top") | F.col("in_bot")).alias("n_margin"))


def library_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    progress = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 40 + F.col("toxic") * 7).alias("index"), F.lit(100).alias("total"))
    return store.library(docs, progress)


def body_size_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size in which most characters of an order are set, its items being lines; of equal ones the first."""
    x = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), ((F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")) * 100_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("ord"), F.concat_ws(" ", "l_returnflag", "l_partkey", "l_suppkey", F.when(F.col("l_tax") > 0.04, "more of it")).alias("text"),
        (F.col("l_quantity") / 5).alias("size"),
    )
    return layout.weighted_mode(x, layout._half(F.col("size")), "size")


def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_progress(_table(spark, sf_dir, "events"))


def progress_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that are written when a user was still for an hour, purchases at once."""
    return progress.debounced(_table(spark, sf_dir, "events"), "1 hour", ("purchase",))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_text, strip_addresses, line_shape, blocks, block_noise, heading_noise, line_tests, sentence_chars, zones, script_sentences, script_stats, turn_stats, script_outline,
        script_neighbours, next_playable, section_jumps, block_spans, zone_labels, current_section, reanchor, time_left, look_ahead, audio_plan, audio_pending, audio_index, audio_rendered, html_title, html_blocks,
        run_atoms, word_atoms, needs_ocr, running_lines, stripped_lines, body_size_mode, library_view, library_shelf, library_counts, opened_documents, progress_latest, progress_debounced,
    )
} | cases.QUERIES | spliced.QUERIES | paged.QUERIES
ORACLE: dict[str, str] = TABLES | cases.ORACLE | spliced.ORACLE | paged.ORACLE
