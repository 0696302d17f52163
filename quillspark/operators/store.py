"""The library as Parquet tables: upserts, deletes, views and reading progress, all as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = ("docs", "content", "files", "progress", "audio")


def upsert(table: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``table`` with those of ``changes`` in place of equal keys: put."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def remove(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of ``ids``."""
    return {name: t.join(ids.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def newest_first(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.col("added_at").desc(), "doc_id")


def counts(docs: DataFrame, audio: DataFrame) -> DataFrame:
    """One row: documents and rendered sentences in the library."""
    both = docs.select(F.lit(1).alias("doc")).unionByName(audio.select(F.lit(0).alias("doc")))
    return both.agg(F.count_if(F.col("doc") == 1).alias("n_docs"), F.count_if(F.col("doc") == 0).alias("n_audio"))


def audio_counts(audio: DataFrame) -> DataFrame:
    """Rendered sentences of each document: doc_id, n_audio."""
    return audio.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_audio"))


def rendered(keys: DataFrame, audio: DataFrame) -> DataFrame:
    """Keys with ``has``: whether their sentence is rendered."""
    return keys.join(audio.select("key", F.lit(True).alias("has")).distinct(), "key", "left").fillna(False, ["has"])


def without_audio(audio: DataFrame, ids: DataFrame) -> DataFrame:
    """The audio table without the sentences of the documents ``ids``."""
    return remove({"audio": audio}, ids)["audio"]


def opened(docs: DataFrame, content: DataFrame, progress: DataFrame, sentences: DataFrame) -> DataFrame:
    """Documents that have content, with their blocks and the sentence to begin at: the stored one, 0 if that is past the end."""
    n = sentences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    x = docs.join(content.filter(F.size("blocks") > 0), "doc_id").join(progress.select("doc_id", "index"), "doc_id", "left").join(n, "doc_id", "left")
    return x.withColumn("start", F.when(F.col("index") < F.col("n"), F.col("index")).otherwise(0)).drop("index", "n")


def with_files(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose original file is stored, with that file."""
    return docs.join(files.select("doc_id", "name", "content"), "doc_id")


def latest_progress(events: DataFrame) -> DataFrame:
    """The last position of each user: of columns user_id, ts, event_id and value."""
    last = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(
        F.max_by("value", last).alias("position"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("n_events")
    )


def library(docs: DataFrame, progress: DataFrame) -> DataFrame:
    """Documents with their progress in percent; null without progress, and unless over half a percent."""
    pct = F.when(F.col("total") > 0, F.least(F.lit(100.0), 100 * F.col("index") / F.col("total")))
    return docs.join(progress.select("doc_id", "index", "total"), "doc_id", "left").withColumn("percent", F.when(pct > 0.5, pct)).drop("index", "total")


def size_label(n: Column) -> Column:
    """Bytes as B, KB or MB; nothing for null or 0."""
    rounded = lambda x: F.floor(x + 0.5).cast("string")
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "").when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.concat(rounded(n / 1024), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / (1 << 20)), F.lit(" MB")))
    )


def length_label(minutes: Column) -> Column:
    """Minutes to hear; hours from 60 on."""
    h, m = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    text = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min listen"))).when(minutes % 60 == 0, F.concat(h, F.lit(" h listen")))
    return F.when(F.coalesce(minutes, F.lit(0)) == 0, "").otherwise(text.otherwise(F.concat(h, F.lit(" h "), m, F.lit(" min listen"))))


def day_label(at: Column, now: Column) -> Column:
    """How long ago: whole days of 24 hours, from a week on the date."""
    days = F.floor((F.unix_millis(now) - F.unix_millis(at)) / 86_400_000)
    return (
        F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .otherwise(F.date_format(at, "MMM d"))
    )


def author_label(author: Column) -> Column:
    """The first author; of several with et al."""
    return F.concat(F.substring_index(author, ",", 1), F.when(author.contains(","), " et al.").otherwise(""))


def shelf(docs: DataFrame, progress: DataFrame, now: Column | None = None) -> DataFrame:
    """The library as it is listed: newest first, with labels and percent."""
    now = F.current_timestamp() if now is None else now
    labels = {
        "by": author_label(F.col("author")), "length": length_label(F.col("minutes")), "when": day_label(F.col("added_at"), now), "size": size_label(F.col("bytes")),
    }
    return newest_first(library(docs, progress).withColumns(labels))


def clean_title(title, fallback):
    """White space collapsed; over 200 characters cut with an ellipsis; shorter than three gives the fallback."""
    t = F.trim(F.regexp_replace(title, r"\s+", " "))
    cut = F.when(F.length(t) > 200, F.concat(F.substr(t, F.lit(1), F.lit(197)), F.lit("…"))).otherwise(t)
    return F.when(F.length(t) > 2, cut).otherwise(fallback)
