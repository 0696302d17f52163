"""Streams: files that keep arriving, sentences to render, and reading progress where the last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.navigation import audio_key
from ..operators.text_blocks import text_blocks
from ..plans.settings import Settings
from ..sources.ingest import extract_files, imported
from ..tables import discard, saved


def latest_positions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The last position of each user and day, from a stream of events (user_id, ts, event_id, value)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "user_id").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("position"), F.max("ts").alias("at")
    )


def debounced(events: DataFrame, gap: str = "1500 milliseconds", at_once: tuple[str, ...] = ("pause",)) -> DataFrame:
    """The positions that are written: of events (user_id, ts, event_id, event_type, value) of a table or, with a watermark, of a
    stream, the last before a gap, when the gap is over, and those of certain types at once.

    A write at once ends the wait of what came before. Session windows hold one row of state for each user and session.
    """
    own = F.struct("ts", "event_id", "event_type", F.col("value").alias("position"))
    last = events.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.max_by(own, F.struct("ts", "event_id")).alias("e"))
    waited = last.filter(~F.col("e.event_type").isin(*at_once)).select("user_id", "e.ts", "e.event_id", "e.position", F.col("session.end").alias("written_at"))
    now = events.filter(F.col("event_type").isin(*at_once)).select("user_id", "ts", "event_id", F.col("value").alias("position"), F.col("ts").alias("written_at"))
    return waited.unionByName(now)


def save_debounced(events: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", **rule) -> StreamingQuery:
    """Append the debounced positions of a stream to a Parquet table, each once."""
    return debounced(events.withWatermark("ts", delay), **rule).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(events: DataFrame, position: str) -> DataFrame:
    last = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by(position, last).alias("position"), F.max(last).alias("last")).select("user_id", "position", "last.*")


def save_positions(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the last position of each user from a stream of events of any order: each batch writes its own last positions, in a
    folder of its own, so a batch that runs again changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        _last(batch, "value").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def positions(spark: SparkSession, out: str) -> DataFrame:
    """The positions that :func:`save_positions` has kept: user_id, position, ts, event_id."""
    return _last(spark.read.parquet(out), "position")


def import_texts(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Add the blocks of text files to a Parquet table as the files arrive; a batch that runs again changes nothing."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    docs = files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))

    def write(batch: DataFrame, epoch: int) -> None:
        text_blocks(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_files(spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Add files of any kind to the tables docs, content, files and failed as they arrive. A file's id is the hash of its content,
    so one that comes again is the same document; a batch that runs again writes the same folders."""
    arriving = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    own = arriving.select(F.sha2("content", 256).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def write(batch: DataFrame, epoch: int) -> None:
        files = saved(batch.groupBy("doc_id").agg(F.min_by(F.struct("name", "content"), "name").alias("f")).select("doc_id", "f.*"))
        for name, table in imported(extract_files(files), files, F.current_timestamp(), settings).items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
        discard(files)

    return own.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def imported_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of :func:`import_files`; of a file that came more than once the first row."""
    rows = spark.read.parquet(f"{out}/{name}")
    columns = [c for c in rows.columns if c not in ("doc_id", "epoch")]
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*columns), "epoch").alias("r")).select("doc_id", "r.*")


def render_plan(sentences: DataFrame, rendered: DataFrame, voice: str = "default") -> DataFrame:
    """Of a stream of sentences (doc_id, speak, skip, and ts with a watermark) those to render: each text of a document once while
    it is in flight, and none whose key is among the rendered ones (key)."""
    s = sentences.filter("NOT skip").withColumn("key", audio_key(F.col("doc_id"), F.col("speak"), voice))
    return s.dropDuplicatesWithinWatermark(["key"]).join(rendered.select("key"), "key", "left_anti").select("doc_id", "key", "speak")
