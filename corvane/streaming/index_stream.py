"""Keeping an index current from a stream of files, and summaries of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.text import short_hash
from corvane.operators import chunking

FILE_SCHEMA = "file string, content string, version bigint"


def index_batch(batch: DataFrame, target: str, epoch: int) -> None:
    """Chunk the files of a batch and write them under its number; the same batch again replaces itself."""
    chunks = chunking.not_degenerate(chunking.chunk_texts(batch, "file", "content", lambda t, stem: chunking.fallback_chunks(t, stem, 500, 10), name="file"))
    latest = batch.select("file", "version", short_hash("content").alias("file_hash"))
    chunks.join(latest, "file").write.mode("overwrite").parquet(f"{target}/batch={epoch}")


def index_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
    """Index every new file of parquet in ``source`` and stop: resumable by its checkpoint, each batch exactly once.

    ``files_per_trigger`` bounds a batch, which is the back-pressure.
    """
    reader = spark.readStream.schema(FILE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (
        reader.parquet(source)
        .writeStream.foreachBatch(lambda batch, epoch: index_batch(batch, target, epoch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """Of each file the chunks of its latest version."""
    all_ = spark.read.parquet(target)
    newest = all_.groupBy("file").agg(F.max(F.struct("version", "batch")).alias("v"))
    return all_.join(newest, "file").where((F.col("version") == F.col("v.version")) & (F.col("batch") == F.col("v.batch"))).drop("v")


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and summed values of each kind and window; later ones than the watermark allows are dropped when streaming.

    Works on batches and streams alike. A time without zone is taken as UTC, as watermarks need an instant.
    """
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(
        F.col("w.start").alias("window_start"), kind, "n", "total"
    )


def session_counts(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by the gap between events, for batches and streams."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(user, F.session_window("__ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(user, F.col("w.start").alias("start"), "n_events")


def run_available(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a streaming aggregation over what is there and return its result table.

    Every batch gives the whole result, which replaces the one before in a folder beside the checkpoint; nothing of it is held by the driver.
    """
    result = f"{checkpoint}-{name}"

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(result)

    query = stream.writeStream.outputMode("complete").queryName(name).foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(result)


def tail_logs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the JSON lines that appear in a folder; rotated files are new files, malformed lines are dropped."""
    lines = spark.readStream.text(folder)
    return lines.select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL").select("r.*")
