"""Structured Streaming over event tables: windows, latest states and idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear below `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, width: str = "60 seconds", late: str = "10 minutes", at: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts and sums by window and kind; rows later than `late` are dropped with their window's state."""
    stream = events.withWatermark(at, late) if events.isStreaming else events
    return stream.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), kind, "n", "value")


def first_seen(events: DataFrame, key: str, late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def latest_states(events: DataFrame, key: str = "user_id", at: str = "ts", status: str = "event_type") -> DataFrame:
    """The running last status and number of events of each key, for the complete or update mode."""
    return events.groupBy(key).agg(F.max_by(status, at).alias("status"), F.max(at).alias("at"), F.count("*").alias("n"))


def upserting(target: str, key: str, seq: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row of each key in the table at `target`.

    Each batch writes a new version beside the old one and then names it in a
    one-row pointer table. It starts from the version of the batch before it,
    whatever the pointer says, so a batch that is tried again, even after it was
    named, replaces its own version and nothing is applied twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = spark.read.schema(batch.schema).parquet(f"{target}/v{(number - 1) % 2}").unionByName(batch) if number else batch
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), seq).alias("row")).select("row.*")
        last.write.mode("overwrite").parquet(f"{target}/v{number % 2}")
        spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("overwrite").json(f"{target}/pointer")

    return run


def tally(documents: DataFrame) -> DataFrame:
    """Documents, those with an error and words by method, for the complete or update mode."""
    return documents.groupBy("method").agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.sum("word_count").alias("words"))


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The latest version written by `upserting`."""
    found = spark.read.schema("version long").json(f"{target}/pointer").first()
    return None if found is None else spark.read.parquet(f"{target}/v{found.version % 2}")


def to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run what is available into a table in memory, for tests and small outputs."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
