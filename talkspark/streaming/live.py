"""Live meetings as streams: event log, idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The event log as a stream: (session, seq, time, type, payload)."""
    return spark.readStream.schema("session bigint, seq bigint, time timestamp, type string, payload string").option("maxFilesPerTrigger", files_per_trigger).json(path)


def upserted(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key with new ones over old ones, so that a batch that comes again changes nothing."""
    return known.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is there to Parquet, exactly once, and stop; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def latest_voices(placed: DataFrame) -> DataFrame:
    """The last state of each voice: (recording, voice, window_ix, score)."""
    return placed.where("voice is not null").groupBy("recording", "voice").agg(F.max("window_ix").alias("window_ix"), F.max_by("score", "window_ix").alias("score"))
