"""Structured Streaming over event files: windows, sessions, deduplication and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of the event files at a folder or pattern, ``ts`` as an instant."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 day", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Events and value per type and sliding window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "1 day", gap: str = "6 hours") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def first_deliveries(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each event once, as long as its repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_partitions(events: DataFrame, target: str, checkpoint: str, partition: str) -> StreamingQuery:
    """Writes every micro-batch over the partitions it touches; a batch that is run again
    gives the same files."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(target)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_result(result: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table at the whole result of an aggregating stream; a batch that is run again writes
    the same. Nothing passes through the driver."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
