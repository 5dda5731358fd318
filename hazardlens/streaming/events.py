"""Windowed and de-duplicating operators that run on batches and on streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and value per window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests per user in sliding windows, as a rate limit counts them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "user_id").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "user_id", "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select(F.col("w.start").alias("session_start"), "user_id", "events")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """On a stream the first event of each id within the watermark, on a table one row per id."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def recent(events: DataFrame, seconds: int = 60, most: int = 120) -> DataFrame:
    """Each event with how many its user has had in the last seconds, itself included, and whether they are too many."""
    trailing = Window.partitionBy("user_id").orderBy(F.unix_timestamp("ts")).rangeBetween(1 - seconds, 0)
    return events.withColumn("recent", F.count("*").over(trailing)).withColumn("limited", F.col("recent") > most)


def distribution(events: DataFrame, by: str = "event_type") -> DataFrame:
    """Running counts; on a stream for output mode `update`, so that views learn of changes."""
    return events.groupBy(by).agg(F.count("*").alias("events"))


def append_new(batch: DataFrame, path: str, epoch: int = 0) -> None:
    """For foreachBatch: append the rows whose content isn't stored.

    Both sides are dealt by content hash. The stored table is partitioned by the
    hash's first byte, so a batch only reads the partitions that it falls into.
    """
    spark = batch.sparkSession
    rows = batch.dropDuplicates(["content_hash"]).withColumn("shard", F.substring("content_hash", 1, 2))
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        # At most 256 values.
        shards = [r["shard"] for r in rows.select("shard").distinct().collect()]
        stored = spark.read.parquet(path).filter(F.col("shard").isin(shards)).select("content_hash")
        rows = rows.join(stored, "content_hash", "left_anti")
    rows.write.mode("append").partitionBy("shard").parquet(path)
