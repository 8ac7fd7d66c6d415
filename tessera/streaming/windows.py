"""Event windows that run alike on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """Counts and sums per event type and hour; ``ts`` is a timestamp."""
    out = events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", F.col("w.start").alias("hour"), "n", "total")


def read_events(spark: SparkSession, path: str, late: str = "2 hours") -> DataFrame:
    """A stream over parquet files in ``path``, with a watermark; stored local timestamps are read as UTC."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def hourly_to_table(spark: SparkSession, path: str, out: str, checkpoint: str):
    """Run what is there through the stream and append closed hours to parquet; restarts go on where they stopped."""
    q = hourly(read_events(spark, path)).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
