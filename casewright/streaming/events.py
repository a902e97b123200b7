"""Structured Streaming forms of the late-data rule, beside their batch twins.

The engine's rule for late data is to replace whole recent months, not to add to them. Here
that is a watermark of 60 days over event time and a sink that overwrites affected months.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "60 days"


def read_events(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("parquet").schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return _counts(events, F.window("ts", width))


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day") -> DataFrame:
    return _counts(events, F.window("ts", width, slide))


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _counts(events: DataFrame, window) -> DataFrame:
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


def deduplicated(events: DataFrame) -> DataFrame:
    """One row per event id; on a stream, ids are remembered within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming query over what there is and return its result table (tests and small results)."""
    name = "s" + uuid.uuid4().hex
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def to_month_tables(stream: DataFrame, path: str, checkpoint: str):
    """Append each batch's cases and rewrite the months they fall into: replace, never add twice.

    ``stream``: rows with ``month`` and ``complaint_id``. A replayed batch leaves the table as it was.
    """

    def replace(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(["complaint_id"]).persist()
        months = [r[0] for r in batch.select("month").distinct().collect()]
        if months:
            merged = batch
            if _exists(spark, path):
                old = spark.read.schema(batch.schema).parquet(path).where(F.col("month").isin(months))
                merged = old.join(batch.select("complaint_id"), "complaint_id", "left_anti").select(*batch.columns).unionByName(batch)
            staged = f"{path}.staged"
            merged.write.mode("overwrite").partitionBy("month").parquet(staged)
            spark.read.schema(batch.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
