"""New codes by batch over a stream of assignment files.

Two forms: a foreachBatch sink that adds to the first-seen table in the store and reads the curve and the spikes from it, and a
stateful aggregation that keeps the first batch of every code in Spark's own state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.growth import spikes

ASSIGNMENT = "response_id bigint, code string"


def read_assignments(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(ASSIGNMENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def curve(spark: SparkSession, store: str) -> DataFrame:
    """(batch, new_codes) of all micro-batches so far; batches without a new code are there with 0."""
    first = spark.read.parquet(f"{store}/first_seen").groupBy("code").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("new_codes"))
    seen = spark.read.parquet(f"{store}/batches").select("batch").distinct()
    return seen.join(first, "batch", "left").select("batch", F.coalesce("new_codes", F.lit(0)).alias("new_codes"))


def start(assignments: DataFrame, store: str, checkpoint: str):
    """Run over what is there and stop. A micro-batch overwrites its own partition, so a repeated one changes nothing."""

    def each(rows: DataFrame, batch: int) -> None:
        rows.select("code").distinct().write.mode("overwrite").parquet(f"{store}/first_seen/batch={batch + 1}")
        rows.agg(F.countDistinct("response_id").alias("responses")).write.mode("overwrite").parquet(f"{store}/batches/batch={batch + 1}")

    return assignments.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spikes_so_far(spark: SparkSession, store: str) -> DataFrame:
    return spikes(curve(spark, store))


def first_seen(assignments: DataFrame) -> DataFrame:
    """The same first appearances as a streaming aggregation: the least response of every code, in update mode."""
    return assignments.groupBy("code").agg(F.min("response_id").alias("first_response"), F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type) per window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
