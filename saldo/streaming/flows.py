"""Flows from an event stream: watermarked daily sums, drained through a memory-free Parquet sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.lineage import shared_folder


def daily(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Count and sum by type and day of a stream of (ts, event_type, value); late events beyond the watermark go."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", lateness).groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def daily_flows(spark: SparkSession, sf_dir: str, files_per_batch: int = 16) -> DataFrame:
    """All events of sf_dir, one file or a folder of them, as one drained stream of batches of `files_per_batch` files.

    The stream is bounded, so the watermark is as wide as its time span and no event is late, whichever
    order its files come in. Batches and state go to the folder of spark.checkpoint.dir.
    """
    path = f"{sf_dir}/events.parquet"
    static = spark.read.parquet(path)
    span = static.agg(F.datediff(F.max("ts"), F.min("ts")).alias("days")).first()["days"] or 0
    events = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a path has to be a folder
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = f"{shared_folder(spark)}/flows-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.select("event_type", F.col("window.start").alias("day"), "n", "value", F.lit(epoch).alias("epoch")).write.mode("overwrite").parquet(f"{at}/out/epoch={epoch:06d}")

    run = daily(events, f"{span + 2} days").writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    out = spark.read.schema("event_type string, day timestamp, n long, value double").option("basePath", f"{at}/out").option("recursiveFileLookup", "true").parquet(f"{at}/out")
    return out.groupBy("event_type", "day").agg(F.max_by("n", "n").alias("n"), F.max_by("value", "n").alias("value"))
