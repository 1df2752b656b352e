"""Event-time aggregation of turn logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def activity(events: DataFrame, *, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; rows later than the watermark are dropped by the stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    g = timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over what is there now; its rows are written to folder/out by one overwrite or append a batch, and read back."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
