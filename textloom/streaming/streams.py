"""Structured Streaming counterparts of the window operators, over the events table.

Each takes a streaming (or static) DataFrame and returns one.  ``run_once``
runs a stream to the end of what is there, with its state and checkpoint in
the shared folder, and returns the result table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.session import shared_dir

LATE = "400 days"  # the events come as one file in no order; a live source has minutes here


def read_events(spark: SparkSession, sf_dir: str, late: str = LATE) -> DataFrame:
    """Events as a stream, with a watermark on their time; events without time are left out."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a file source reads folders; the glob takes the one table
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    return raw.where("ts is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def tumbling(events: DataFrame, width: str, by: list[str] | None = None) -> DataFrame:
    """(start, by, n, total, mean) of fixed windows."""
    by = ["event_type"] if by is None else by
    agg = events.groupBy(F.window("at", width), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.avg("value").alias("mean"))
    out = agg.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *by, "n", "total", "mean")
    return out.drop("mean") if by else out.drop("total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window("at", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, n, total): runs of a user's events less than ``gap`` apart."""
    agg = events.where("user_id is not null").groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return agg.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", "total")


def first_seen(events: DataFrame, key: str) -> DataFrame:
    """Each key once, within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def window_drift(windows: DataFrame) -> DataFrame:
    """(start, n, drift): change of the mean from one window to the next; windows are few."""
    order = Window.orderBy("start")
    return windows.select("start", "n", F.round(F.col("mean") - F.lag("mean").over(order), 6).alias("drift"))


def run_once(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """The result of a stream over all that is there.

    ``complete`` results replace each other, batch by batch; ``append`` ones
    are added as the watermark closes them, so that windows still open at the
    end of a bounded source are missing: take ``complete`` there.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/textloom-stream-{name}-{uuid.uuid4().hex}"

    if not stream.isStreaming:
        return stream

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
