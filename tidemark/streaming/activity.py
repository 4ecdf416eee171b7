"""Streams: activity sessions and day totals over file sources, in append mode behind a watermark.

Each gives the rows of its batch twin whose windows the watermark has closed; availableNow reads what is there in micro-batches and stops.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = 90


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(schema)
    rows = reader.parquet(folder) if _is_folder(spark, folder) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # event time must be of this type


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def sessions(events: DataFrame, gap: int = GAP) -> DataFrame:
    """user_id, start, end, touches: touches of a user at most ``gap`` seconds apart; a session ends ``gap`` seconds after its last touch."""
    return events.where("user_id is not null").withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.count(F.lit(1)).alias("touches"))


def day_totals(events: DataFrame) -> DataFrame:
    """day, event_type, events, value: tumbling days."""
    rows = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))
    return rows.select(F.col("w.start").cast("date").alias("day"), "event_type", "events", "value")


def drain(stream: DataFrame) -> DataFrame:
    """What the stream gives for good for the files there now, as a table; state and offsets go to the session's shared folder.

    Append mode: a window comes out once, when the watermark has passed its end, and its state is dropped then; so state stays as small as the windows that are
    still open, and rows later than the watermark are left out. Open windows come out when later files move the watermark.
    """
    from tidemark.session import ensure_checkpoint_dir

    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"drained_{uuid.uuid4().hex}"
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    written = f"{root}/{name}_table"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", written).option("checkpointLocation", f"{root}/{name}_state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(written)
