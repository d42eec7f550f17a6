"""Incremental ingest (I01-I07) with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlake.sources.growing import GrowingFiles
from threadlake.sources.sinks import new_rows


def _append(source: DataFrame, table: str, checkpoint: str, key: list[str], seq: str, every: str | None) -> StreamingQuery:
    """Appends a stream's rows to a Parquet table, once for each key; a batch that is run again finds its rows there and adds none."""

    def append(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        exists = own._jvm.org.apache.hadoop.fs.Path(table)
        there = exists.getFileSystem(own._jsparkSession.sessionState().newHadoopConf()).exists(exists)
        known = own.read.schema(batch.schema).parquet(table) if there else None
        new_rows(batch, known, key, seq).write.mode("append").parquet(table)

    writer = source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def tail(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, key: list[str], seq: str, every: str | None = None) -> StreamingQuery:
    """Appends new files' rows to a Parquet table, once for each key; without `every`, all there is and then stops."""
    return _append(spark.readStream.schema(schema).json(folder), table, checkpoint, key, seq, every)


def follow(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, key: list[str], seq: str, every: str | None = None, pattern: str = "*.jsonl") -> StreamingQuery:
    """As tail, for files that are still written: takes up each where it was left, begins anew what shrank or was replaced.

    Lines that are no JSON object have nulls in all columns and are left out, as is a line without the key.
    """
    spark.dataSource.register(GrowingFiles)
    lines = spark.readStream.format("growing_files").option("pattern", pattern).load(folder)
    rows = lines.select(F.from_json("line", schema).alias("row")).select("row.*").dropna(subset=key)
    return _append(rows, table, checkpoint, key, seq, every)


def windowed_counts(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """I07 (an extension): events by type in tumbling windows, late ones up to `delay`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def ema(old: DataFrame, new: DataFrame, key: str, value: str, window: int) -> DataFrame:
    """Stored means moved towards a batch's by its share of the window."""
    fresh = new.groupBy(key).agg(F.avg(value).alias("_v"), F.count("*").alias("_n"))
    alpha = F.least(F.lit(1.0), F.col("_n") / window)
    return old.join(fresh, key, "full_outer").select(key, F.coalesce(F.col(value) + alpha * (F.col("_v") - F.col(value)), F.col(value), F.col("_v")).alias(value))
