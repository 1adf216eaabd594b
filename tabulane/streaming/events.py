"""Continuous ingestion of events, and key figures per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulane.operators.kpi import KPIS, event_facts, figures
from tabulane.sources.events import EVENT_SCHEMA, normalize_events


def read_event_stream(spark: SparkSession, src: str, fmt: str = "json", schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(src)


def ingest_stream(
    spark: SparkSession, src: str | DataFrame, dst: str, checkpoint: str, fmt: str = "json", schema: str = EVENT_SCHEMA
) -> StreamingQuery:
    """Append new event files of `src` (or a stream of events) to the table at `dst`, then stop.

    Which files are done is kept in `checkpoint`, so a restart neither loses nor repeats events.
    """
    stream = read_event_stream(spark, src, fmt, schema) if isinstance(src, str) else src
    writer = normalize_events(stream).writeStream.format("parquet").partitionBy("date").outputMode("append")
    query = writer.option("path", dst).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def kpi_stream(stream: DataFrame, window: str = "1 day", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """One row of figures per event-time window; rows later than the watermark are dropped.

    First step per window and item (a path, or a whole-millisecond latency): counts, combined before
    the shuffle. Second step per window: distinct paths are the paths seen, and the exact percentile
    weighs each latency with its count. State is one row per path or latency value, not per event,
    and no path or latency value is collected into a list.
    """
    facts = event_facts(stream.withColumn("created_at", F.col("created_at").cast("timestamp")))
    facts = facts.withWatermark("created_at", lateness)
    latency = F.col("latency").cast("long")
    item = F.when(latency.isNotNull(), F.concat(F.lit("ms:"), latency.cast("string"))).otherwise(
        F.concat(F.lit("path:"), F.coalesce("path_id", F.lit("")))
    )
    span = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    items = facts.groupBy(span, item.alias("item")).agg(
        F.max("visible").alias("visible"),
        F.sum("pointer").alias("pointer_sum"),
        F.count("pointer").alias("pointer_n"),
        F.sum("familiar").alias("familiar_sum"),
        F.count("familiar").alias("familiar_n"),
        F.count_if("is_click").alias("clicks"),
        F.count_if("is_manual").alias("manual"),
        F.count_if("is_progress").alias("progress"),
        F.count_if("is_started").alias("started"),
        F.count_if("is_completed").alias("completed"),
        F.max(latency).alias("latency"),
        F.count(latency).alias("latency_n"),
    )
    sums = items.groupBy("window").agg(
        F.max("visible").alias("visible"),
        F.try_divide(F.sum("pointer_sum"), F.sum("pointer_n")).alias("pointer"),
        F.try_divide(F.sum("familiar_sum"), F.sum("familiar_n")).alias("familiar"),
        F.sum("clicks").alias("clicks"),
        F.count_if(F.col("clicks") > 0).alias("paths"),
        F.sum("manual").alias("manual"),
        F.sum("progress").alias("progress"),
        F.sum("started").alias("started"),
        F.sum("completed").alias("completed"),
        F.percentile("latency", F.lit(0.95), F.greatest("latency_n", F.lit(1))).alias("p95"),
    )
    value = figures(F.col("p95"))
    return sums.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[value[k].alias(k) for k in KPIS]
    )
