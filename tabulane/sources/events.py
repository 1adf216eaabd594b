"""The usage event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BATCH = 500  # fixed value: events one client batch may hold
EVENT_SCHEMA = (
    "user_id string, event_type string, path_id string, stage string, action string, "
    "latency_ms int, metadata string, created_at timestamp"
)


def normalize_events(df: DataFrame) -> DataFrame:
    """Missing type becomes "unknown", missing metadata an empty object; adds the day partition."""
    return df.na.fill({"event_type": "unknown", "metadata": "{}"}).withColumn("date", F.to_date("created_at"))


def append_events(df: DataFrame, path: str, max_batch: int | None = None) -> None:
    """Append events to the table, partitioned by day. `max_batch` refuses larger batches."""
    if max_batch is not None and len(df.select("event_type").take(max_batch + 1)) > max_batch:
        raise ValueError(f"a batch holds at most {max_batch} events")
    # rebalanced by day: small pieces are put together, a large day is split over several files
    normalize_events(df).hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)
