"""Checks of readers, writers, checksums and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulane.operators.projection import split_flag
from tabulane.queries.base import rounded, scratch, table
from tabulane.queries.profiles import FIGURES, USAGE_EVENTS, usage_events
from tabulane.operators.kpi import KPIS
from tabulane.sources import events as E
from tabulane.sources import tables as S
from tabulane.streaming.events import ingest_stream, kpi_stream

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _roundtrip(fmt):
    def run(spark, d):
        od = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
        path = scratch(spark, f"orders-{fmt}")
        S.write_table(od, path, fmt, seed=42)
        if fmt == "json":
            return spark.read.schema(od.schema).json(path)
        back = S.load_source(spark, {"path": path, "format": fmt})
        return back.select(*[F.col(n).cast(t).alias(n) for n, t in od.dtypes])

    return run


def append_events(spark, d):
    """Two appends; a missing type becomes "unknown"."""
    ev = usage_events(table(spark, d, "events")).withColumn("event_type", F.nullif("event_type", F.lit("click")))
    path = scratch(spark, "events")
    late = split_flag(F.col("user_id"), 0.5, 1)
    E.append_events(ev.filter(~late), path)
    E.append_events(ev.filter(late), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("date").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").cast("long").alias("latency"))


APPEND_EVENTS = f"""
SELECT CAST(ts AS DATE) AS day, CASE WHEN kind = 'click' THEN 'unknown' ELSE kind END AS event_type, count(*) AS n,
  CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS latency FROM ({USAGE_EVENTS}) GROUP BY 1, 2"""


def file_fingerprint(spark, d):
    return S.file_fingerprint(spark, f"{d}/orders.parquet")


def table_checksum(spark, d):
    od = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return S.table_checksum(od)


TABLE_CHECKSUM = """
SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_orderpriority, o_orderstatus)), 1, 13)) AS BIGINT)) AS VARCHAR) AS checksum
FROM orders"""


KEYS_A_FILE = 1000


def file_digests(spark, d):
    """The orders as text files of a range of keys each, sorted within: size and digest per file."""
    path = scratch(spark, "order-files")
    od = table(spark, d, "orders").select(
        F.floor(F.col("o_orderkey") / KEYS_A_FILE).alias("part"), "o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("line")
    )
    rows = od.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "line")
    rows.write.partitionBy("part").option("lineSep", "\n").text(path)
    files = S.file_digests(spark, f"{path}/part=*/*.txt")
    return files.select(F.regexp_extract("path", "part=(-?[0-9]+)", 1).cast("long").alias("part"), "bytes", "sha256")


FILE_DIGESTS = f"""
SELECT part, strlen(t) AS bytes, sha256(t) AS sha256 FROM (
  SELECT CAST(floor(o_orderkey / CAST({KEYS_A_FILE} AS DOUBLE)) AS BIGINT) AS part,
    string_agg(o_orderkey || '|' || o_orderpriority, chr(10) ORDER BY o_orderkey) || chr(10) AS t FROM orders GROUP BY 1)"""


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return usage_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


def ingest_events(spark, d):
    path = scratch(spark, "ingested")
    ingest_stream(spark, _event_stream(spark, d), path, scratch(spark, "ingest-state"))
    return spark.read.parquet(path).select("user_id", "event_type", "latency_ms", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def kpi_windows(spark, d):
    """Figures per day from the stream; the last, unfinished day is not out yet."""
    path = scratch(spark, "kpi")
    figures = kpi_stream(_event_stream(spark, d), "1 day", None, "1 hour")
    query = (
        figures.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", scratch(spark, "kpi-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    back = spark.read.parquet(path)
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return rounded(back.select(*times, *KPIS), 5)


KPI_WINDOWS = f"""
WITH w AS ({USAGE_EVENTS})
SELECT day AS window_start, day + INTERVAL 1 DAY AS window_end, {', '.join(f'round(CAST({k} AS DOUBLE), 5) AS {k}' for k in KPIS)}
FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, {FIGURES} FROM w GROUP BY 1)
WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""

CHECKS = {
    "roundtrip_csv": (_roundtrip("csv"), ORDERS),
    "roundtrip_json": (_roundtrip("json"), ORDERS),
    "roundtrip_parquet": (_roundtrip("parquet"), ORDERS),
    "append_events": (append_events, APPEND_EVENTS),
    "file_fingerprint": (file_fingerprint, None),
    "file_digests": (file_digests, FILE_DIGESTS),
    "table_checksum": (table_checksum, TABLE_CHECKSUM),
    "ingest_stream": (
        ingest_events,
        f"SELECT CAST(user_id AS VARCHAR) AS user_id, kind AS event_type, CAST(trunc(value) AS INTEGER) AS latency_ms, ts AS created_at FROM ({USAGE_EVENTS})",
    ),
    "kpi_stream": (kpi_windows, KPI_WINDOWS),
}
