"""Readers, writers, streams and the driver contract."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabulane.operators.kpi import KPIS, kpi_snapshot
from tabulane.operators.projection import trailing_window
from tabulane.sources import events as E
from tabulane.sources import tables as S
from tabulane.streaming.events import ingest_stream, kpi_stream, read_event_stream


def test_csv_is_typed(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2.5,x\n3,4.5,y\n")
    df = S.read_table(spark, str(tmp_path / "t.csv"))
    assert S.schema_list(df) == [{"name": "a", "dtype": "int"}, {"name": "b", "dtype": "float"}, {"name": "c", "dtype": "string"}]
    assert [r[:] for r in S.infer_schema(df).collect()] == [("a", "int"), ("b", "float"), ("c", "string")]
    assert df.count() == 2


def test_refused_sources(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        S.read_table(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(ValueError, match="unsupported format"):
        S.read_table(spark, str(tmp_path / "t.xlsx"))
    with pytest.raises(ValueError, match="'path' or 'rows'"):
        S.load_source(spark, {})


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_write_and_read(spark, tmp_path, fmt):
    df = spark.range(100).select("id", (F.col("id") / 4).alias("v"), F.when(F.col("id") > 5, "t").alias("s"))
    path = str(tmp_path / f"out.{fmt}")
    assert S.write_table(df, path, fmt, seed=7) == 100
    back = spark.read.schema(df.schema).option("header", True).format(fmt).load(path)
    assert S.table_checksum(back).first() == S.table_checksum(df).first()
    if fmt == "json":
        assert spark.read.json(path + "_metadata").first().asDict() == {"rows": 100, "columns": ["id", "v", "s"], "seed": 7}
    with pytest.raises(ValueError):
        S.write_table(df, path, "orc")


def test_generated_source(spark):
    df = S.load_source(spark, {"rows": 50, "columns": [{"name": "x", "dist": "normal", "params": {"mu": 0, "sigma": 1}}], "seed": 3})
    assert df.count() == 50 and df.columns == ["x"]


def test_fingerprint_and_checksum(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc" * 1000)
    row = S.file_fingerprint(spark, str(tmp_path / "f.bin")).first()
    assert row[:] == ("f.bin", 3000, hashlib.sha256(b"abc" * 1000).hexdigest())
    df = spark.range(1000).withColumn("b", F.col("id") * 2)
    assert S.table_checksum(df).first() == S.table_checksum(df.repartition(9).select("b", "id")).first()
    assert S.table_checksum(df).first() != S.table_checksum(df.withColumn("b", F.col("b") + 1)).first()


def test_logical_types(spark):
    df = spark.sql("SELECT 1Y AS a, 1.5F AS b, true AS c, array(1) AS d, current_timestamp() AS e, date'2024-01-01' AS f, 1.5BD AS g, struct(1) AS h")
    assert [s["dtype"] for s in S.schema_list(df)] == ["int", "float", "bool", "object", "datetime", "date", "decimal(2,1)", "object"]


def batch(spark, rows):
    return spark.createDataFrame([("u", *r) for r in rows], "user_id string, event_type string, path_id string, stage string, action string, latency_ms int, metadata string, created_at timestamp")


def test_append_events(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    df = batch(spark, [(None, "p", None, None, 5, None, at), ("click", "p", None, None, None, '{"a": 1}', at + dt.timedelta(days=1))])
    path = str(tmp_path / "events")
    E.append_events(df, path, E.MAX_BATCH)
    E.append_events(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and {r["event_type"] for r in back.collect()} == {"unknown", "click"} and back.filter("metadata = '{}'").count() == 2
    assert sorted(p.name for p in (tmp_path / "events").glob("date=*")) == ["date=2024-01-01", "date=2024-01-02"]
    with pytest.raises(ValueError):
        E.append_events(df, path, 1)


def test_day_partitions_are_pruned(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    path = str(tmp_path / "events")
    E.append_events(batch(spark, [("click", "p", None, None, None, None, at + dt.timedelta(days=i)) for i in range(5)]), path)
    table = spark.read.parquet(path)
    recent = trailing_window(table, "created_at", 24, "2024-01-05T12:00:00", "date")
    assert "(date" in recent._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:40] and recent.count() == 1
    plain = kpi_snapshot(table, "2024-01-05T12:00:00", 48).collect()
    assert plain == kpi_snapshot(table, "2024-01-05T12:00:00", 48, day_column="date", user_id="u").collect()


def event_line(minute, kind, path=None, latency=None, meta=None, day=1):
    at = dt.datetime(2024, 1, day) + dt.timedelta(minutes=minute)
    return json.dumps({"user_id": "u", "event_type": kind, "path_id": path, "latency_ms": latency, "metadata": json.dumps(meta or {}), "created_at": at.isoformat()})


def test_ingest_stream_takes_each_file_once(spark, tmp_path):
    src, dst, state = tmp_path / "src", str(tmp_path / "dst"), str(tmp_path / "state")
    src.mkdir()
    (src / "1.json").write_text("\n".join(event_line(i, "click", "p") for i in range(5)))
    ingest_stream(spark, str(src), dst, state)
    (src / "2.json").write_text(event_line(9, "flow_started", "p"))
    ingest_stream(spark, str(src), dst, state)
    ingest_stream(spark, str(src), dst, state)
    assert {r["event_type"]: r["count"] for r in spark.read.parquet(dst).groupBy("event_type").count().collect()} == {"click": 5, "flow_started": 1}


def test_kpi_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    first = [event_line(i, ["click", "flow_started", "flow_completed", "feedback_latency", "progress_feedback"][i % 5], f"p{i % 3}", i, {"count": i, "pointer_travel_px": i}) for i in range(60)]
    (src / "1.json").write_text("\n".join(first))

    def run():
        query = (
            kpi_stream(read_event_stream(spark, str(src)), "1 hour", None, "10 minutes").writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    (src / "2.json").write_text(event_line(300, "click", "p9"))
    run()
    (src / "3.json").write_text("\n".join([event_line(5, "click", "late"), event_line(900, "click", "p1")]))
    run()
    rows = {r["window_start"]: r for r in spark.read.parquet(out).collect()}
    got = rows[dt.datetime(2024, 1, 1, 0)]
    events = spark.read.schema(E.EVENT_SCHEMA).json(str(src / "1.json"))
    want = {r["kpi"]: r["value"] for r in kpi_snapshot(events, "2024-01-02T00:00:00").collect()}
    assert {k: got[k] for k in KPIS} == pytest.approx(want)
    assert rows[dt.datetime(2024, 1, 1, 5)]["avg_clicks_happy_path"] == 1.0 and len(rows) == 2


def test_sliding_windows(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text("\n".join([event_line(90, "click", "p"), event_line(100, "click", "p"), event_line(150, "click", "p"), event_line(900, "click", "p")]))
    figures = kpi_stream(read_event_stream(spark, str(src)), "2 hours", "1 hour", "1 minute")
    query = (
        figures.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r["window_start"].hour: r["avg_clicks_happy_path"] for r in spark.read.parquet(out).collect()}
    assert got == {0: 2.0, 1: 3.0, 2: 1.0}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["bin", "start", "end", "category", "n", "total"] and df.count() == 30


def test_every_sql_has_a_query():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and len(names) > 90 and len(sql) > 80
