"""Key figures of a usage event table and their gates.

Event columns: event_type, path_id, latency_ms, metadata (JSON text), created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.operators.longform import to_rows
from tabulane.operators.percentiles import exact_percentiles
from tabulane.operators.projection import trailing_window

# The figures, and the gates they have to pass.
KPIS = (
    "visible_primary_actions",
    "avg_pointer_travel_px",
    "familiar_pattern_coverage_pct",
    "avg_clicks_happy_path",
    "manual_orchestration_steps",
    "progress_feedback_coverage_pct",
    "p95_feedback_latency_ms",
    "completion_rate_pct",
)
GATES = [
    ("phase1", "visible_primary_actions", "<=", 7.0),
    ("phase1", "avg_clicks_happy_path", "<=", 10.0),
    ("phase1", "manual_orchestration_steps", "<=", 2.0),
    ("phase1", "p95_feedback_latency_ms", "<=", 700.0),
    ("phase2", "avg_clicks_happy_path", "<=", 10.0),
    ("phase2", "completion_rate_pct", ">=", 80.0),
    ("phase2", "progress_feedback_coverage_pct", ">=", 65.0),
    ("phase3", "avg_pointer_travel_px", "<=", 360.0),
    ("phase3", "familiar_pattern_coverage_pct", ">=", 75.0),
    ("phase3", "avg_clicks_happy_path", "<=", 9.0),
    ("phase4", "visible_primary_actions", "<=", 5.0),
    ("phase4", "avg_pointer_travel_px", "<=", 260.0),
    ("phase4", "familiar_pattern_coverage_pct", ">=", 85.0),
    ("phase4", "avg_clicks_happy_path", "<=", 8.0),
    ("phase4", "manual_orchestration_steps", "<=", 1.0),
    ("phase4", "progress_feedback_coverage_pct", ">=", 85.0),
    ("phase4", "p95_feedback_latency_ms", "<=", 400.0),
    ("phase4", "completion_rate_pct", ">=", 90.0),
]

# Typed reads: a JSON string such as "5" is not a number and reads as NULL.
AS_NUMBER = "count DOUBLE, pointer_travel_px DOUBLE, familiar_pattern DOUBLE"
AS_BOOLEAN = "count BOOLEAN, pointer_travel_px BOOLEAN, familiar_pattern BOOLEAN, user_initiated BOOLEAN"


def event_facts(df: DataFrame) -> DataFrame:
    """Per event the few values the figures are made of."""
    # parsed in a projection of their own, so each row is parsed twice and not once per field
    df = df.withColumns({"_numbers": F.from_json("metadata", AS_NUMBER), "_booleans": F.from_json("metadata", AS_BOOLEAN)})
    numbers, booleans = F.col("_numbers"), F.col("_booleans")

    def number(field: str) -> Column:  # true and false count as 1 and 0
        return F.coalesce(numbers.getField(field), booleans.getField(field).cast("double"))

    event, path = F.col("event_type"), F.nullif(F.col("path_id"), F.lit(""))
    on_path = path.isNotNull()
    slow = (event == "feedback_latency") & F.coalesce(booleans.getField("user_initiated"), F.lit(True))
    return df.select(
        *[c for c in ("created_at",) if c in df.columns],
        path.alias("path_id"),
        F.when(event == "visible_actions_snapshot", number("count").cast("long")).alias("visible"),
        ((event == "click") & on_path).alias("is_click"),
        ((event == "flow_started") & on_path).alias("is_started"),
        ((event == "flow_completed") & on_path).alias("is_completed"),
        F.when(slow, F.col("latency_ms")).alias("latency"),
        (event == "manual_orchestration").alias("is_manual"),
        (event == "progress_feedback").alias("is_progress"),
        number("pointer_travel_px").alias("pointer"),
        (number("familiar_pattern") > 0).cast("double").alias("familiar"),
    )


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def figures(p95: Column) -> dict[str, Column]:
    """The figures from the sums clicks, paths, started, completed, manual, progress and the rest."""
    started = F.col("started")
    return {
        "visible_primary_actions": F.coalesce(F.col("visible").cast("double"), F.lit(0.0)),
        "avg_pointer_travel_px": F.coalesce(F.col("pointer"), F.lit(0.0)),
        "familiar_pattern_coverage_pct": F.coalesce(F.col("familiar") * 100, F.lit(0.0)),
        "avg_clicks_happy_path": share(F.col("clicks"), F.col("paths")),
        "manual_orchestration_steps": F.col("manual").cast("double"),
        "progress_feedback_coverage_pct": F.least(F.lit(100.0), share(F.col("progress"), started) * 100),
        "p95_feedback_latency_ms": F.coalesce(p95.cast("double"), F.lit(0.0)),
        "completion_rate_pct": share(F.col("completed"), started) * 100,
    }


def kpi_snapshot(df: DataFrame, as_of, hours: int = 168, day_column: str | None = None, **equal) -> DataFrame:
    """(kpi, value) over the last `hours` before `as_of`; `equal` filters columns, as user_id="u".

    One aggregate for all counts; the exact 95th percentile comes from counting rounds. Naming the day
    partition of the event table in `day_column` keeps older days from being read.
    """
    facts = event_facts(trailing_window(df, "created_at", hours, as_of, day_column, **equal))
    p95 = exact_percentiles(facts, {"latency": F.col("latency")}, [0.95])["latency"][0]
    one = facts.agg(
        F.max("visible").alias("visible"),
        F.avg("pointer").alias("pointer"),
        F.avg("familiar").alias("familiar"),
        F.count_if("is_click").alias("clicks"),
        F.count_distinct(F.when(F.col("is_click"), F.col("path_id"))).alias("paths"),
        F.count_if("is_manual").alias("manual"),
        F.count_if("is_progress").alias("progress"),
        F.count_if("is_started").alias("started"),
        F.count_if("is_completed").alias("completed"),
    )
    value = figures(F.lit(p95))
    rows = [F.struct(F.lit(k).alias("kpi"), value[k].alias("value")) for k in KPIS]
    return to_rows(one, rows)


def kpi_gate(kpis: DataFrame, targets: DataFrame | None = None, phase: str | None = None) -> DataFrame:
    """(phase, kpi, op, target, value, passed) for the gates; a missing figure counts as 0."""
    if targets is None:
        targets = kpis.sparkSession.createDataFrame(GATES, "phase string, kpi string, op string, target double")
    if phase is not None:
        targets = targets.filter(F.col("phase") == phase)
    value = F.coalesce(F.col("value"), F.lit(0.0))
    passed = (
        F.when(F.col("op") == "<=", value <= F.col("target"))
        .when(F.col("op") == ">=", value >= F.col("target"))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported operator "), F.col("op"))).cast("boolean"))
    )
    joined = targets.join(kpis.select("kpi", "value"), "kpi", "left")
    return joined.select("phase", "kpi", "op", "target", value.alias("value"), passed.alias("passed"))
