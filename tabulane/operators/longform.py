"""From one wide row of aggregates to several rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_rows(one_row: DataFrame, parts: list[Column]) -> DataFrame:
    """One row per struct in `parts`, built from the columns of a one-row table."""
    return one_row.select(F.explode(F.array(*parts)).alias("_r")).select("_r.*")
