"""Post-processing of one column, always in the order clip, round, missing, cast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.functions import scalars as S
from tabulane.functions.formula import kind_of
from tabulane.functions.uniform import uniform

# Logical types a column can be cast to.
CAST_TO = {"int": "long", "float": "double", "bool": "boolean", "category": "string", "string": "string"}


def cast_column(col: Column, kind: str, dtype: str) -> Column:
    """int truncates toward zero, bool is "not zero"; text stays text."""
    if dtype not in CAST_TO:
        raise ValueError(f"unknown dtype '{dtype}'")
    numeric = kind in ("int", "num", "bool")
    if dtype in ("int", "float"):
        return col.cast(CAST_TO[dtype]) if numeric else col
    if dtype == "bool":
        return (col.cast("double") != 0) if numeric else col
    return col.cast("string")


def post_column(
    df: DataFrame,
    col: str,
    clip_min: float | None = None,
    clip_max: float | None = None,
    round_decimals: int | None = None,
    missing_rate: float | None = None,
    dtype: str | None = None,
    seed: int = 0,
    key: str = "row_id",
    hashing: str = "md5",
) -> Column:
    """The post-processed value of a column of `df`."""
    if clip_min is not None and clip_max is not None and clip_min > clip_max:
        raise ValueError("clip_min must not exceed clip_max")
    if round_decimals is not None and not 0 <= round_decimals <= 10:
        raise ValueError("round_decimals must be between 0 and 10")
    if missing_rate is not None and not 0 <= missing_rate <= 1:
        raise ValueError("missing_rate must be between 0 and 1")
    kind, value = kind_of(df.schema[col].dataType), F.col(f"`{col}`")
    if kind in ("int", "num"):
        if clip_min is not None or clip_max is not None:
            low = None if clip_min is None else F.lit(float(clip_min))
            high = None if clip_max is None else F.lit(float(clip_max))
            value = S.clip(value.cast("double"), low, high)
        if round_decimals is not None:
            value = S.round_half_even(value.cast("double"), round_decimals)
    if missing_rate:
        gone = uniform(seed, f"{col}:missing", 0, F.col(key), hashing) < F.lit(float(missing_rate))
        value = F.when(~gone, value)
    return cast_column(value, kind, dtype) if dtype else value


def post_process(df: DataFrame, col: str, **settings) -> DataFrame:
    """Replace a column by its post-processed value (settings as in `post_column`)."""
    return df.withColumn(col, post_column(df, col, **settings))
