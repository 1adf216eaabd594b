"""Helpers of the check queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulane.session import shared_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, since engines add in different order."""
    return df.select(
        *[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" and n not in skip else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def u_sql(seed: int, name: str, draw: int, key: str) -> str:
    """The uniform draw in SQL."""
    text = f"'{seed}|{name}|{draw // 2}|' || CAST({key} AS VARCHAR)"
    start = (1, 17)[draw % 2]
    return f"((CAST(('0x' || substr(md5({text}), {start}, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"


def normal_sql(seed: int, name: str, key: str, draw: int = 0) -> str:
    u1, u2 = u_sql(seed, name, draw, key), u_sql(seed, name, draw + 1, key)
    return f"(sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2}))"


def even_sql(x: str, digits: int) -> str:
    """Scale, round half to even, scale back."""
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    return f"(round_even(({x}) * {scale}, 0) / {scale})" if digits else f"round_even({x}, 0)"
