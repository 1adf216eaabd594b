"""Lookups, key joins and group values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.functions.formula import kind_of
from tabulane.functions.scalars import as_key, present_column
from tabulane.operators.skew import dimension_join
from tabulane.session import cut_lineage

MAX_LITERAL = 200  # entries of a lookup table kept as a literal of the plan; larger ones are joined


def _typed(table: dict, default: Any) -> tuple[str, dict, Any]:
    """(type, entries, default) of a literal table: text if any entry is text, else numbers; the same however the table is used."""
    text = any(isinstance(v, str) for v in table.values()) or (not table and isinstance(default, str))

    def one(v: Any) -> Any:
        return None if v is None else str(v) if text else float(v)

    return ("string" if text else "double"), {str(k): one(v) for k, v in table.items()}, one(default)


def map_column(key: Column, table: dict, default: Any = 0, on_missing: str = "default", name: str = "table") -> Column:
    """Value of `key` (already text) in a small literal table."""
    dtype, entries, default = _typed(table, default)
    if on_missing == "error":
        other = F.raise_error(F.concat(F.lit(f"no entry in '{name}' for key "), F.coalesce(key, F.lit("NULL")))).cast(dtype)
    else:
        other = F.lit(default).cast(dtype)
    if not table:
        return other
    pairs = [part for k, v in entries.items() for part in (F.lit(k), F.lit(v).cast(dtype))]
    return F.coalesce(F.create_map(*pairs)[key], other)


def _key(df: DataFrame, key: str) -> Column:
    return as_key(F.col(key), kind_of(df.schema[key].dataType) == "bool")


def lookup(
    df: DataFrame,
    key: str,
    table: dict | DataFrame,
    output: str,
    default: Any = 0,
    on_missing: str = "default",
    table_key: str = "key",
    table_value: str = "value",
    name: str = "table",
) -> DataFrame:
    """Add `output` = table[key] compared as text; a key without entry gives `default` or an error.

    A small dict becomes a literal. A DataFrame (one row per key; a repeated key
    fails) or a large dict is joined: by broadcast if its counted size allows, else by shuffle with hot keys spread out.
    """
    if isinstance(table, dict) and len(table) <= MAX_LITERAL:
        return df.withColumn(output, map_column(_key(df, key), table, default, on_missing, name))
    if isinstance(table, dict):
        dtype, entries, default = _typed(table, default)
        table = df.sparkSession.createDataFrame(list(entries.items()), f"key string, value {dtype}")
        table_key, table_value = "key", "value"
    repeats = F.raise_error(F.concat(F.lit(f"repeated entry in '{name}' for key "), F.col("_lookup_key")))
    side = (
        table.select(F.col(table_key).cast("string").alias("_lookup_key"), F.col(table_value).alias("_lookup_value"))
        .filter(F.col("_lookup_key").isNotNull())
        .groupBy("_lookup_key")
        .agg(F.first("_lookup_value").alias("_lookup_value"), F.count(F.lit(1)).alias("_times"))
        .select("_lookup_key", "_lookup_value", F.when(F.col("_times") > 1, repeats.cast("boolean")).otherwise(True).alias("_lookup_hit"))
    )
    joined = dimension_join(df.withColumn("_lookup_key", _key(df, key)), side, ["_lookup_key"], "left")
    dtype = table.schema[table_value].dataType
    if on_missing == "error":
        other = F.raise_error(F.concat(F.lit(f"no entry in '{name}' for key "), F.coalesce("_lookup_key", F.lit("NULL")))).cast(dtype)
    else:
        other = F.lit(default).cast(dtype)
    value = F.when(F.col("_lookup_hit"), F.col("_lookup_value")).otherwise(other)
    return joined.withColumn(output, value).drop("_lookup_key", "_lookup_value", "_lookup_hit")


def map_values(df: DataFrame, key: str, mapping: dict, output: str, default: Any = 0) -> DataFrame:
    """Inline mapping with a default."""
    return lookup(df, key, mapping, output, default)


def join_chain(first: DataFrame, steps: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Inner equi-joins one after the other; each step is (table, key columns of the same name).

    Hot keys are looked for in the input table a key comes from, so no join runs twice.
    """
    result, inputs = first, [first]
    for table, keys in steps:
        source = next((t for t in inputs if set(keys) <= set(t.columns)), result)
        result = dimension_join(result, table, keys, "inner", hot_in=source)
        inputs.append(table)
    return result


def exists_match(df: DataFrame, other: DataFrame, keys: list[str], condition: Column | None = None) -> DataFrame:
    """Rows of `df` that have a match in `other` (rows meeting `condition`).

    `other` is reduced to distinct keys before its shuffle, so a key repeated there costs nothing.
    """
    if condition is not None:
        other = other.filter(condition)
    return dimension_join(df, other.select(*keys).distinct(), keys, "left_semi")


def group_value(df: DataFrame, by: str, value: Column, output: str, row_key: list[str] | None = None) -> DataFrame:
    """One aggregate value per category, on every row of the category; NaN is missing."""
    known = df.select(*[present_column(df, c).alias(c) for c in df.columns])
    groups = cut_lineage(known.groupBy(by).agg(value.alias(output)))  # measured and joined, but computed once
    return dimension_join(df, groups, [by], "left", salt_by=row_key)


def first_per_group(df: DataFrame, by: str, order: str, cols: list[str]) -> DataFrame:
    """The row with the lowest `order` of each category (partial aggregation, no window)."""
    row = F.struct(*[F.col(c) for c in cols])
    return df.groupBy(by).agg(F.min_by(row, F.col(order)).alias("_row")).select(by, "_row.*")
