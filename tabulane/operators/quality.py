"""Row constraints: flags, report and quarantine.

A constraint is a dict: {"type": "range", "target", "min"?, "max"?}, {"type": "not_null", "target"},
{"type": "unique", "target"}, {"type": "comparison", "target", "operator", "other"}.
A missing value passes every constraint but not_null, as in an SQL CHECK.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.functions.scalars import present_column
from tabulane.operators.longform import to_rows
from tabulane.operators.skew import salted_join

# Comparison operators of a constraint.
COMPARE = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def label(c: dict) -> str:
    """Reason text of a constraint."""
    if c["type"] == "comparison":
        return f"{c['target']} {c['operator']} {c['other']}"
    return f"{c['type']}({c['target']})"


def _condition(df: DataFrame, c: dict) -> Column:
    """Condition a row must meet; NULL and NaN count as met, but for not_null."""
    target = present_column(df, c["target"])
    if c["type"] == "range":
        ok = F.lit(True)
        if c.get("min") is not None:
            ok = ok & (target >= F.lit(c["min"]))
        if c.get("max") is not None:
            ok = ok & (target <= F.lit(c["max"]))
        return F.coalesce(ok, F.lit(True))
    if c["type"] == "not_null":
        return target.isNotNull()
    if c["type"] == "comparison":
        if c.get("operator") not in COMPARE or not c.get("other"):
            raise ValueError("a comparison needs 'other' and one of < <= > >=")
        return F.coalesce(COMPARE[c["operator"]](target, present_column(df, c["other"])), F.lit(True))
    raise ValueError(f"unknown constraint type '{c['type']}'")


def _unique_flag(df: DataFrame, target: str, key: list[str], flag: str) -> DataFrame:
    """False for rows whose `target` value already occurs on a row with a lower key.

    Rows that share the lowest key of their value all fail, since none of them can be called the first: a repeated key hides no duplicate.
    Rows are counted per value and key first, so one value on a third of all rows is not one task. Only repeated values are joined back,
    with the often repeated ones spread out.
    """
    row_key = F.struct(*key) if len(key) > 1 else F.col(f"`{key[0]}`")  # one plain column keeps the aggregate a hash aggregate
    known = df.filter(present_column(df, target).isNotNull())
    pairs = known.groupBy(F.col(f"`{target}`").alias("_value"), row_key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    first = pairs.groupBy("_value").agg(
        F.min("_key").alias("_first"),
        F.min(F.when(F.col("_n") > 1, F.col("_key"))).alias("_shared"),
        F.sum("_n").alias("_times"),
    )
    # rows without a key are never the first of a repeated value
    repeated = first.filter(F.col("_times") > 1).withColumnRenamed("_value", target)
    repeated = repeated.select(f"`{target}`", "_first", F.coalesce(F.col("_shared") == F.col("_first"), F.lit(False)).alias("_tie"), F.lit(True).alias("_again"))
    joined = salted_join(df, repeated, [target], "left", salt_by=key)
    ok = F.col("_again").isNull() | (~F.col("_tie") & F.coalesce(row_key == F.col("_first"), F.lit(False)))
    return joined.withColumn(flag, ok).drop("_first", "_tie", "_again").select(*df.columns, flag)


def check(df: DataFrame, constraints: list[dict], key: str | list[str] | None = None, prefix: str = "_ok_") -> DataFrame:
    """Add one boolean column per constraint (`_ok_0`, `_ok_1`, ...). `unique` needs a row key."""
    columns = df.columns
    for c in constraints:
        for name in [c["target"]] + ([c["other"]] if c.get("other") else []):
            if name not in columns:
                raise ValueError(f"constraint on unknown column '{name}'")
    keys = [key] if isinstance(key, str) else key
    plain = {f"{prefix}{i}": _condition(df, c) for i, c in enumerate(constraints) if c["type"] != "unique"}
    result = df.withColumns(plain) if plain else df
    for i, c in enumerate(constraints):
        if c["type"] == "unique":
            if not keys:
                raise ValueError("a unique constraint needs the key of a row")
            result = _unique_flag(result, c["target"], keys, f"{prefix}{i}")
    return result


def _flags(constraints: list[dict], prefix: str = "_ok_") -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(len(constraints))]


def constraint_report(df: DataFrame, constraints: list[dict], key: str | list[str] | None = None) -> DataFrame:
    """(type, target, failures, pass_rate): a row for the whole table, then one per failed constraint."""
    flags = _flags(constraints)
    all_ok = reduce(lambda a, b: a & b, flags, F.lit(True))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(all_ok).alias("good")]
    aggs += [F.count_if(~f).alias(f"f{i}") for i, f in enumerate(flags)]
    one = check(df, constraints, key).agg(*aggs)
    rate = F.coalesce(F.try_divide(F.col("good").cast("double"), F.col("n").cast("double")), F.lit(1.0))
    rows = [
        F.struct(
            F.lit("all").alias("type"), F.lit("").alias("target"), (F.col("n") - F.col("good")).alias("failures"), rate.alias("pass_rate")
        )
    ]
    for i, c in enumerate(constraints):
        n = F.col(f"f{i}")
        own = F.coalesce(F.try_divide((F.col("n") - n).cast("double"), F.col("n").cast("double")), F.lit(1.0))
        rows.append(
            F.struct(F.lit(c["type"]).alias("type"), F.lit(c["target"]).alias("target"), n.alias("failures"), own.alias("pass_rate"))
        )
    return to_rows(one, rows).filter((F.col("type") == "all") | (F.col("failures") > 0))


def with_reasons(df: DataFrame, constraints: list[dict], key: str | list[str] | None = None) -> DataFrame:
    """Rows with `_reasons`: the labels of the constraints they break (empty when clean)."""
    reasons = [F.when(~f, F.lit(label(c))) for f, c in zip(_flags(constraints), constraints)]
    flagged = check(df, constraints, key)
    found = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    return flagged.withColumn("_reasons", found).select(*df.columns, "_reasons")


def quarantine(
    df: DataFrame, constraints: list[dict], key: str | list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows with `_reasons`); together they are the whole table."""
    marked = with_reasons(df, constraints, key)
    bad = F.size("_reasons") > 0
    return marked.filter(~bad).drop("_reasons"), marked.filter(bad)
