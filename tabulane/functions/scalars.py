"""Scalar functions with one missing-value rule: outside the domain, or on a missing input, the
result is NULL. With ``strict=True`` a value outside the domain fails the query instead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_as_null(col: Column) -> Column:
    """NaN becomes NULL (for float and double columns)."""
    return F.nanvl(col, F.lit(None).cast("double"))


def present_column(df: DataFrame, col: str) -> Column:
    """A column of `df` with NaN turned into NULL."""
    if df.schema[col].dataType.typeName() in ("double", "float"):
        return missing_as_null(F.col(f"`{col}`")).cast(df.schema[col].dataType)
    return F.col(f"`{col}`")


def _domain(ok: Column, value: Column, strict: bool, what: str) -> Column:
    if strict:
        return F.when(ok, value).when(~ok, F.raise_error(F.lit(what)))
    return F.when(ok, value)


def divide(a: Column, b: Column, strict: bool = False) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return _domain(b != 0, F.try_divide(a, b), strict, "division by zero")


def modulo(a: Column, b: Column, strict: bool = False) -> Column:
    """Remainder with the sign of the divisor."""
    rest = a % F.nullif(b, F.lit(0))
    signed = F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
    return _domain(b != 0, signed, strict, "division by zero")


def floor_divide(a: Column, b: Column, strict: bool = False) -> Column:
    """Quotient rounded toward minus infinity."""
    return _domain(b != 0, F.rint(F.try_divide((a - modulo(a, b)).cast("double"), b.cast("double"))), strict, "division by zero")


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Scale, round to the nearest even integer, scale back."""
    scale = F.lit(float(10 ** abs(digits)))
    if digits == 0:
        return F.rint(x)
    return F.rint(x * scale) / scale if digits > 0 else F.rint(x / scale) * scale


def _whole(fn, x: Column) -> Column:
    x = x.cast("double")
    big = F.abs(x) >= F.lit(float(2**53))  # already a whole number, and beyond what long keeps
    return F.when(big, x).otherwise(fn(x).cast("double"))


def floor(x: Column) -> Column:
    return _whole(F.floor, x)


def ceil(x: Column) -> Column:
    return _whole(F.ceil, x)


def sqrt(x: Column, strict: bool = False) -> Column:
    return _domain(x >= 0, F.sqrt(x), strict, "square root of a negative number")


def log(x: Column, base: Column | None = None, strict: bool = False) -> Column:
    value = F.ln(x) if base is None else F.try_divide(F.ln(x), F.ln(base))
    return _domain(x > 0, value, strict, "logarithm of a number that is not positive")


def log10(x: Column, strict: bool = False) -> Column:
    return _domain(x > 0, F.log10(x), strict, "logarithm of a number that is not positive")


def _all_present(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def smallest(*cols: Column) -> Column:
    """Least value; NULL when any input is missing."""
    return F.when(_all_present(list(cols)), F.least(*cols))


def largest(*cols: Column) -> Column:
    return F.when(_all_present(list(cols)), F.greatest(*cols))


def clip(x: Column, low: Column | None, high: Column | None) -> Column:
    """Value held to [low, high]; a side given as None is open."""
    if high is not None:
        x = smallest(high, x)
    if low is not None:
        x = largest(low, x)
    return x


def choose(condition: Column, then: Column, other: Column) -> Column:
    """`then` where the condition holds, else (also on NULL) `other`."""
    return F.when(condition, then).otherwise(other)


def is_missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def as_key(col: Column, is_bool: bool = False) -> Column:
    """Text form under which lookup tables are keyed."""
    return F.initcap(col.cast("string")) if is_bool else col.cast("string")
