"""Selecting, deriving, sorting, paging, thinning and splitting rows."""

from __future__ import annotations

import datetime as dt
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.functions.formula import formula, referenced_names
from tabulane.functions.scalars import present_column
from tabulane.functions.uniform import bits_of, draw_hash, uniform
from tabulane.operators.ranking import ranked
from tabulane.operators.skew import dimension_join

TOP_ROWS = 1_000  # without a row key, a sorted page up to here is kept in a per-task top-k heap
MAX_HOURS = 24 * 90  # fixed value: longest trailing window


def require_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def select_columns(df: DataFrame, cols: list[str] | str) -> DataFrame:
    """Named columns, given as a list or as comma-separated text."""
    if isinstance(cols, str):
        cols = [c.strip() for c in cols.split(",") if c.strip()]
    require_columns(df, cols)
    return df.select(*[F.col(f"`{c}`") for c in cols])


def derive(
    df: DataFrame, name: str, expr: str | Column, allow_overwrite: bool = False, context: dict | None = None
) -> DataFrame:
    """Add a column from a formula or a Column; an existing one is replaced in place only on demand."""
    if name in df.columns and not allow_overwrite:
        raise ValueError(f"column '{name}' already exists; allow_overwrite=True replaces it")
    if isinstance(expr, str):
        known = set(df.columns)
        if not context:
            missing = [n for n in referenced_names(expr) if n not in known and n not in ("PI", "E", "TRUE", "FALSE")]
            if missing:
                raise ValueError(f"required columns not found: {missing}")
        expr = formula(expr, df, context, max_nodes=None)
    return df.withColumn(name, expr)


def preview(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """First n rows; with `order_by` the same rows every time."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def sort_key(col: str, ascending: bool = True) -> Column:
    """Missing values last in both directions."""
    return F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()


def sort_keys(df: DataFrame, col: str, ascending: bool = True, tie_break: str | None = None) -> list[Column]:
    """Order by `col`, missing values (NULL and NaN) last in both directions."""
    value = present_column(df, col)
    keys = [value.asc_nulls_last() if ascending else value.desc_nulls_last()]
    return keys + ([F.col(tie_break).asc_nulls_last()] if tie_break else [])


def sort_table(df: DataFrame, col: str, ascending: bool = True, tie_break: str | None = None) -> DataFrame:
    return df.orderBy(*sort_keys(df, col, ascending, tie_break))


def valid_flag(df: DataFrame, cols: list[str], name: str = "_valid") -> DataFrame:
    """True where none of the columns is missing; all rows are kept."""
    return df.withColumn(name, present(df, cols))


def present(df: DataFrame, cols: list[str]) -> Column:
    require_columns(df, cols)
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    checks = [F.col(c).isNotNull() & ~F.isnan(c) if c in floats else F.col(c).isNotNull() for c in cols]
    return reduce(lambda a, b: a & b, checks)


def complete_cases(df: DataFrame, cols: list[str], check: bool = False) -> DataFrame:
    """Rows without a missing value in `cols`; `check` fails when there is none (one small job)."""
    rows = df.filter(present(df, cols))
    if check and rows.isEmpty():
        raise ValueError(f"no rows left after dropping missing values in {cols}")
    return rows


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Number of complete and incomplete rows."""
    ok = present(df, cols)
    return df.agg(F.count_if(ok).alias("complete"), F.count_if(~ok).alias("incomplete"))


def trailing_window(
    df: DataFrame, ts: str, hours: int, as_of: dt.datetime | str, day_column: str | None = None, **equal
) -> DataFrame:
    """Rows from the last `hours` before `as_of`, with equality filters on other columns.

    `day_column` names a partition column holding the day of `ts`; older partitions are then skipped.
    """
    if not 1 <= hours <= MAX_HOURS:
        raise ValueError(f"hours must be between 1 and {MAX_HOURS}")
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    since = F.lit(as_of - dt.timedelta(hours=hours)).cast(df.schema[ts].dataType)
    rows = df.filter(F.col(ts) >= since)
    if day_column is not None:
        rows = rows.filter(F.col(day_column) >= F.to_date(since))
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def _picked(df: DataFrame, picks: DataFrame, key: list[str] | None) -> DataFrame:
    """The rows of `picks` in their order, with the other columns of `df` joined on where only the key was ranked."""
    if key and set(df.columns) - set(key):
        picks = dimension_join(df, picks, key, "inner").select(*[F.col(f"`{c}`") for c in df.columns], "_rank")
    return picks.orderBy("_rank").drop("_rank")


def page(df: DataFrame, order_by: list[Column], offset: int, limit: int, key: list[str] | None = None) -> tuple[DataFrame, int]:
    """One page of a listing and the total number of rows.

    `key` names the columns that identify a row (never NULL): then one sort of the sort and key columns gives the
    total and the page at any depth, and only the rows of the page are read in full. Without it a page near the
    front is a top-k, and a deeper one ranks whole rows.
    """
    if not key and offset + limit <= TOP_ROWS:
        return df.orderBy(*order_by).offset(offset).limit(limit), df.count()
    placed, total = ranked(df, order_by, keep=key)
    picks = placed.filter((F.col("_rank") >= offset) & (F.col("_rank") < offset + limit))
    return _picked(df, picks, key), total


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row with the highest `order` per key. Partial aggregation, so a hot key is no problem."""
    rest = F.struct(*[F.col(c) for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("_row")).select(key, "_row.*")


def thin(df: DataFrame, order_by: list[Column], max_points: int = 1000, key: list[str] | None = None) -> DataFrame:
    """Every ceil(n/max_points)-th row of the ordered table, in order; all rows when there are few enough.

    With `key` (columns that identify a row, never NULL) only the sort and key columns are sorted.
    """
    placed, n = ranked(df, order_by, keep=key)
    step = max(1, -(-n // max_points))
    return _picked(df, placed.filter(F.col("_rank") % step == 0), key)


def split_flag(key: Column, test_size: float = 0.2, seed: int = 42) -> Column:
    """True for the test rows: a hash of the key, so it is the same on every run and partitioning."""
    return uniform(seed, "split", 0, key) < F.lit(float(test_size))


def split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, kind: str = "random"
) -> tuple[DataFrame, DataFrame]:
    """(train, test); any kind but "random" means no split: both are the whole table."""
    if kind != "random":
        return df, df
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    test = split_flag(F.col(key), test_size, seed)
    return df.filter(~test), df.filter(test)


DIGITS = (18, 17, 17)  # bits of a hash that one pass of `exact_threshold` counts


def exact_threshold(bits: DataFrame, wanted: int) -> int:
    """The smallest value of `_bits` (52 bits) that at least `wanted` rows do not exceed.

    Counts the rows per leading digit, goes into the digit that holds the row looked for and counts its next one. Nothing is
    sorted; each pass reads the column once and passes on one number per digit.
    """
    prefix, width = 0, sum(DIGITS)
    for digits in DIGITS:
        inside = bits.filter(F.shiftright("_bits", width) == prefix)
        width -= digits
        counts = inside.groupBy(F.shiftright("_bits", width).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        for digit, n in sorted((r["digit"], r["n"]) for r in counts.collect()):
            if n >= wanted:
                break
            wanted -= n
        if n == wanted:  # the whole digit
            return ((digit + 1) << width) - 1
        prefix = digit
    return prefix


def split_exact(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) where test has exactly ceil(rows * test_size) rows: those of the smallest hashes of the key.

    Keys should be unique. Rows that share a key (NULL is one) have one hash and stay together, so if the last test row shares its
    key, test has the others too. An empty table gives two empty ones.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    text = F.coalesce(F.concat(F.lit("+"), F.col(f"`{key}`").cast("string")), F.lit("-"))
    bits = bits_of(draw_hash(seed, "split_exact", 0, text), 0)
    total = df.count()
    if not total:
        return df, df
    last = exact_threshold(df.select(bits.alias("_bits")), math.ceil(total * test_size))
    return df.filter(bits > F.lit(last)), df.filter(bits <= F.lit(last))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def count_rows(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """Number of rows (meeting `condition`), as a one-row table."""
    if condition is None:
        return df.agg(F.count(F.lit(1)).alias("n"))
    return df.agg(F.count_if(condition).alias("n"))
