"""Column statistics, correlations, histograms and scores of a table."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulane.functions.formula import kind_of
from tabulane.functions.scalars import present_column
from tabulane.operators.longform import to_rows
from tabulane.operators.percentiles import exact_percentiles
from tabulane.operators.products import pair_sums
from tabulane.sources.tables import logical_type

SAMPLE = 100  # fixed value: non-missing values looked at for the display type


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in ("int", "num")]


def profile_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, rows, null_count, null_rate); rate 0 on an empty table. Lazy, one aggregate."""
    cols = cols or df.columns
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(present_column(df, c)).alias(f"n{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    parts = []
    for i, c in enumerate(cols):
        nulls = F.col("_n") - F.col(f"n{i}")
        rate = F.coalesce(F.try_divide(nulls.cast("double"), F.col("_n").cast("double")), F.lit(0.0))
        parts.append(
            F.struct(F.lit(c).alias("column"), F.col("_n").alias("rows"), nulls.alias("null_count"), rate.alias("null_rate"))
        )
    return to_rows(one, parts)


STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _column_stats(df: DataFrame, cols: list[str], numeric: list[str]) -> dict[str, dict]:
    """Counts of all columns, statistics and exact medians of the numeric ones.

    One aggregate serves everything but the medians; those take counting rounds that hold no column
    in memory (see percentiles). Only the statistics come to the driver.
    """
    value = {c: present_column(df, c).cast("double") for c in numeric}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count(present_column(df, c)).alias(f"n{i}"))
        if c in value:
            aggs += [fn(value[c]).alias(f"{name}{i}") for name, fn in STATS.items()]
    row = df.agg(*aggs).first()
    stats = {
        c: {"rows": row["rows"], "present": row[f"n{i}"], **({s: row[f"{s}{i}"] for s in STATS} if c in value else {})}
        for i, c in enumerate(cols)
    }
    medians = exact_percentiles(df, value, [0.5], sizes={c: stats[c]["present"] for c in numeric})
    for c in numeric:
        stats[c]["median"] = medians[c][0]
    return stats


def profile_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, mean, std, min, max, median); std is the sample one; all NULL without values."""
    cols = cols or numeric_columns(df)
    stats = _column_stats(df, cols, cols)
    rows = [(c, *[stats[c][s] for s in (*STATS, "median")]) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, mean double, std double, min double, max double, median double")


def profile_categories(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, category, n, rate) for text and boolean columns; rate over non-missing rows."""
    cols = cols or [f.name for f in df.schema.fields if kind_of(f.dataType) in ("str", "bool")]
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "category")
    counts = long.filter(F.col("category").isNotNull()).groupBy("column", "category").agg(F.count(F.lit(1)).alias("n"))
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)])
    totals = to_rows(one, [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("_total")) for i, c in enumerate(cols)])
    # one row per column of the table: bounded by the schema
    return counts.join(F.broadcast(totals), "column").select(
        "column", "category", "n", (F.col("n") / F.col("_total")).alias("rate")
    )


def profile(df: DataFrame) -> DataFrame:
    """One row per column: logical type, missing values, numeric statistics."""
    stats = _column_stats(df, df.columns, numeric_columns(df))
    rows = []
    for f in df.schema.fields:
        s = stats[f.name]
        nulls = s["rows"] - s["present"]
        rate = nulls / s["rows"] if s["rows"] else 0.0
        rows.append((f.name, logical_type(f.dataType), s["rows"], nulls, rate, *[s.get(k) for k in (*STATS, "median")]))
    schema = "column string, dtype string, rows long, null_count long, null_rate double, mean double, std double, min double, max double, median double"
    return df.sparkSession.createDataFrame(rows, schema)


def profile_full(df: DataFrame) -> DataFrame:
    """(column, statistic, category, value): the profile of every column, and the count and rate of each category, in long form."""
    names = ["rows", "null_count", "null_rate", *STATS, "median"]
    flat = profile(df).select("column", *[F.col(c).cast("double").alias(c) for c in names])
    stats = flat.unpivot(["column"], names, "statistic", "value").filter(F.col("value").isNotNull())
    parts = [stats.select("column", "statistic", F.lit(None).cast("string").alias("category"), "value")]
    if any(kind_of(f.dataType) in ("str", "bool") for f in df.schema.fields):
        kinds = profile_categories(df).withColumn("n", F.col("n").cast("double")).withColumnRenamed("n", "count")
        parts.append(kinds.unpivot(["column", "category"], ["count", "rate"], "statistic", "value").select("column", "statistic", "category", "value"))
    return reduce(DataFrame.unionByName, parts)


def detect_types(df: DataFrame, order_by: str, sample: int = SAMPLE) -> DataFrame:
    """(column, dtype) guessed from the first `sample` non-missing values of each column.

    One top-k per column: each task keeps `sample` values and reads only that column and the key.
    """
    found = []
    for f in df.schema.fields:
        v, kind = present_column(df, f.name), kind_of(f.dataType)
        first = df.select(F.col(order_by).alias("_o"), v.alias("v")).filter(F.col("v").isNotNull()).orderBy("_o").limit(sample)
        n = F.count(F.lit(1))
        if kind == "bool":
            dtype = F.lit("bool")
        elif kind in ("int", "num"):
            dtype = F.when(F.bool_and(F.col("v") == F.floor("v")), "int").otherwise("float")
        elif kind == "str":
            dtype = F.when(F.count_distinct("v") < n * F.lit(0.2), "category").otherwise("string")
        else:
            dtype = F.lit("string")
        found.append(first.agg(F.lit(f.name).alias("column"), F.when(n == 0, "string").otherwise(dtype).alias("dtype")))
    return reduce(DataFrame.unionAll, found)


# correlation --------------------------------------------------------------------------------


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r over rows having both values, as one row (col_x, col_y, r, n).

    r is 0 when there is no complete pair or one side does not vary.
    """
    a, b = present_column(df, x).cast("double"), present_column(df, y).cast("double")
    one = df.agg(
        F.regr_sxy(b, a).alias("xy"), F.regr_sxx(b, a).alias("xx"), F.regr_syy(b, a).alias("yy"), F.regr_count(b, a).alias("n")
    )
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    r = F.when(spread > 0, F.col("xy") / spread).otherwise(0.0)
    return one.select(F.lit(x).alias("col_x"), F.lit(y).alias("col_y"), r.alias("r"), "n")


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(col_x, col_y, r, n) for every ordered pair, pairwise complete, including the diagonal.

    First pass: means. Second: sums of the centred values over the rows that have both (so nothing cancels).
    What reaches the driver are a few numbers per pair of columns.
    """
    cols = cols or numeric_columns(df)
    value = [present_column(df, c).cast("double") for c in cols]
    sums = [f(v).alias(f"{name}{i}") for i, v in enumerate(value) for name, f in (("m", F.avg), ("n", F.count))]
    first = df.agg(F.count(F.lit(1)).alias("rows"), *sums).first()
    complete = all(first[f"n{i}"] == first["rows"] for i in range(len(cols)))
    n, s, q, p = pair_sums(df, value, [first[f"m{i}"] or 0.0 for i in range(len(cols))], complete)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            r = 0.0
            if n[i, j]:
                spread = math.sqrt(max(0.0, q[i, j] - s[i, j] ** 2 / n[i, j]) * max(0.0, q[j, i] - s[j, i] ** 2 / n[i, j]))
                r = (p[i, j] - s[i, j] * s[j, i] / n[i, j]) / spread if spread > 0 else 0.0
            rows.append((a, b, float(r), int(n[i, j])))
    return df.sparkSession.createDataFrame(rows, "col_x string, col_y string, r double, n long")


# histograms ---------------------------------------------------------------------------------


def histogram(df: DataFrame, col: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """(bin, start, end, category, n, total) with equal-width left-closed bins, empty ones included.

    The last bin also holds the maximum. A column with one value has one bin around it. Missing
    categories count as 'Unknown'; without `by` the category is 'All'.
    """
    category = F.coalesce(F.col(by).cast("string"), F.lit("Unknown")) if by else F.lit("All")
    data = df.select(present_column(df, col).cast("double").alias("v"), category.alias("category")).filter(F.col("v").isNotNull())
    span = data.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    width = (hi - lo) / F.lit(float(bins))
    place = F.when(lo == hi, 0).otherwise(F.least(F.floor(F.try_divide(F.col("v") - lo, width)), F.lit(bins - 1))).cast("int")
    counts = data.withColumn("_s", span).groupBy("category", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # per category at most `bins` entries; per bin one total
    per_category = counts.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"))
    totals = counts.groupBy("bin").agg(F.sum("n").alias("total"))
    last = F.when(lo == hi, 0).otherwise(bins - 1)
    full = per_category.withColumn("_s", span).select("category", "_m", "_s", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    start = F.when(lo == hi, lo - 0.5).otherwise(lo + F.col("bin") * width)
    end = F.when(lo == hi, hi + 0.5).otherwise(lo + (F.col("bin") + 1) * width)
    return full.join(F.broadcast(totals), "bin", "left").select(
        "bin",
        start.alias("start"),
        end.alias("end"),
        "category",
        F.coalesce(F.col("_m")[F.col("bin")], F.lit(0)).cast("long").alias("n"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
    )


def group_stats(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """(category, n, mean, std) with the population standard deviation."""
    category = F.coalesce(F.col(by).cast("string"), F.lit("Unknown")) if by else F.lit("All")
    data = df.select(present_column(df, col).cast("double").alias("v"), category.alias("category")).filter(F.col("v").isNotNull())
    return data.groupBy("category").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )


def scatter_summary(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Ranges of the complete points, as rows (item, value, category).

    A numeric colour adds its range; any other colour adds one row per distinct category.
    """
    cols = list(dict.fromkeys([x, y] + ([color] if color else [])))
    points = df.select(*[present_column(df, c).alias(c) for c in cols]).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    numeric = color is not None and kind_of(df.schema[color].dataType) in ("int", "num")
    ranged = [("x", x), ("y", y)] + ([("color", color)] if numeric else [])
    aggs = [fn(F.col(c).cast("double")).alias(f"{tag}_{fn.__name__}") for tag, c in ranged for fn in (F.min, F.max)]
    default = {"min": 0.0, "max": 1.0}  # fixed values: the axis of an empty chart
    parts = [
        F.struct(
            F.lit(f"{tag}_{end}").alias("item"),
            F.coalesce(F.col(f"{tag}_{end}"), F.lit(default[end])).alias("value"),
            F.lit(None).cast("string").alias("category"),
        )
        for tag, _ in ranged
        for end in ("min", "max")
    ]
    ranges = to_rows(points.agg(*aggs), parts)
    if color is None or numeric:
        return ranges
    categories = points.filter(F.col(color).isNotNull()).select(F.col(color).cast("string").alias("category")).distinct()
    return ranges.unionByName(
        categories.select(F.lit("category").alias("item"), F.lit(None).cast("double").alias("value"), "category")
    )


# scores -------------------------------------------------------------------------------------


def regression_metrics(df: DataFrame, y: str, yhat: str, names: list[str] | None = None) -> DataFrame:
    """(metric, value) over rows having both; mape only when no true value is zero.

    The exact median error takes several passes; persist `df` first if it is costly to compute.
    """
    data = df.select(present_column(df, y).cast("double").alias("y"), present_column(df, yhat).cast("double").alias("p"))
    data = data.filter(F.col("y").isNotNull() & F.col("p").isNotNull())
    e = F.col("y") - F.col("p")
    wanted = names or ["r2", "mae", "rmse", "mse", "explained_variance", "median_ae", "max_error", "mape"]
    one = data.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.max(F.abs(e)).alias("max_error"),
        F.var_pop("y").alias("vy"),
        F.var_pop(e).alias("ve"),
        F.count_if(F.col("y") == 0).alias("zeros"),
        F.avg(F.try_divide(F.abs(e), F.abs(F.col("y")))).alias("mape"),
    )
    # a constant target scores 1 when met exactly, else 0
    def share(err: str) -> Column:
        return F.when(F.col("vy") > 0, 1 - F.col(err) / F.col("vy")).when(F.col(err) == 0, 1.0).otherwise(0.0)

    value = {
        "r2": F.when(F.col("n") > 1, share("mse")),
        "mae": F.col("mae"),
        "rmse": F.sqrt("mse"),
        "mse": F.col("mse"),
        "explained_variance": F.when(F.col("n") > 0, share("ve")),
        "max_error": F.col("max_error"),
        "mape": F.when(F.col("zeros") == 0, F.col("mape")),
    }
    if "median_ae" in wanted:
        value["median_ae"] = F.lit(exact_percentiles(data, {"e": F.abs(e)}, [0.5])["e"][0]).cast("double")
    rows = to_rows(one, [F.struct(F.lit(m).alias("metric"), value[m].alias("value")) for m in wanted])
    return rows.filter((F.col("metric") != "mape") | F.col("value").isNotNull())


def residual_stats(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(metric, value): mean, population std, min and max of y - yhat."""
    e = present_column(df, y).cast("double") - present_column(df, yhat).cast("double")
    one = df.agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"))
    return to_rows(
        one, [F.struct(F.lit(f"residuals_{m}").alias("metric"), F.col(m).alias("value")) for m in ("mean", "std", "min", "max")]
    )


def residuals(df: DataFrame, y: str, yhat: str = "_prediction") -> DataFrame:
    """Rows having both numbers, with `_residual` and `_abs_error`."""
    e = present_column(df, y) - present_column(df, yhat)
    return df.withColumn("_residual", e).withColumn("_abs_error", F.abs(e)).filter(F.col("_residual").isNotNull())
