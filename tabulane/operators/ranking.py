"""Exact positions in a total order, without sending the table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.session import cut_lineage

POSITION_BITS = 33  # layout of monotonically_increasing_id: partition number above, row number below


def ranked(df: DataFrame, order: list[Column], name: str = "_rank", keep: list[str] | None = None) -> tuple[DataFrame, int]:
    """The rows with their 0-based position under `order` (which should end in a unique key), and their number.

    Range-partitioned sort, then position = rows in earlier partitions + place in the own one. The
    sorted table, or just its columns `keep`, is written to the checkpoint folder first: the counts and
    the final rows must come from the same partitions, also after an executor is lost.
    """
    spark = df.sparkSession
    kept = [F.col(f"`{c}`") for c in (keep or df.columns)]
    ordered = cut_lineage(df.orderBy(*order).select(*kept, F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", POSITION_BITS).cast("int")
    place = F.col("_id").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    # one row per sort partition, so the size is the partition setting, not the data
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    offsets, before = [], 0
    for row in sizes:
        offsets.append((row["_part"], before))
        before += row["n"]
    starts = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))
    placed = ordered.withColumn("_part", part).join(starts, "_part")
    return placed.withColumn(name, F.col("_before") + place).drop("_id", "_part", "_before"), before


def with_rank(df: DataFrame, order: list[Column], name: str = "_rank") -> DataFrame:
    """Add the 0-based position of each row under `order`."""
    return ranked(df, order, name)[0]
