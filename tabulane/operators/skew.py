"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001  # a key above this share of the rows is hot; so there are at most 1000 of them
TRACKED = 16_384  # counters of the sketch; enough to find every key above HOT_SHARE
GROUPS = 64  # sketches of all tasks meet in so many tasks first, then in one
SMALL_ROWS = 100_000  # a side within both limits is broadcast
SMALL_BYTES = 32 << 20


def _key_hash(keys: list[str], types: dict[str, str]) -> Column:
    """Hash of the key columns, in the types of the left side."""
    return F.xxhash64(*[F.expr(f"try_cast(`{k}` AS {types[k]})") for k in keys])


def hot_hashes(df: DataFrame, keys: list[str]) -> dict[int, float]:
    """Hashes of the keys that hold more than HOT_SHARE of the rows, with that share.

    One scan of the key columns with a frequent-items sketch: nothing is shuffled but the sketches, merged
    in two levels, and at most 1/HOT_SHARE numbers come back. The answer only steers where rows go in a join.
    """
    hashed = df.select(_key_hash(keys, dict(df.dtypes)).alias("h"), F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g"))
    parts = hashed.groupBy("g").agg(F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("s"), F.count(F.lit(1)).alias("n"))
    merged = parts.agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s"), F.sum("n").alias("n"))
    found = merged.select(F.when(F.col("n") > 0, F.expr(f"approx_top_k_estimate(s, {int(1 / HOT_SHARE)})")).alias("top"), "n").first()
    if not found["n"]:
        return {}
    return {t["item"]: t["count"] / found["n"] for t in found["top"] if t["count"] > HOT_SHARE * found["n"]}


def _place(df: DataFrame) -> list[Column] | None:
    """File and row number of each row, where `df` is read straight from files that number their rows."""
    where = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        df.select(*where)
    except AnalysisException:
        return None
    return where


def _salts(hot: dict[int, float], key_hash: Column, parts: int) -> Column:
    """How many sub-keys a row's key is spread over: its share of the shuffle partitions, as a power of two; 1 if it is not hot."""
    tiers: dict[int, list[int]] = {}
    for h, share in hot.items():
        tiers.setdefault(1 << max(1, math.ceil(math.log2(max(1.0, share * parts)))), []).append(h)
    return F.coalesce(*[F.when(key_hash.isin(hashes), F.lit(n)) for n, hashes in tiers.items()], F.lit(1))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    hot: dict[int, float] | None = None,
    salt_by: list[str] | None = None,
) -> DataFrame:
    """`left.join(right, keys, how)` (inner, left, left_semi, left_anti) for a left side with hot keys.

    Rows of a hot key are spread over as many sub-keys as its share of the shuffle partitions, by their place
    in the file, else by `salt_by` (a row key; other columns can then be pruned), else by a hash of the row, which
    leaves rows equal in all columns together. Only the right rows of hot keys are repeated. Without hot keys
    this is the plain join. `hot` may be handed in where the hot keys are known from another table.
    Never a random number: a task that runs again must send each row the same way.
    """
    if hot is None:
        hot = hot_hashes(left, keys)
    if not hot:
        return left.join(right, keys, how)
    types = dict(left.dtypes)
    salts = _salts(hot, _key_hash(keys, types), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = _place(left) or [F.col(f"`{c}`") for c, t in left.dtypes if (c in salt_by if salt_by else "map<" not in t)]
    spread = F.pmod(F.xxhash64(*own), salts).cast("int")
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.withColumn("_salt", spread).join(repeated, [*keys, "_salt"], how).drop("_salt")


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> bool:
    """The check a table has to pass before it is broadcast: its rows are counted, then its bytes."""
    rows = df.count()
    if rows > max_rows:
        return False
    fixed, varying = 0, []
    for name, dtype in df.dtypes:
        if dtype in ("string", "binary"):
            varying.append(F.octet_length(F.col(f"`{name}`")))
        elif "<" in dtype:  # arrays, maps and structs
            varying.append(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))))
        else:
            fixed += 16
    if not varying:
        return rows * fixed <= max_bytes
    long = df.agg(F.sum(reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in varying])).alias("n")).first()["n"]
    return rows * fixed + (long or 0) <= max_bytes


def dimension_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    hot_in: DataFrame | None = None,
    salt_by: list[str] | None = None,
) -> DataFrame:
    """Broadcast `right` when its measured size allows it, else the salted shuffle join.

    `hot_in` is a table whose hot keys stand for those of `left`, when `left` is costly to compute.
    """
    if is_small(right):
        return left.join(F.broadcast(right), keys, how)
    return salted_join(left, right, keys, how, hot_hashes(hot_in if hot_in is not None else left, keys), salt_by)
