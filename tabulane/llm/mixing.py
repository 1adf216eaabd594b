"""Mixing sources to target weights: temperature on token shares, realised as budgeted block permutations."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulane.operators.skew import dimension_join
from tabulane.session import cut_lineage

WORD = r"[^ \t\n\r\f\x0B]+"
STEPS = 40  # bisection steps of the exponent
PER_PASS = 4  # steps that one pass over the sources settles, by looking at all their midpoints at once
DIGITS = 3  # hex digits of a block: 4096 blocks per source and level


class Mix(NamedTuple):
    """The exponent that was found, and a table (source_key, source, tokens, weight, budget, whole, rest) with one row per source."""

    exponent: float
    sources: DataFrame


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Text that tells a null source from every other."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit("-"))


def _order_key(seed: str, number: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), number.cast("string"), F.col("source_key"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def solve(sources: DataFrame, budget: int | None = None, entropy: float | None = None, max_repeats: float | None = None) -> Mix:
    """Weights tokens^a / sum for the smallest exponent a in 0..1 whose entropy is at most the target and that repeats no source too often.

    `sources` has source_key, source and tokens. `entropy` is a share of the way from the entropy of the natural
    weights (0) to that of equal ones (1); `max_repeats` limits budget of a source / tokens of the source. Sources without tokens take
    no part. The sources are never collected: each pass is one aggregate that settles four bisection steps.
    """
    live = sources.filter(F.col("tokens") > 0)
    first = live.agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if not first["k"]:
        return Mix(1.0, live.select("*", *[F.lit(0.0).alias("weight")], *[F.lit(0).cast("long").alias(c) for c in ("budget", "whole", "rest")]))
    total = first["n"]
    budget = total if budget is None else budget
    share = F.col("tokens") / F.lit(float(total))

    def measured(exponents: list[float]) -> list[tuple[float, float, float]]:
        """Normaliser, entropy and largest repetition at each exponent."""
        found = live.agg(
            *[
                f.alias(f"{name}{i}")
                for i, a in enumerate(exponents)
                for name, f in (
                    ("z", F.sum(F.pow(share, F.lit(a)))),
                    ("s", F.sum(F.pow(share, F.lit(a)) * F.log(share))),
                    ("m", F.max(F.pow(share, F.lit(a)) / share)),
                )
            ]
        ).first()
        return [
            (z, math.log(z) - a * s / z, m / z * budget / total)
            for a, z, s, m in ((a, found[f"z{i}"], found[f"s{i}"], found[f"m{i}"]) for i, a in enumerate(exponents))
        ]

    (_, flat, _), (_, natural, _) = measured([0.0, 1.0])
    target = None if entropy is None else natural + entropy * (flat - natural)

    def fits(m: tuple[float, float, float]) -> bool:
        return (target is None or m[1] <= target) and (max_repeats is None or m[2] <= max_repeats)

    low, high = 0.0, 1.0
    for _ in range(STEPS // PER_PASS):
        n = 1 << PER_PASS
        points = [low + (high - low) * i / n for i in range(1, n)]
        good = next((i for i, m in enumerate(measured(points)) if fits(m)), n - 1)
        low, high = (points[good - 1] if good else low), (points[good] if good < n - 1 else high)
    z = measured([high])[0][0]
    weight = F.pow(share, F.lit(high)) / F.lit(z)
    return Mix(
        high,
        live.withColumn("weight", weight)
        .withColumn("budget", F.floor(F.col("weight") * F.lit(float(budget))).cast("long"))
        .withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")),
    )


def _split(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose block fits the rest of their source's budget, and the rows of the one block that crosses it (rest reduced to what is left there)."""
    rows = rows.withColumn("block", F.substring("order_key", 1 + level * DIGITS, DIGITS))
    sums = rows.groupBy("source_key", "rest", "block").agg(F.sum("n_tokens").alias("t"))
    sums = sums.withColumn("before", F.sum("t").over(Window.partitionBy("source_key").orderBy("block")) - F.col("t"))
    over = sums.filter(F.col("before") + F.col("t") > F.col("rest"))
    edge = cut_lineage(over.groupBy("source_key").agg(F.min(F.struct("block", "before")).alias("edge")))
    joined = dimension_join(rows, edge, ["source_key"], "left")
    inside = joined.filter(F.col("block") == F.col("edge.block")).withColumn("rest", F.col("rest") - F.col("edge.before"))
    chosen = joined.filter(F.col("edge").isNull() | (F.col("block") < F.col("edge.block")))
    return chosen.drop("edge", "block"), inside.drop("edge", "block")


def mix_sources(
    docs: DataFrame,
    budget: int | None = None,
    entropy: float | None = 0.5,
    max_repeats: float | None = 1.5,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, pass, n_tokens, order_key, tag): one row for each time a document is used, in the order of (pass, order_key).

    Tokens are words. The budget (default: the tokens of the table) is dealt to the sources by `solve`. A source is
    used in passes; each is a permutation of its documents by a hash of seed, pass, source and id. All passes but the last are whole; the last
    takes documents in that order as long as their tokens fit (the first that does not fit ends it). The cut is found
    by blocks of the permutation: sums per block, then the same within the block that crosses the budget, so only a
    few millionths of a source's rows are ever ranked in one task.

    A null source is a source of its own; null and empty texts have no tokens and follow their source, unless it has none at all: such
    sources are left out. Rows of one id are separate documents, ties by the hash of their text (`tag`); an empty table gives no row.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        _source_key(F.col(source_col)).alias("source_key"),
        count_words(F.col(text_col)).alias("n_tokens"),
        F.xxhash64(F.col(text_col)).alias("tag"),
    )
    rows = cut_lineage(rows)
    sources = cut_lineage(rows.groupBy("source_key", "source").agg(F.sum("n_tokens").alias("tokens")))
    mix = solve(sources, budget, entropy, max_repeats)
    dealt = dimension_join(rows, mix.sources.select("source_key", "whole", "rest"), ["source_key"])
    whole = dealt.filter(F.col("whole") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    whole = whole.withColumn("order_key", _order_key(seed, F.col("pass")))
    last = dealt.withColumn("pass", F.col("whole")).withColumn("order_key", _order_key(seed, F.col("pass")))
    taken, edge = _split(last, 0)
    taken2, edge2 = _split(cut_lineage(edge), 1)
    used = F.sum("n_tokens").over(
        Window.partitionBy("source_key").orderBy("order_key", "doc_id", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    taken3 = edge2.withColumn("used", used).filter(F.col("used") <= F.col("rest"))
    out = ["doc_id", "source", "pass", "n_tokens", "order_key", "tag"]
    return whole.select(out).unionByName(taken.select(out)).unionByName(taken2.select(out)).unionByName(taken3.select(out))
