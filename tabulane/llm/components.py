"""Connected components of a table of links, by stars: no component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulane.session import cut_lineage

EDGES = 100_000  # edges a task gets; a round over fewer takes one task and broadcasts, not a task and its files for each shuffle partition


def _measure(edges: DataFrame) -> tuple[int, int]:
    found = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return found["n"], found["x"]


def _few(table: DataFrame, edges: int) -> DataFrame:
    """The table in as many partitions as that many edges need, if it has more."""
    return table.coalesce(max(1, -(-edges // EDGES)))


def _beside(table: DataFrame, edges: int) -> DataFrame:
    """The table of at most two rows an edge as a side of a join: broadcast, if one task gets all edges."""
    return F.broadcast(table) if edges <= EDGES else table


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node that can be reached.

    Large stars and small stars in turn, each step written to the checkpoint folder, until no edge changes; the number of
    rounds grows with the logarithm of the longest chain, the tasks and files of a round with the edges. Links to oneself and null ends
    are passed over.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v AND v IS NOT NULL").distinct()
    edges = cut_lineage(edges)
    before = _measure(edges)
    while before[0]:
        n = before[0]
        both = _few(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), n)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(_beside(least, n), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _few(_few(large, n).distinct(), n)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_beside(down, n), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _few(small.unionByName(down.select("u", F.col("m").alias("v"))), n).distinct()
        edges = cut_lineage(_few(edges, n))
        now = _measure(edges)
        if now == before:
            break
        before = now
    roots = _few(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct(), before[0])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
