"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted to a bounded sample and every row is put into its leaf. A query takes the leaves out of a priority queue, nearest centre
first; how many it takes was widened until a set of calibration queries, whose true neighbours are known, reached the recall. Inner
products become distances by one more coordinate, sqrt(M^2 - |x|^2), M being the largest norm.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulane.llm.common import over_batches
from tabulane.session import cut_lineage

SAMPLE = 20_000  # vectors the tree is fitted to, fewer where they are long:
SAMPLE_BYTES = 64 << 20  # bytes of those vectors; at most twice as many reach the driver
BRANCH = 8  # children of a node
LEAF = 64  # sample vectors below which a node is not split
ROUNDS = 8  # k-means rounds of a split
CALIBRATION = 200  # calibration queries
RECALL = 0.97  # their recall, from which the number of leaves is taken
BLOCK = 2048  # vectors or queries in a block


class Tree(NamedTuple):
    """Centres of all nodes but the root; children[i] of node i (root: 0), leaf number or -1 of each node."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    largest: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.maximum(largest**2 - np.square(x).sum(axis=1), 0)
    return np.column_stack([x, np.sqrt(rest)])


def fit_tree(sample: np.ndarray, largest: float, branch: int = BRANCH, leaf: int = LEAF) -> Tree:
    """K-means within k-means, until a node holds at most `leaf` vectors or cannot be told apart; the same for the same sample."""
    x = lifted(sample, largest)
    centres, children, leaves = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [[]], [-1]
    waiting, numbered = [(0, np.arange(len(x)))], 0
    while waiting:
        node, rows = waiting.pop()
        parts = _kmeans(x[rows], branch, node) if len(rows) > leaf else []
        if len(parts) < 2:
            leaves[node] = numbered
            numbered += 1
            continue
        for centre, own in parts:
            children[node].append(len(centres))
            waiting.append((len(centres), rows[own]))
            centres.append(centre)
            children.append([])
            leaves.append(-1)
    return Tree(np.array(centres), children, np.array(leaves), largest)


def _kmeans(x: np.ndarray, k: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    known = np.unique(x, axis=0)
    centres = known[np.random.default_rng(seed).permutation(len(known))[:k]]
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        used = [j for j in range(len(centres)) if (near == j).any()]
        centres = np.array([x[near == j].mean(axis=0) for j in used])
    near = _nearest(x, centres)
    return [(c, np.flatnonzero(near == j)) for j, c in enumerate(centres) if (near == j).any()]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(np.square(centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each vector: the nearest child, level by level."""
    x = lifted(x, tree.largest)
    out, waiting = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
    while waiting:
        node, rows = waiting.pop()
        if not len(rows):
            continue
        if not tree.children[node]:
            out[rows] = tree.leaf[node]
            continue
        near = _nearest(x[rows], tree.centres[tree.children[node]])
        waiting += [(child, rows[near == j]) for j, child in enumerate(tree.children[node])]
    return out


def best_bins(tree: Tree, query: np.ndarray, most: int) -> list[int]:
    """The first `most` leaves a query visits: nodes leave a priority queue by the distance of their centres."""
    q = np.append(query, 0.0)
    queue, found = [(0.0, 0)], []
    while queue and len(found) < most:
        _, node = heapq.heappop(queue)
        below = tree.children[node]
        if not below:
            found.append(int(tree.leaf[node]))
            continue
        for child, far in zip(below, np.square(tree.centres[below] - q).sum(axis=1).tolist()):
            heapq.heappush(queue, (far, child))
    return found


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products whose value does not depend on the place of a vector in its block, so equal vectors tie."""
    return np.stack([(vectors * q).sum(axis=1) for q in queries]) if len(queries) else np.zeros((0, len(vectors)))


def block_top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(row of query, row of vector, score) of the k nearest of a block to each query, ties to smaller ids, without the query itself."""
    rough = queries @ vectors.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    n = min(k, len(ids))
    edge = np.partition(rough, len(ids) - n, axis=1)[:, len(ids) - n]
    slack = 1e-9 * np.linalg.norm(queries, axis=1) * (np.linalg.norm(vectors, axis=1).max() if len(vectors) else 0)
    out = []
    for i, least in enumerate(edge - slack):
        near = np.flatnonzero((rough[i] >= least) & (rough[i] > -np.inf))
        score = exact_scores(queries[i : i + 1], vectors[near])[0]
        best = np.lexsort((ids[near], -score))[:k]
        out.append((np.full(len(best), i), near[best], score[best]))
    return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3))


def _pack_blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row (leaf, ids, data) per block of vectors."""

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        data = np.array(block["v"].tolist(), dtype="f8")
        return pd.DataFrame({"leaf": [block["leaf"].iloc[0]], "ids": [block["id"].to_numpy("i8").tobytes()], "data": [data.tobytes()]})

    return rows.groupBy(*by).applyInPandas(pack, "leaf long, ids binary, data binary")


def _top(found: DataFrame, k: int) -> DataFrame:
    """`found` with the rank of each row among those of its query, the first k of each.

    Spark cuts to k per query in every task before the shuffle and ranks what is left by a sort that can spill, so no list of all that
    the blocks found is ever held.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(vector: Column) -> Column:
    """Neither null nor zero, nor with null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest_neighbours(
    table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row that meets `is_query` the k rows of largest inner product found, itself left out.

    Ties go to the smaller id. Rows whose vector is null, empty, zero or has a null or non-finite component, or whose id is null, take
    no part; vectors have to be equally long (the length most frequent wins, others take no part). Rows of one id are one vector each and never their
    own candidates. With fewer than k candidates all are returned; an empty table gives none; other columns are not read.

    Index: every row gets a leaf; leaves are stored in blocks of at most about BLOCK vectors, so a leaf of very many equal vectors is many
    blocks. Search: blocks of queries meet blocks of the leaves they visit; each meeting keeps k per query.
    """
    spark = table.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = table.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("q"), F.size(vector_col).alias("n")
    )
    common = rows.groupBy("n").count().orderBy(F.col("count").desc(), "n").first()
    schema = f"query_id long, rank int, {id_col} long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    size, total = common["n"], common["count"]
    rows = rows.filter(F.col("n") == size).drop("n")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    largest = float(np.sqrt(rows.agg(F.max(squares).alias("m")).first()["m"]))

    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    every = max(1, -(-total // most))
    hashed = F.xxhash64(F.col("id"), F.lit("sample"))
    sample = rows.filter(F.pmod(hashed, F.lit(every)) == 0).orderBy(hashed, "id").limit(2 * most).select("v").collect()
    tree = fit_tree(np.array([r["v"] for r in sample], dtype="f8").reshape(-1, size), largest)
    shared = spark.sparkContext.broadcast(tree)  # at most about 2 * SAMPLE / LEAF * BRANCH centres

    def place(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype="f8").reshape(-1, size)
            yield {"id": batch.column(0), "v": batch.column(1), "q": batch.column(2), "leaf": leaf_of(shared.value, x)}

    index = cut_lineage(over_batches(rows, place, "id long, v array<double>, q boolean, leaf long"))
    queries = index.filter("q").select("id", "v")
    visits = _calibrate(index, queries, tree, size, k, recall, total)

    def visit(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype="f8").reshape(-1, size)
            for i, query in enumerate(x):
                bins = best_bins(shared.value, query, visits)
                yield {"id": [batch.column(0)[i].as_py()] * len(bins), "v": [query] * len(bins), "leaf": bins}

    counts = index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
    dealt = index.join(counts, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), blocks)).select("leaf", "block", "id", "v")
    stored = _pack_blocks(dealt, ["leaf", "block"])
    asked = over_batches(queries, visit, "id long, v array<double>, leaf long")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // BLOCK // 16)))))
    asked = _pack_blocks(asked, ["leaf", "block"]).select("leaf", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"))

    def meet(batches):
        for batch in batches:
            for ids, data, query_ids, query_data in zip(*(batch.column(c).to_pylist() for c in ("ids", "data", "query_ids", "query_data"))):
                ids, query_ids = np.frombuffer(ids, "i8"), np.frombuffer(query_ids, "i8")
                q, at, score = block_top(np.frombuffer(query_data).reshape(-1, size), query_ids, np.frombuffer(data).reshape(-1, size), ids, k)
                yield {"query_id": query_ids[q.astype(int)], "id": ids[at.astype(int)], "score": score}

    met = over_batches(stored.join(asked, "leaf").drop("leaf"), meet, "query_id long, id long, score double")
    return _top(met, k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _calibrate(index: DataFrame, queries: DataFrame, tree: Tree, size: int, k: int, recall: float, total: int) -> int:
    """Leaf visits at which the calibration queries find `recall` of their true neighbours; all leaves if nothing less does.

    The true neighbours come from one exact pass of at most CALIBRATION queries over all vectors.
    """
    hashed = F.xxhash64(F.col("id"), F.lit("calibrate"))
    some = queries.orderBy(hashed, "id").limit(CALIBRATION).collect()
    if not some:
        return 1
    ids = np.array([r["id"] for r in some], dtype="i8")
    x = np.array([r["v"] for r in some], dtype="f8").reshape(-1, size)

    def search(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            q, at, score = block_top(x, ids, np.array(batch.column(1).to_pylist(), dtype="f8").reshape(-1, size), own, k)
            at = at.astype(int)
            yield {"query_id": ids[q.astype(int)], "id": own[at], "leaf": batch.column(2).to_numpy()[at], "score": score}

    found = over_batches(index.select("id", "v", "leaf"), search, "query_id long, id long, leaf long, score double")
    leaves: dict[int, list[int]] = {}
    for r in _top(found, k).select("query_id", "leaf").collect():
        leaves.setdefault(r["query_id"], []).append(r["leaf"])
    places = []
    for i, query in zip(ids.tolist(), x):
        order = {leaf: n for n, leaf in enumerate(best_bins(tree, query, tree.leaves))}
        places += [order[leaf] for leaf in leaves.get(i, [])]
    places = np.sort(np.array(places))
    visits = 1
    while visits < tree.leaves and (places < visits).sum() < recall * len(places):
        visits += 1
    return visits
