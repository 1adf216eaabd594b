"""Regression trees, forests and boosting from mergeable histograms.

Rows become blocks of bin codes once. A pass over the blocks adds up, per open node, feature and bin, the weight and the gradient of its
rows; the larger of two siblings is its parent's histogram less the smaller one's. Leaves split in the order of their gain (a
priority queue), so a bound on leaves keeps the best ones. One pass serves all nodes the queue may need next, of all trees of a forest.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.session import cut_lineage

MAX_BINS = 255
ACCURACY = 10_000  # of the sketches bin edges are taken from, where a feature has more values than bins
CELLS = 2_000_000  # histogram cells one pass may ask for; more nodes take another pass
REFRESH = 8  # rounds of boosting after which predictions are written down again


# bins ---------------------------------------------------------------------------------------


def bin_edges(df: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper edges between bins: halfway between neighbouring values where they are at most `max_bins`, else quantiles of a sketch.

    Missing values are no part of the edges. What reaches the driver is at most `max_bins` numbers per feature.
    """
    x = [F.col(f"`{c}`").cast("double") for c in features]
    clean = [F.when(~F.isnan(c), c) for c in x]
    about = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(clean)]).first()
    few = [i for i in range(len(x)) if about[f"d{i}"] <= 2 * max_bins]
    found: dict[int, list[float]] = {}
    if few:
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), clean[i].alias("v")) for i in few])).alias("p")
        values = df.select(pairs).select("p.i", "p.v").filter("v IS NOT NULL").distinct()
        for r in values.groupBy("i").agg(F.sort_array(F.collect_set("v")).alias("v")).collect():  # about 2 * max_bins values each
            found[r["i"]] = r["v"]
        found.update({i: [] for i in few if i not in found})
    many = [i for i in range(len(x)) if len(found.get(i, [None] * (max_bins + 1))) > max_bins]
    edges: list[np.ndarray] = [np.zeros(0)] * len(x)
    for i, v in found.items():
        edges[i] = (np.array(v[:-1]) + np.array(v[1:])) / 2 if v else np.zeros(0)
    if many:
        probs = [k / max_bins for k in range(1, max_bins)]
        row = df.agg(*[F.percentile_approx(clean[i], probs, ACCURACY).alias(f"q{i}") for i in many]).first()
        for i in many:
            edges[i] = np.unique(np.array(row[f"q{i}"], dtype=float))
    return edges


def _code(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of each value; one past the last bin where it is missing."""
    codes = np.searchsorted(edges, values, side="left")
    return np.where(np.isnan(values), len(edges) + 1, codes).astype(np.uint16)


def coded_blocks(df: DataFrame, target: str, features: list[str], edges: list[np.ndarray]) -> DataFrame:
    """(block, codes, y): a row per Arrow batch, its codes feature by feature. Rows without a target are left out. Written to the shared folder."""
    cols = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    numbers = df.select(*cols, F.col(f"`{target}`").cast("double").alias("y")).filter("y IS NOT NULL AND NOT isnan(y)")

    def work(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            if len(columns[-1]):
                codes = np.concatenate([_code(x, e) for x, e in zip(columns, edges)])
                yield pa.RecordBatch.from_pydict({"codes": [codes.tobytes()], "y": [columns[-1].tobytes()]})

    blocks = numbers.mapInArrow(work, "codes binary, y binary")
    return cut_lineage(blocks.select(F.monotonically_increasing_id().alias("block"), "codes", "y"))


# trees --------------------------------------------------------------------------------------


@dataclass
class Node:
    path: int  # 1 is the root; children of p are 2p and 2p + 1
    n: float  # weight of its rows
    g: float  # sum of their gradients
    depth: int
    split: tuple[int, int, bool] | None = None  # feature, last bin to the left, whether missing goes left
    gain: float = 0.0
    left_n: float = 0.0
    left_g: float = 0.0


@dataclass
class Limits:
    """What bounds a tree; the names are those of the model catalogue."""

    max_depth: int | None = 5
    min_samples_split: float = 2
    min_samples_leaf: float = 1
    max_leaf_nodes: int | None = None
    min_impurity_decrease: float = 0.0
    l2: float = 0.0
    max_features: int | None = None


@dataclass
class Tree:
    """Nodes by path; those without `split` are leaves."""

    nodes: dict[int, Node]
    edges: list[np.ndarray]
    scale: float = 1.0
    l2: float = 0.0
    flat: tuple = field(default=None, repr=False)

    def value(self, node: Node) -> float:
        return self.scale * node.g / (node.n + self.l2) if node.n + self.l2 else 0.0

    def arrays(self) -> tuple:
        """Feature (-1: leaf), bin, missing to the left, left child, right child, value: one entry per node."""
        if self.flat is None:
            at = {p: i for i, p in enumerate(sorted(self.nodes))}
            nodes = [self.nodes[p] for p in at]
            split = [n.split or (-1, 0, False) for n in nodes]
            children = [[at.get(2 * n.path + side, 0) if n.split else 0 for n in nodes] for side in (0, 1)]
            self.flat = tuple(np.array(a) for a in (*map(list, zip(*split)), *children, [self.value(n) for n in nodes]))
        return self.flat

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        """Place of the leaf of each column of `codes` (features, rows)."""
        feature, bins, missing_left, left, right, _ = self.arrays()
        at = np.zeros(codes.shape[1], np.int64)
        last = np.array([len(e) + 1 for e in self.edges])
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            here, code = at[inner], codes[f[inner], inner]
            to_left = np.where(code == last[f[inner]], missing_left[here], code <= bins[here])
            at[inner] = np.where(to_left, left[here], right[here])

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.arrays()[5][self.leaf_of(codes)]

    def leaves(self) -> int:
        return sum(n.split is None for n in self.nodes.values())

    def depth(self) -> int:
        return max(n.depth for n in self.nodes.values())


def _best_split(node: Node, cells: np.ndarray, edges: list[np.ndarray], limits: Limits, features: np.ndarray) -> None:
    """The split of the largest gain from the node's cells [feature, bin, (weight, gradient)]; none where no split may be made."""
    node.split, node.gain = None, 0.0
    deep = limits.max_depth is not None and node.depth >= limits.max_depth
    if deep or node.n < limits.min_samples_split or node.n < 2 * limits.min_samples_leaf:
        return
    whole = node.g**2 / (node.n + limits.l2)
    for f in features:
        bins = len(edges[f]) + 1
        sums = np.cumsum(cells[f, :bins], axis=0)
        absent = cells[f, bins]
        for missing_left in (False, True) if absent[0] > 0 else (False,):
            # where rows are missing, all others to the left is a split of its own
            left = (sums if absent[0] > 0 and not missing_left else sums[:-1]) + (absent if missing_left else 0)
            n, g = left[:, 0], left[:, 1]
            fits = (n >= limits.min_samples_leaf) & (node.n - n >= limits.min_samples_leaf) & (n > 0) & (node.n - n > 0)
            if not fits.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, g**2 / (n + limits.l2) + (node.g - g) ** 2 / (node.n - n + limits.l2) - whole, -np.inf)
            b = int(np.argmax(gain))
            if gain[b] > node.gain * (1 + 1e-12) + 1e-12 * max(1.0, abs(whole)):
                node.gain, node.split, node.left_n, node.left_g = float(gain[b]), (int(f), b, missing_left), float(n[b]), float(g[b])


class Grower:
    """Grows trees best-first from passes over coded blocks.

    `rows(block, codes, y)` gives each tree's (weights, gradients) of a block's rows; it runs on the executors.
    """

    def __init__(self, blocks: DataFrame, edges: list[np.ndarray], limits: Limits, trees: int, rows: Callable, seed: int = 0, scale: float = 1.0):
        self.blocks, self.edges, self.limits, self.rows, self.seed, self.scale = blocks, edges, limits, rows, seed, scale
        self.width = max(len(e) for e in edges) + 2
        self.known: list[dict[int, Node]] = [{} for _ in range(trees)]  # nodes whose best split is known
        self.cells: list[dict[int, np.ndarray]] = [{} for _ in range(trees)]

    def _features(self, tree: int, path: int) -> np.ndarray:
        p, most = len(self.edges), self.limits.max_features
        if most is None or most >= p:
            return np.arange(p)
        return np.sort(np.random.default_rng([self.seed, tree, path % (1 << 62)]).permutation(p)[:most])

    def _replay(self, tree: int) -> tuple[dict[int, Node], list[tuple[int, Node | None]]]:
        """The tree as far as known splits lead, and the nodes whose splits have to be known to go on.

        Leaves pop by gain. Once a popped split has a child of unknown gain the order of later ones is a guess, which only
        decides what the next pass asks for: the next replay starts from the root again.
        """
        known, nodes, asked, heap = self.known[tree], {}, [], []

        def place(node: Node) -> None:
            nodes[node.path] = Node(node.path, node.n, node.g, node.depth)
            if node.path not in known:
                asked.append(node)
            elif node.path in known and known[node.path].split and known[node.path].gain >= self.limits.min_impurity_decrease * known_root.n:
                heapq.heappush(heap, (-known[node.path].gain, node.path))

        known_root = known.get(1)
        if known_root is None:
            return {}, [(1, None)]
        place(known_root)
        leaves = 1
        while heap and (self.limits.max_leaf_nodes is None or leaves < self.limits.max_leaf_nodes):
            _, path = heapq.heappop(heap)
            node = known[path]
            nodes[path] = node
            place(Node(2 * path, node.left_n, node.left_g, node.depth + 1))
            place(Node(2 * path + 1, node.n - node.left_n, node.g - node.left_g, node.depth + 1))
            leaves += 1
        return nodes, [(n.path, n) for n in asked]

    def _pass(self, wanted: list[tuple[int, int]], trees: dict[int, Tree]) -> None:
        """Add up the cells of (tree, path) nodes in one scan of the blocks."""
        edges, width, rows, p = self.edges, self.width, self.rows, len(self.edges)
        places: dict[int, dict[int, int]] = {}
        for i, (tree, path) in enumerate(wanted):
            places.setdefault(tree, {})[path] = i
        lookup = {t: np.array([places[t].get(path, -1) for path in sorted(tree.nodes)]) for t, tree in trees.items()}

        def work(batches):
            total = np.zeros((len(wanted), p, width, 2))
            for batch in batches:
                for block, codes, y in zip(*(c.to_pylist() for c in batch.columns)):
                    codes, y = np.frombuffer(codes, np.uint16).reshape(p, -1), np.frombuffer(y)
                    drawn = rows(block, codes, y)
                    for t, tree in trees.items():
                        weight, gradient = drawn[t]
                        node = lookup[t][tree.leaf_of(codes)]
                        at = np.flatnonzero((node >= 0) & (weight > 0))
                        if not len(at):
                            continue
                        w, g, node = weight[at], (weight * gradient)[at], node[at]
                        for f in range(p):
                            cell = node * width + codes[f, at]
                            for k, v in enumerate((w, g)):
                                total[:, f, :, k] += np.bincount(cell, v, len(wanted) * width).reshape(-1, width)
            flat = total.reshape(-1, 2)
            cell = np.flatnonzero(flat.any(axis=1))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int64()), "n": flat[cell, 0], "g": flat[cell, 1]})

        sums = self.blocks.select("block", "codes", "y").mapInArrow(work, "cell long, n double, g double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
        flat = np.zeros((len(wanted) * p * width, 2))
        table = sums.toPandas()  # at most CELLS rows
        flat[table["cell"].to_numpy(np.int64)] = table[["n", "g"]].to_numpy(float)
        for (tree, path), cells in zip(wanted, flat.reshape(len(wanted), p, width, 2)):
            self.cells[tree][path] = cells

    def grow(self) -> list[Tree]:
        limit = max(1, CELLS // (len(self.edges) * self.width))
        while True:
            found = [self._replay(t) for t in range(len(self.known))]
            asked = [(t, path, node) for t, (_, nodes) in enumerate(found) for path, node in nodes]
            if not asked:
                return [Tree(nodes, self.edges, self.scale, self.limits.l2) for nodes, _ in found]
            wanted, of = [], {}
            for t, path, node in asked:
                of[(t, path)] = node
            # of two siblings the smaller is counted, unless it is alone in being asked for
            for t, path, node in asked:
                sibling = of.get((t, path ^ 1)) if path > 1 else None
                if sibling is None or node.n < sibling.n or (node.n == sibling.n and path % 2 == 0):
                    wanted.append((t, path))
            whole = {t: Tree(nodes or {1: Node(1, 0, 0, 0)}, self.edges) for t, (nodes, todo) in enumerate(found) if todo}
            for start in range(0, len(wanted), limit):
                some = wanted[start : start + limit]
                self._pass(some, {t: whole[t] for t, _ in some})
            for t, path, node in asked:
                cells = self.cells[t]
                if path not in cells:
                    cells[path] = cells[path // 2] - cells[path ^ 1]
                total = cells[path][0].sum(axis=0)
                node = Node(path, float(total[0]), float(total[1]), path.bit_length() - 1)
                _best_split(node, cells[path], self.edges, self.limits, self._features(t, path))
                self.known[t][path] = node
            for t, nodes in enumerate(self.known):  # a parent's cells are needed no longer once both children are known
                for path in [q for q in self.cells[t] if 2 * q in nodes and 2 * q + 1 in nodes]:
                    del self.cells[t][path]


# models -------------------------------------------------------------------------------------


@dataclass
class Ensemble:
    """base + the sum of the trees' values; `learned_missing` are the features that missed values in training, so that a side was learned for them."""

    features: list[str]
    trees: list[Tree]
    base: float = 0.0
    learned_missing: list[str] = field(default_factory=list)
    rounds: int | None = None
    forest: bool = False

    def value(self, df: DataFrame) -> Column:
        trees, base = self.trees, self.base

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            codes = np.array([_code(x.iloc[:, i].to_numpy(float, na_value=np.nan), e) for i, e in enumerate(trees[0].edges)])
            return pd.Series(base + sum(t.predict(codes) for t in trees))

        return score(F.struct(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(self.features)]))

    def coefficients(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits; in a forest each tree counts the same."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            gain = np.zeros(len(self.features))
            for node in tree.nodes.values():
                if node.split:
                    gain[node.split[0]] += node.gain
            total += gain / gain.sum() if self.forest and gain.sum() else gain
        return {f"{f}_importance": float(v / total.sum()) if total.sum() else 0.0 for f, v in zip(self.features, total)}

    def details(self) -> dict[str, float]:
        if self.rounds is not None:
            return {"n_iterations": float(self.rounds), "n_estimators_fitted": float(len(self.trees))}
        if self.forest:
            return {"n_estimators_fitted": float(len(self.trees))}
        return {"tree_depth": float(self.trees[0].depth()), "n_leaves": float(self.trees[0].leaves())}

    def splits(self) -> list[tuple[int, int, str | None, float | None, bool | None, float, float]]:
        """(tree, node, feature, threshold, missing to the left, rows, value) of every node; the root is 1, children of p are 2p and 2p + 1."""
        out = []
        for t, tree in enumerate(self.trees):
            for path, n in sorted(tree.nodes.items()):
                f, b, left = n.split or (None, None, None)
                edge = None if f is None else float(tree.edges[f][b]) if b < len(tree.edges[f]) else float("inf")
                out.append((t, path, None if f is None else self.features[f], edge, left, n.n, tree.value(n)))
        return out


def fit_trees(df: DataFrame, target: str, features: list[str], limits: Limits, trees: int = 1, bootstrap: bool = False, share: float = 1.0, seed: int = 42, max_bins: int = MAX_BINS) -> Ensemble:
    """One tree, or a forest whose trees average. Bootstrapped rows count Poisson(share) times, drawn from (seed, tree, block).

    Missing feature values go to the better side of a split.
    """
    edges = bin_edges(df, features, max_bins)
    blocks = coded_blocks(df, target, features, edges)

    def rows(block, codes, y):
        if not bootstrap:
            return [(np.ones(len(y)), y)] * trees
        return [(np.random.default_rng([seed, t, block]).poisson(share, len(y)).astype(float), y) for t in range(trees)]

    grown = Grower(blocks, edges, limits, trees, rows, seed, 1 / trees).grow()
    if not grown[0].nodes or (not bootstrap and not grown[0].nodes[1].n):
        raise ValueError("no rows to fit on")
    return Ensemble(list(features), grown, forest=trees > 1)


@dataclass
class Stopping:
    """Stop once the loss on held-out rows has not fallen by `tol` for `rounds` rounds; None: never."""

    rounds: int | None = None
    share: float = 0.1
    tol: float = 1e-7


def fit_boosting(
    df: DataFrame, target: str, features: list[str], limits: Limits, rounds: int = 100, rate: float = 0.1, subsample: float = 1.0, stopping: Stopping | None = None, seed: int = 42, max_bins: int = MAX_BINS
) -> Ensemble:
    """Squared-error boosting: each tree fits what is left of the target; its leaves hold `rate` times sum(left) / (rows + l2).

    Missing values have a bin of their own and go to the side that gains more. Predictions are written with the blocks every few
    rounds, so a round only walks the trees since then.
    """
    stopping = stopping or Stopping()
    edges = bin_edges(df, features, max_bins)
    blocks = coded_blocks(df, target, features, edges)
    p = len(edges)
    held = stopping.share if stopping.rounds else 0.0

    def is_held(block: int, n: int) -> np.ndarray:
        return np.random.default_rng([seed, 1 << 40, block]).random(n) < held if held else np.zeros(n, bool)

    def totals(batches, since: list[Tree] = (), base: float = 0.0):
        for batch in batches:
            sums = np.zeros(4)
            for block, codes, y in zip(*(c.to_pylist() for c in batch.columns)):
                left = np.frombuffer(y) - base
                if since:
                    codes = np.frombuffer(codes, np.uint16).reshape(p, -1)
                    left = left - sum(t.predict(codes) for t in since)
                out = is_held(block, len(left))
                sums += [(~out).sum(), left[~out].sum(), out.sum(), np.square(left[out]).sum()]
            yield pa.RecordBatch.from_pydict({f"s{i}": [v] for i, v in enumerate(sums.tolist())})

    def added(since=(), base=0.0):
        found = blocks.mapInArrow(lambda b: totals(b, since, base), "s0 double, s1 double, s2 double, s3 double")
        return found.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(4)]).first()

    first = added()
    if not first["s0"]:
        raise ValueError("no rows to fit on")
    base = first["s1"] / first["s0"]
    missing = df.agg(*[F.max(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))).alias(f"m{i}") for i, c in enumerate(features)]).first()
    gaps = [c for i, c in enumerate(features) if missing[f"m{i}"]]
    trees: list[Tree] = []
    since: list[Tree] = []
    offset, best, stale = base, None, 0
    for i in range(rounds):

        def rows(block, codes, y, since=tuple(since), offset=offset, i=i):
            left = y - offset - (sum(t.predict(codes) for t in since) if since else 0.0)
            weight = (~is_held(block, len(y))).astype(float)
            if subsample < 1:
                weight *= np.random.default_rng([seed, i, block]).random(len(y)) < subsample
            return [(weight, left)]

        (tree,) = Grower(blocks, edges, limits, 1, rows, seed + i, rate).grow()
        trees.append(tree)
        since.append(tree)
        if stopping.rounds and first["s2"]:
            now = added(tuple(since), offset)
            loss = now["s3"] / now["s2"]
            stale = 0 if best is None or loss < best - stopping.tol else stale + 1
            best = loss if best is None else min(best, loss)
            if stale >= stopping.rounds:
                break
        if len(since) >= REFRESH and i + 1 < rounds:

            def settle(batches, since=tuple(since), offset=offset):
                for batch in batches:
                    for block, codes, y in zip(*(c.to_pylist() for c in batch.columns)):
                        matrix = np.frombuffer(codes, np.uint16).reshape(p, -1)
                        left = np.frombuffer(y) - offset - sum(t.predict(matrix) for t in since)
                        yield pa.RecordBatch.from_pydict({"block": [block], "codes": [codes], "y": [left.tobytes()]})

            blocks = cut_lineage(blocks.mapInArrow(settle, "block long, codes binary, y binary"))
            since, offset = [], 0.0
    return Ensemble(list(features), trees, base, gaps, rounds=len(trees))
