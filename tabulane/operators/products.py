"""Sums over all pairs of columns in one scan.

Each task multiplies its Arrow batches as matrices and passes on one row per pair; the rows are then added up per pair, so
neither the scans nor what one task holds grow with the number of rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PairSums(NamedTuple):
    """For columns i and j, over the rows that have both: their number, the sums and squares of i, the products of i and j."""

    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    p: np.ndarray


_SCHEMA = "pair int, n long, s double, q double, p double"


FEW_COLUMNS = 8  # up to so many columns without missing values, one plain aggregate is cheaper than matrices in Python


def _complete_sums(df: DataFrame, values: list[Column], shift: list[float]) -> PairSums:
    """`pair_sums` of columns without missing values, in one aggregate of the JVM."""
    width = len(values)
    data = df.select(*[(v.cast("double") - F.lit(float(m))).alias(f"x{i}") for i, (v, m) in enumerate(zip(values, shift))])
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = [F.sum(f"x{i}") for i in range(width)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]
    n, *found = data.agg(F.count(F.lit(1)), *[s.alias(f"_{k}") for k, s in enumerate(sums)]).first()
    found = np.array([0.0 if x is None else x for x in found])
    p = np.zeros((width, width))
    for (i, j), x in zip(pairs, found[width:]):
        p[i, j] = p[j, i] = x
    s, q = (np.repeat(column[:, None], width, axis=1) for column in (found[:width], np.diag(p)))
    return PairSums(np.full((width, width), float(n)), s, q, p)


def pair_sums(df: DataFrame, values: list[Column], shift: list[float], complete: bool = False) -> PairSums:
    """Sums of the values less `shift` (means, so that nothing cancels). NULL is missing; p*p numbers per sum reach the driver.

    `complete` says that nothing is missing.
    """
    width = len(values)
    if complete and width <= FEW_COLUMNS:
        return _complete_sums(df, values, shift)
    data = df.select(*[(v.cast("double") - F.lit(float(m))).alias(f"x{i}") for i, (v, m) in enumerate(zip(values, shift))])

    def work(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            if there.all():
                rows = np.full((width, width), float(len(x)))
                s = np.repeat(x.sum(axis=0)[:, None], width, axis=1)
                q = np.repeat((x * x).sum(axis=0)[:, None], width, axis=1)
            else:
                x, mask = np.where(there, x, 0.0), there.astype(np.float64)
                rows, s, q = mask.T @ mask, x.T @ mask, (x * x).T @ mask
            part = np.stack([rows, s, q, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            rows, s, q, p = (t.ravel() for t in total)
            columns = [np.arange(width * width, dtype=np.int32), rows.astype(np.int64), s, q, p]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pair", "n", "s", "q", "p"])

    added = data.mapInArrow(work, _SCHEMA).groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "p")])
    result = PairSums(*[np.zeros((width, width)) for _ in range(4)])
    for row in added.collect():
        at = divmod(row["pair"], width)
        for name in ("n", "s", "q", "p"):
            getattr(result, name)[at] = row[name]
    return result
