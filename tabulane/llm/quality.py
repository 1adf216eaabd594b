"""Quality by a regularised quadratic discriminant over transformed statistics of a document."""

from __future__ import annotations

import sys
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.llm.common import over_batches

FEATURES = (
    "log_chars", "log_words", "log_word_length", "log_longest_word", "distinct_words", "distinct_lines",
    "lower", "upper", "digits", "stops", "marks", "symbols", "repeats", "log_line_length",
)
POOLED = 0.1  # share of the pooled covariance in each class covariance
DIAGONAL = 0.02  # share of the mean variance on the diagonal
ACCEPT = 0.7

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _SYMBOL = range(7)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every character."""

    def kind(c: str) -> int:
        if c.isalpha():
            return _UPPER if c.isupper() else _LOWER
        if c.isnumeric():
            return _DIGIT
        if c.isspace():
            return _SPACE
        return _STOP if c in ".," else _MARK if c in ";:!?'\"()-" else _SYMBOL

    return np.fromiter((kind(chr(c)) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


def _share(part: float, whole: float) -> float:
    """A share on the arcsine scale, where its variance depends little on its size."""
    return float(np.arcsin(np.sqrt(part / whole))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text; all zero for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = len(codes)
    kinds = np.bincount(_kinds()[codes], minlength=7)
    words, lines = text.split(), [line for line in text.split("\n") if line]
    solid = n - int(kinds[_SPACE])
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        float(np.log1p(solid / max(1, len(words)))),
        float(np.log1p(max(map(len, words), default=0))),
        _share(len(set(words)), len(words)),
        _share(len(set(lines)) + 4, len(lines) + 4),  # a few equal lines say little
        _share(kinds[_LOWER], n),
        _share(kinds[_UPPER], n),
        _share(kinds[_DIGIT], n),
        _share(kinds[_STOP], n),
        _share(kinds[_MARK], n),
        _share(kinds[_SYMBOL], n),
        _share(np.count_nonzero(codes[1:] == codes[:-1]), n),
        float(np.log1p(n / max(1, len(lines)))),
    ]


class Discriminant(NamedTuple):
    """Per class (0, 1): mean, inverse of the Cholesky factor of its covariance, log determinant; log prior odds of class 1.

    `means` is empty when the labels did not hold both classes: then `constant` is every score.
    """

    means: list[np.ndarray]
    whiten: list[np.ndarray]
    log_det: list[float]
    log_odds: float
    constant: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 by the difference of the log densities."""
        if not self.means:
            return np.full(len(x), self.constant)
        density = [
            -0.5 * (np.square((x - m) @ w.T).sum(axis=1) + d) for m, w, d in zip(self.means, self.whiten, self.log_det)
        ]
        odds = np.clip(density[1] - density[0] + self.log_odds, -700, 700)
        return 1 / (1 + np.exp(-odds))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, one column per feature) of every whole text; tag is a hash of the text.

    A null text counts as an empty one. One row per row of `docs`, null and repeated ids included; an empty table gives none; other
    columns are not read.
    """

    def work(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield {"id": batch.column(0), "tag": batch.column(2), **{f: rows[:, i] for i, f in enumerate(FEATURES)}}

    kind = docs.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{f} double" for f in FEATURES)
    read = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(text_col)))
    return over_batches(read, work, f"id {kind}, tag long, {fields}").withColumnRenamed("id", id_col)


def fit_discriminant(labelled: DataFrame, label_col: str, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """Fit to all rows of `labelled` (features and a label 0 or 1; other labels are passed over).

    One aggregate of counts, sums and products per class; two rows reach the driver. Labels of one class only give the
    constant score of that class, no labels the constant 1, so that nothing is rejected unlearned.
    """
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = (
        labelled.filter(F.col(label_col).isin(0, 1))
        .groupBy(F.col(label_col).cast("int").alias("_class"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
            *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs],
        )
        .collect()
    )
    if len(rows) < 2:
        return Discriminant([], [], [], 0.0, float(rows[0]["_class"]) if rows else 1.0)
    rows.sort(key=lambda r: r["_class"])
    n = np.array([r["n"] for r in rows], dtype=float)
    means, spreads = [], []
    for r in rows:
        mean = np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
        spread = np.zeros((p, p))
        for i, j in pairs:
            spread[i, j] = spread[j, i] = r[f"p{i}_{j}"] / r["n"] - mean[i] * mean[j]
        means.append(mean)
        spreads.append(spread)
    common = (spreads[0] * n[0] + spreads[1] * n[1]) / n.sum()
    whiten, log_det = [], []
    for spread in spreads:
        shrunk = (1 - pooled) * spread + pooled * common
        shrunk = (1 - diagonal) * shrunk + (diagonal * np.trace(shrunk) / p + 1e-9) * np.eye(p)
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        log_det.append(float(2 * np.log(np.diag(factor)).sum()))
    return Discriminant(means, whiten, log_det, float(np.log(n[1] / n[0])), 0.0)


def score_statistics(stats: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """(id, tag, score) from the columns of document_statistics, one row each; null ids and repeats as there."""

    def work(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            yield {"id": batch.column(id_col), "tag": batch.column("tag"), "score": model.scores(x)}

    kind = stats.schema[id_col].dataType.simpleString()
    return over_batches(stats, work, f"id {kind}, tag long, score double").withColumnRenamed("id", id_col)


def learn_quality(stats: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit to the rows of `stats` that meet `learn` and have a label; a document labelled more than once takes its smallest label."""
    one = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col)).agg(F.min(label_col).alias("_label"))
    return fit_discriminant(stats.filter(learn).join(one, id_col), "_label")
