"""Least angle regression and the lasso path, followed from knot to knot on a table's sums of products.

Along a piece of the path the products of all active features with the residual shrink at one rate. The next knot is where another feature
catches up with them (it enters) or, for the lasso, where a weight reaches zero (it leaves). The triangular factor of the active block grows
by a row or is mended by rotations; it is never computed anew. Nothing here grows with the rows: the sums are p x p.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

TIE = 1e-12  # relative size below which a product, a pivot or a step counts as zero


class Knot(NamedTuple):
    """Where the path turns: the largest product of a feature with the residual, and all weights."""

    product: float
    weights: np.ndarray


class Factor:
    """L with L L' = the active block, kept up to date while features enter and leave."""

    def __init__(self) -> None:
        self.low = np.zeros((0, 0))

    def _forward(self, b: np.ndarray) -> np.ndarray:
        x = np.zeros(len(b))
        for i in range(len(b)):
            x[i] = (b[i] - self.low[i, :i] @ x[:i]) / self.low[i, i]
        return x

    def solve(self, b: np.ndarray) -> np.ndarray:
        half, x = self._forward(b), np.zeros(len(b))
        for i in range(len(b) - 1, -1, -1):
            x[i] = (half[i] - self.low[i + 1 :, i] @ x[i + 1 :]) / self.low[i, i]
        return x

    def enter(self, products: np.ndarray, square: float) -> bool:
        """Add a feature by its products with the active ones; False if it is a combination of them."""
        row = self._forward(products)
        pivot = square - row @ row
        if pivot <= TIE * square:
            return False
        n = len(row)
        grown = np.zeros((n + 1, n + 1))
        grown[:n, :n], grown[n, :n], grown[n, n] = self.low, row, np.sqrt(pivot)
        self.low = grown
        return True

    def leave(self, k: int) -> None:
        """Take the k-th active feature out: drop its row, turn what then stands above the diagonal away, column by column."""
        low = np.delete(self.low, k, axis=0)
        for i in range(k, len(low)):
            size = np.hypot(low[i, i], low[i, i + 1])
            c, s = low[i, i] / size, low[i, i + 1] / size
            left, right = low[i:, i].copy(), low[i:, i + 1].copy()
            low[i:, i], low[i:, i + 1] = c * left + s * right, c * right - s * left
            low[i, i + 1] = 0.0
        self.low = low[:, : len(low)]


def _first(steps: np.ndarray, least: float) -> tuple[float, int]:
    """The smallest step that is not behind, and its place; (inf, -1) without one."""
    ahead = np.where(np.isfinite(steps) & (steps > least), steps, np.inf)
    if not len(ahead) or not np.isfinite(ahead.min()):
        return np.inf, -1
    return float(ahead.min()), int(np.argmin(ahead))


def angle_path(xx: np.ndarray, xy: np.ndarray, lasso: bool, most: int, least: float = 0.0) -> list[Knot]:
    """The knots from all weights zero to at most `most` turns, or to where the largest product is `least`.

    Of features that tie the first is taken; one that is a combination of the active ones is left out for good, so is a constant one.
    """
    p = len(xy)
    w, open_ = np.zeros(p), np.diag(xx) > 0
    active: list[int] = []
    signs = np.zeros(p)
    factor = Factor()
    start = float(np.abs(xy[open_]).max()) if open_.any() else 0.0
    knots = [Knot(start, w.copy())]
    level, enters = start, int(np.argmax(np.where(open_, np.abs(xy), -1.0))) if open_.any() else -1
    while len(knots) <= most and level > max(least, TIE * start) and (active or enters >= 0):
        rest = xy - xx @ w
        if enters >= 0:
            open_[enters] = False
            if factor.enter(xx[active, enters], xx[enters, enters]):
                active.append(enters)
                signs[enters] = np.sign(rest[enters])
        if not active:
            break
        towards = factor.solve(signs[active])
        rate = xx[:, active] @ towards
        others = np.flatnonzero(open_)
        c, a = rest[others], rate[others]
        with np.errstate(divide="ignore", invalid="ignore"):
            # one behind by rounding alone catches up at once
            up = np.where(a < 1 - TIE, np.maximum(level - c, 0) / (1 - a), np.inf)
            down = np.where(a > -1 + TIE, np.maximum(level + c, 0) / (1 + a), np.inf)
            step, which = _first(np.minimum(up, down), -1.0)
            enters = int(others[which]) if which >= 0 else -1
            zero, gone = _first(-w[active] / towards, TIE * level) if lasso else (np.inf, -1)
        end = level - least
        if min(step, zero) >= end:
            w[active] += end * towards
            knots.append(Knot(least, w.copy()))
            break
        if zero < step:
            step, enters = zero, -1
        w[active] += step * towards
        level -= step
        if zero == step:
            left = active.pop(gone)
            factor.leave(gone)
            w[left], signs[left], open_[left] = 0.0, 0.0, True
        if step > TIE * start:
            knots.append(Knot(level, w.copy()))
    return knots
