"""Exact percentiles by narrowing.

Spark's exact percentile keeps every distinct value of a group in one buffer. Here a sketch only
proposes two pivots near the wanted rank; counting around them tells, exactly, which side the rank
is on. A round shrinks the candidates by orders of magnitude, until they are few enough to look at.
All columns and probabilities share the rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW = 20_000  # candidates of one rank that may be sorted in a single row (160 KB)
PER_JOB = 50 * FEW  # candidates looked at in one job
MAX_ACCURACY = 5_000  # of the pivot sketch; it affects the number of rounds, never the result
PARTS = 256  # groups of tasks whose sketches are merged first


@dataclass
class _Search:
    """Where the value of rank `rank` (0-based, among non-missing values) can still be."""

    col: str
    rank: int
    total: int
    low: float | None = None  # exclusive bounds
    high: float | None = None
    below: int = 0  # values at or under `low`
    inside: int = 0
    value: float | None = None

    def candidate(self) -> Column:
        c, inside = F.col(self.col), F.col(self.col).isNotNull()
        if self.low is not None:
            inside = inside & (c > F.lit(self.low))
        if self.high is not None:
            inside = inside & (c < F.lit(self.high))
        return F.when(inside, c)

    @property
    def span(self):
        return (self.col, self.low, self.high)


def exact_percentiles(
    df: DataFrame, exprs: dict[str, Column], probs: list[float], few: int = FEW, sizes: dict[str, int] | None = None
) -> dict[str, list[float | None]]:
    """Percentiles with linear interpolation between ranks; None for an all-missing expression.

    The rounds read `df` several times: a scan is pruned to the columns asked for, but persist a table
    that is costly to compute. `sizes` are the numbers of non-missing values, where the caller has counted them already.
    """
    if not exprs:
        return {}
    names = {name: f"_c{i}" for i, name in enumerate(exprs)}
    data = df.select(*[e.cast("double").alias(names[n]) for n, e in exprs.items()])
    data = data.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in data.columns])
    if sizes is None:
        sizes = data.agg(*[F.count(c).alias(c) for c in data.columns]).first().asDict()
    else:
        sizes = {names[n]: sizes[n] for n in exprs}
    searches: dict[tuple[str, int], _Search] = {}
    for c in data.columns:
        for p in probs:
            if sizes[c]:
                at = p * (sizes[c] - 1)
                for rank in (math.floor(at), math.ceil(at)):
                    searches.setdefault((c, rank), _Search(c, rank, sizes[c], inside=sizes[c]))

    while any(s.value is None for s in searches.values()):
        todo = [s for s in searches.values() if s.value is None]
        wide = [s for s in todo if s.inside > few]
        if wide:
            _narrow(data, wide, few)
        else:
            _look_up(data, todo)

    result = {}
    for name, c in names.items():
        values = []
        for p in probs:
            if not sizes[c]:
                values.append(None)
                continue
            at = p * (sizes[c] - 1)
            a, b = searches[(c, math.floor(at))].value, searches[(c, math.ceil(at))].value
            values.append(a if a == b else a + (b - a) * (at - math.floor(at)))
        result[name] = values
    return result


def _by_span(searches: list[_Search]) -> list[list[_Search]]:
    """Searches over the same candidates, together; a span is sketched or sorted once."""
    spans: dict[tuple, list[_Search]] = {}
    for s in sorted(searches, key=lambda s: s.rank):
        spans.setdefault(s.span, []).append(s)
    return list(spans.values())


def _sketch_size(accuracy: int) -> int:
    """Size of a quantile sketch whose rank error is about 1 / accuracy (published error curve of the sketch, 2.3 / size^0.9)."""
    return min(65_000, max(200, math.ceil((2.3 * accuracy) ** (1 / 0.9))))


def _narrow(data: DataFrame, wide: list[_Search], few: int) -> None:
    """One sketch pass for pivots, one counting pass that decides on which side each rank is.

    Sketches are merged in two levels, so no task gets those of all input tasks.
    """
    groups = _by_span(wide)
    asks, merged, pivots_of = [], [], []
    for i, group in enumerate(groups):
        inside, below = group[0].inside, group[0].below
        accuracy = min(MAX_ACCURACY, max(100, 8 * inside // few))  # just fine enough to leave few
        around = set()
        for s in group:
            at = (s.rank - below) / max(1, inside - 1)
            around |= {min(1.0, max(0.0, round(at + d, 9))) for d in (-2 / accuracy, 2 / accuracy)}
        size = F.lit(_sketch_size(accuracy))
        asks.append(F.kll_sketch_agg_double(group[0].candidate(), size).alias(f"s{i}"))
        merged.append(F.kll_merge_agg_double(f"s{i}", size).alias(f"s{i}"))
        places = F.array(*[F.lit(float(a)) for a in sorted(around)])
        pivots_of.append(F.kll_sketch_get_quantile_double(F.col(f"s{i}"), places).alias(f"p{i}"))
    parts = data.groupBy(F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("_part")).agg(*asks)
    found = parts.agg(*merged).select(*pivots_of).first()
    pivots = [sorted(set(found[f"p{i}"])) for i in range(len(groups))]
    counts = []
    for i, group in enumerate(groups):
        c = F.col(group[0].col)
        for j, pivot in enumerate(pivots[i]):
            counts += [F.count_if(c < F.lit(pivot)).alias(f"lt{i}_{j}"), F.count_if(c <= F.lit(pivot)).alias(f"le{i}_{j}")]
    seen = data.agg(*counts).first()
    for i, group in enumerate(groups):
        for s in group:
            upper = s.below + s.inside
            for j, pivot in enumerate(pivots[i]):
                under, upto = seen[f"lt{i}_{j}"], seen[f"le{i}_{j}"]
                if s.rank < under:
                    s.high, upper = pivot, under
                    break
                if s.rank < upto:
                    s.value = pivot
                    break
                s.low, s.below = pivot, upto
            s.inside = upper - s.below


def _look_up(data: DataFrame, todo: list[_Search]) -> None:
    """At most `few` candidates each: sort them and read the wanted places."""
    job, size = [], 0
    for group in _by_span(todo):
        if job and size + group[0].inside > PER_JOB:
            _read_places(data, job)
            job, size = [], 0
        job.append(group)
        size += group[0].inside
    _read_places(data, job)


def _read_places(data: DataFrame, groups: list[list[_Search]]) -> None:
    asks = []
    for i, group in enumerate(groups):
        ordered = F.sort_array(F.collect_list(group[0].candidate()))
        places = [F.element_at(ordered, s.rank - s.below + 1) for s in group]
        asks.append(F.array(*places).alias(f"v{i}"))
    row = data.agg(*asks).first()
    for i, group in enumerate(groups):
        for s, value in zip(group, row[f"v{i}"]):
            s.value = value
