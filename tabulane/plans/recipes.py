"""Named transform steps and ordered recipes of them.

A step is a dict {"step_id", "type", "output_column", "params", "order", "created_at"?}.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulane.functions.formula import referenced_names, typed_formula
from tabulane.functions.scalars import missing_as_null
from tabulane.operators.longform import to_rows
from tabulane.operators.projection import preview, require_columns, select_columns

EXP_LIMIT = 700.0  # fixed value: exponents are held to this range
FORMULA_CHARS = 500  # fixed value: longest formula of a step


class Transform(NamedTuple):
    build: Callable[[DataFrame, dict], Column]
    inputs: Callable[[dict], list[str]]
    warn: Callable[[dict], Column] | None = None  # condition that counts as a warning
    # columns the step reads several times, each computed in a projection of its own below the step;
    # `build` and later helpers find their names in params
    helpers: dict[str, Callable[[DataFrame, dict], Column]] = {}


def _number(params: dict) -> Column:
    return missing_as_null(F.col(f"`{params['column']}`").cast("double"))


def _one_column(params: dict) -> list[str]:
    return [params["column"]] if params.get("column") else []


def _formula(df: DataFrame, params: dict) -> Column:
    typed = typed_formula(params.get("expression", ""), df, max_chars=FORMULA_CHARS)
    return typed.col if typed.kind in ("bool", "str", "other") else typed.col.cast("double")


def _log(df: DataFrame, params: dict) -> Column:
    x = _number(params)
    return F.when(x > 0, F.ln(x))


def _sqrt(df: DataFrame, params: dict) -> Column:
    x = _number(params)
    return F.when(x >= 0, F.sqrt(x))


def _exp(df: DataFrame, params: dict) -> Column:
    x = _number(params)
    return F.when(x.isNotNull(), F.exp(F.greatest(F.lit(-EXP_LIMIT), F.least(F.lit(EXP_LIMIT), x))))


def _span(df: DataFrame, params: dict) -> Column:
    """Least and greatest value of the column, as a scalar subquery."""
    x = _number(params)
    return df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s")).scalar()


def _bins(params: dict) -> int:
    return int(params.get("bins", 5))


def _edge(params: dict, k: Column) -> Column:
    """Edge number k of the equal-width intervals."""
    lo, hi = F.col(params["_span"]).getField("lo"), F.col(params["_span"]).getField("hi")
    return lo + k * ((hi - lo) / F.lit(float(_bins(params))))


def _guess(df: DataFrame, params: dict) -> Column:
    """The interval by division: right up to one place."""
    lo, hi = F.col(params["_span"]).getField("lo"), F.col(params["_span"]).getField("hi")
    place = F.ceil(F.try_divide(_number(params) - lo, (hi - lo) / F.lit(float(_bins(params))))) - 1
    return F.greatest(F.lit(0), F.least(F.lit(_bins(params) - 1), place)).cast("int")


def _bin(df: DataFrame, params: dict) -> Column:
    """0-based code of the right-closed equal-width interval, or its label.

    Code = number of interior edges below the value; the guess is settled by comparing the value
    with the edges next to it.
    """
    bins = _bins(params)
    if bins < 1:
        raise ValueError("at least one bin is needed")
    names = [t.strip() for t in params["labels"].split(",")] if params.get("labels") else None
    if names is not None and len(names) != bins:
        raise ValueError(f"{len(names)} labels for {bins} bins")
    x, guess, span = _number(params), F.col(params["_guess"]), F.col(params["_span"])
    down = F.when((guess >= 1) & (x <= _edge(params, guess)), 1).otherwise(0)
    up = F.when((guess < bins - 1) & (x > _edge(params, guess + 1)), 1).otherwise(0)
    code = F.when(span.getField("lo") == span.getField("hi"), (bins - 1) // 2).otherwise(guess - down + up)
    code = F.when(x.isNotNull(), code)
    if names is None:
        return code
    return F.when(code.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), code + 1))


TRANSFORMS: dict[str, Transform] = {
    "formula": Transform(_formula, lambda p: referenced_names(p.get("expression", ""))),
    "log": Transform(_log, _one_column, lambda p: _number(p) <= 0),
    "sqrt": Transform(_sqrt, _one_column, lambda p: _number(p) < 0),
    "exp": Transform(_exp, _one_column, lambda p: _number(p) > EXP_LIMIT),
    "bin": Transform(_bin, _one_column, helpers={"_span": _span, "_guess": _guess}),
}


def register_transform(
    name: str,
    build: Callable[[DataFrame, dict], Column],
    inputs: Callable[[dict], list[str]] = _one_column,
    warn: Callable[[dict], Column] | None = None,
) -> None:
    """Make `build(df, params) -> Column` available as step type `name`."""
    TRANSFORMS[name] = Transform(build, inputs, warn)


class StepConflict(ValueError):
    """A change of the recipe would leave steps without their input."""

    def __init__(self, message: str, step_ids: list[str], columns: list[str]):
        super().__init__(message)
        self.step_ids, self.columns = step_ids, columns


def _transform(step: dict) -> Transform:
    if not step.get("type") or not step.get("output_column"):
        raise ValueError("a step needs 'type' and 'output_column'")
    if step["type"] not in TRANSFORMS:
        raise ValueError(f"unknown transform type: {step['type']}")
    return TRANSFORMS[step["type"]]


def step_inputs(step: dict) -> list[str]:
    return _transform(step).inputs(step.get("params", {}))


def ordered(steps: list[dict]) -> list[dict]:
    """Steps by order, then creation time, then id."""
    return sorted(steps, key=lambda s: (int(s.get("order", 0)), s.get("created_at", ""), s.get("step_id", "")))


def apply_recipe(df: DataFrame, steps: list[dict]) -> DataFrame:
    """The table with all steps applied; lazy.

    Steps that do not read each other's output share one projection.
    """
    return _apply(df, steps)[0]


def _apply(df: DataFrame, steps: list[dict], flags: bool = False) -> tuple[DataFrame, list[tuple[str, dict]]]:
    pending: dict[str, Column] = {}
    marks: list[tuple[str, dict]] = []
    helpers: list[str] = []
    for i, step in enumerate(ordered(steps)):
        transform, out, params = _transform(step), step["output_column"], step.get("params", {})
        needed = transform.inputs(params)
        if pending and (out in pending or set(needed) & set(pending)):
            df, pending = df.withColumns(pending), {}
        missing = sorted(c for c in needed if c not in df.columns)
        if missing:
            raise StepConflict(
                f"step '{step.get('step_id', out)}' needs missing columns: {', '.join(missing)}", [step.get("step_id", out)], missing
            )
        for name, helper in transform.helpers.items():
            column = f"{name}_{i}"
            df = df.withColumn(column, helper(df, params))
            params = {**params, name: column}
            helpers.append(column)
        pending[out] = transform.build(df, params)
        if flags and transform.warn is not None:
            name = f"_warn_{i}"
            pending[name] = transform.warn(params)
            marks.append((name, step))
    if pending:
        df = df.withColumns(pending)
    return (df.drop(*helpers) if helpers else df), marks


def add_step(df: DataFrame, steps: list[dict], step: dict, allow_overwrite: bool = False) -> list[dict]:
    """The recipe with `step` at the end, checked against the columns it will see."""
    current = apply_recipe(df, steps)
    if step.get("output_column") in current.columns and not allow_overwrite:
        raise ValueError(f"column '{step['output_column']}' already exists; allow_overwrite=True replaces it")
    for col in step_inputs(step):
        if col not in current.columns:
            raise ValueError(f"required column '{col}' not found")
    last = max([int(s.get("order", 0)) for s in steps], default=0)
    grown = [*steps, {**step, "order": last + 1}]
    apply_recipe(df, grown)  # analysis only: reports a bad expression now
    return grown


def recipe_warnings(df: DataFrame, steps: list[dict]) -> DataFrame:
    """(step_id, output_column, warnings) for the steps that can warn; one scan for all."""
    flagged, marks = _apply(df, steps, flags=True)
    schema = "step_id string, output_column string, warnings long"
    if not marks:
        return df.sparkSession.createDataFrame([], schema)
    one = flagged.agg(*[F.count_if(F.col(name)).alias(name) for name, _ in marks])
    rows = [
        F.struct(
            F.lit(s.get("step_id")).alias("step_id"), F.lit(s["output_column"]).alias("output_column"), F.col(n).alias("warnings")
        )
        for n, s in marks
    ]
    return to_rows(one, rows)


def recipe_schema(df: DataFrame, steps: list[dict]):
    """Schema after all steps; no job."""
    return apply_recipe(df, steps).schema


def lineage(spark: SparkSession, steps: list[dict]) -> DataFrame:
    """(output_col, inputs, step_id, transform_name), one row per step."""
    rows = [(s["output_column"], step_inputs(s), s.get("step_id"), s["type"]) for s in ordered(steps)]
    return spark.createDataFrame(rows, "output_col string, inputs array<string>, step_id string, transform_name string")


def dependents(steps: list[dict], step_id: str) -> list[str]:
    """Ids of the steps that read, directly or through others, what `step_id` produces."""
    affected: set[str] = set()
    producer: dict[str, str] = {}
    for step in ordered(steps):
        sources = {producer[c] for c in step_inputs(step) if c in producer}
        if sources & (affected | {step_id}):
            affected.add(step["step_id"])
        producer[step["output_column"]] = step["step_id"]
    return sorted(affected)


def without_step(steps: list[dict], step_id: str, cascade: bool = False) -> list[dict]:
    """The recipe without a step; its dependents go too with `cascade`, else they are a conflict."""
    if step_id not in {s["step_id"] for s in steps}:
        raise ValueError(f"step '{step_id}' not found")
    affected = dependents(steps, step_id)
    if affected and not cascade:
        columns = sorted({s["output_column"] for s in steps if s["step_id"] in affected})
        raise StepConflict("other steps depend on this one", affected, columns)
    gone = {step_id, *affected}
    return [s for s in ordered(steps) if s["step_id"] not in gone]


def delete_step(df: DataFrame, steps: list[dict], step_id: str, cascade: bool = False) -> DataFrame:
    return apply_recipe(df, without_step(steps, step_id, cascade))


def reordered(steps: list[dict], step_ids: list[str]) -> list[dict]:
    """The recipe in the given order, which must name every step once."""
    by_id = {s["step_id"]: s for s in steps}
    if len(step_ids) != len(steps) or set(step_ids) != set(by_id):
        raise ValueError("the new order must be a permutation of the current step ids")
    return [{**by_id[i], "order": n} for n, i in enumerate(step_ids, start=1)]


def reorder_steps(df: DataFrame, steps: list[dict], step_ids: list[str]) -> DataFrame:
    return apply_recipe(df, reordered(steps, step_ids))


def materialize(
    df: DataFrame, steps: list[dict], columns: list[str] | None = None, n: int | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """Recipe result, cut to some columns and rows; unused steps and columns are pruned."""
    result = apply_recipe(df, steps)
    if columns:
        require_columns(result, columns)
    if n is not None:
        result = preview(result, n, order_by)
    return select_columns(result, columns) if columns else result
