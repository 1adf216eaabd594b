"""Random and derived columns on any DataFrame, and whole generated tables."""

from __future__ import annotations

from graphlib import TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulane.functions.distributions import DISTRIBUTIONS, Draws
from tabulane.functions.formula import kind_of, referenced_names, typed_formula
from tabulane.functions.scalars import as_key
from tabulane.operators.lookup import map_column
from tabulane.operators.postprocess import post_column
from tabulane.operators.profile import profile
from tabulane.operators.projection import preview
from tabulane.operators.skew import dimension_join
from tabulane.session import cut_lineage
from tabulane.sources.tables import rows

LISTS = ("categories", "probs")  # parameters taken as they are


def _param(df: DataFrame, value: Any, context: dict) -> tuple[Column, float | None]:
    """(Column, number if literal) for a number, Column, formula text, lookup or mapping."""
    if isinstance(value, Column):
        return value.cast("double"), None
    if isinstance(value, (int, float)):
        return F.lit(float(value)), float(value)
    if isinstance(value, str):
        return typed_formula(value, df, context, max_nodes=None).number().cast("double"), None
    if isinstance(value, dict) and "key" in value and ("lookup" in value or "mapping" in value):
        if value["key"] not in df.columns:
            raise ValueError(f"unknown key column '{value['key']}'")
        if "lookup" in value and not isinstance(context.get(value["lookup"]), dict):
            raise ValueError(f"no lookup table '{value['lookup']}' in the context")
        table = value["mapping"] if "mapping" in value else context[value["lookup"]]
        key = as_key(F.col(value["key"]), kind_of(df.schema[value["key"]].dataType) == "bool")
        return map_column(key, table, value.get("default", 0)).cast("double"), None
    raise ValueError(f"not usable as a parameter: {value!r}")


def _reads_columns(df: DataFrame, value: Any) -> bool:
    if isinstance(value, Column):
        return True
    if isinstance(value, dict):
        return True
    return isinstance(value, str) and any(n in df.columns for n in referenced_names(value))


def with_random(
    df: DataFrame,
    name: str,
    dist: str,
    params: dict[str, Any],
    seed: int = 0,
    key: str = "row_id",
    scope: str = "row",
    group_by: str | None = None,
    context: dict | None = None,
    hashing: str = "md5",
) -> DataFrame:
    """Add a random column that depends only on (seed, name, key) and the hash chosen by `hashing`.

    scope "row": a value per row; "global": one value, parameters from the first row; "group": one
    value per category of `group_by`, parameters from the first row of the category.
    """
    base, draws, value = _draw(df, name, dist, params, seed, key, scope, group_by, context or {}, hashing)
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return base.withColumns(draws.hashes).withColumns(draws.draws).select(*kept, value.alias(name))


def _draw(
    df: DataFrame,
    name: str,
    dist: str,
    params: dict[str, Any],
    seed: int,
    key: str,
    scope: str,
    group_by: str | None,
    context: dict,
    hashing: str,
) -> tuple[DataFrame, Draws, Column]:
    """(table the value is built on, helper columns it reads, value)."""
    if dist not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution '{dist}'")
    spec = DISTRIBUTIONS[dist]
    given = {**spec.defaults, **params}
    missing = [p for p in spec.required if p not in given]
    if missing:
        raise ValueError(f"{dist} needs parameters: {', '.join(missing)}")
    lists = {k: v for k, v in given.items() if k in LISTS}
    values = {k: v for k, v in given.items() if k not in LISTS}
    varying = [k for k, v in values.items() if _reads_columns(df, v)]
    resolved = {k: _param(df, v, context) for k, v in values.items()}
    base = df
    if scope == "row":
        draw_key, cols = F.col(key), {k: c for k, (c, _) in resolved.items()}
    elif scope == "global":
        draw_key, cols = F.lit("global"), {k: c for k, (c, _) in resolved.items()}
        if varying:
            first = df.agg(F.min_by(F.struct(*[cols[k].alias(k) for k in varying]), F.col(key)).alias("p")).scalar()
            cols.update({k: first.getField(k) for k in varying})
    elif scope == "group":
        if not group_by or group_by not in df.columns:
            raise ValueError(f"group-by column '{group_by}' not found")
        draw_key, cols = F.col(group_by), {k: c for k, (c, _) in resolved.items()}
        if varying:
            helper = f"_params_{name}"
            first = F.min_by(F.struct(*[cols[k].alias(k) for k in varying]), F.col(key)).alias(helper)
            base = dimension_join(df, cut_lineage(df.groupBy(group_by).agg(first)), [group_by], "left", salt_by=[key])
            cols.update({k: F.col(f"`{helper}`").getField(k) for k in varying})
    else:
        raise ValueError(f"unknown scope '{scope}'")
    literals = {k: number for k, (_, number) in resolved.items() if number is not None}
    if spec.check is not None and set(literals) == set(cols) and not spec.check(literals):
        raise ValueError(f"{dist}: {spec.rule}")
    draws = Draws(seed, name, draw_key, hashing)
    value = spec.build(draws, {**cols, **lists, "_literals": literals})
    if spec.check is not None and set(literals) != set(cols):
        ok = spec.check(cols)
        value = F.when(ok, value).when(~ok, F.raise_error(F.lit(f"{dist}: {spec.rule}")))
    return base, draws, value


def post_settings(spec: dict) -> dict:
    """Post-processing of a column specification."""
    return {k: v for k, v in (spec.get("post") or {}).items() if v is not None}


def _needs(spec: dict, names: set[str], context: dict) -> set[str]:
    """Other columns of the table that a specification reads."""
    texts = [spec["formula"]] if "formula" in spec else [v for k, v in spec.get("params", {}).items() if isinstance(v, str) and k not in LISTS]
    found = {n for t in texts for n in referenced_names(t, spec.get("aliases"))}
    found |= {v["key"] for v in spec.get("params", {}).values() if isinstance(v, dict) and "key" in v}
    if spec.get("group_by"):
        found.add(spec["group_by"])
    return (found & names) - {spec["name"]}


def in_order(specs: list[dict], context: dict | None = None) -> list[dict]:
    """Specifications with every column after the ones it reads; ties by name."""
    by_name = {s["name"]: s for s in specs}
    if len(by_name) != len(specs):
        raise ValueError("column names must be unique")
    sorter = TopologicalSorter({n: _needs(s, set(by_name), context or {}) for n, s in by_name.items()})
    sorter.prepare()
    result = []
    ready = sorted(sorter.get_ready())
    while ready:
        name = ready.pop(0)
        result.append(by_name[name])
        sorter.done(name)
        ready = sorted([*ready, *sorter.get_ready()])
    return result


def add_columns(
    df: DataFrame, specs: list[dict], context: dict | None = None, seed: int = 0, key: str = "row_id", hashing: str = "md5"
) -> DataFrame:
    """Add the specified columns to `df`, whose column `key` identifies a row.

    A specification is {"name", "dist", "params", "scope"?, "group_by"?, "post"?, "dtype"?} or
    {"name", "formula", "strict"?, "post"?, "dtype"?}; a strict formula fails on a division by zero and the
    like. The result is one lazy plan.
    """
    context = context or {}
    for layer in _layers(in_order(specs, context), context):
        df = _add_layer(df, layer, context, seed, key, hashing)
    return df


def _layers(specs: list[dict], context: dict) -> list[list[dict]]:
    """Runs of specifications that do not read each other: each run shares its projections."""
    names = {s["name"] for s in specs}
    layers: list[list[dict]] = []
    for spec in specs:
        if not layers or _needs(spec, names, context) & {s["name"] for s in layers[-1]}:
            layers.append([])
        layers[-1].append(spec)
    return layers


def _add_layer(df: DataFrame, layer: list[dict], context: dict, seed: int, key: str, hashing: str) -> DataFrame:
    base, values = df, {}
    hashes: dict[str, Column] = {}
    draws: dict[str, Column] = {}
    for spec in layer:
        name = spec["name"]
        if "formula" in spec:
            typed = typed_formula(spec["formula"], df, context, spec.get("aliases"), spec.get("strict", False), max_nodes=None)
            values[name] = typed.col.cast("double") if typed.kind == "int" else typed.col
            continue
        settings = (seed, key, spec.get("scope", "row"), spec.get("group_by"), context, hashing)
        base, drawn, values[name] = _draw(base, name, spec["dist"], spec.get("params", {}), *settings)
        hashes.update(drawn.hashes)
        draws.update(drawn.draws)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in values]
    df = base.withColumns(hashes).withColumns(draws) if draws else base
    df = df.select(*kept, *[v.alias(n) for n, v in values.items()])
    finished = {}
    for spec in layer:
        settings = post_settings(spec)
        if settings or spec.get("dtype"):
            finished[spec["name"]] = post_column(df, spec["name"], dtype=spec.get("dtype"), seed=seed, key=key, hashing=hashing, **settings)
    return df.withColumns(finished) if finished else df


def preview_with_profile(df: DataFrame, n: int = 200, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """The first n rows of a generated table and the statistics of the whole of it."""
    shown = [c for c in df.columns if c != key]
    return preview(df, n, [key]).select(*shown), profile(df.select(*shown))


def generate(
    spark: SparkSession,
    n: int,
    specs: list[dict],
    context: dict | None = None,
    seed: int = 0,
    keep_id: bool = False,
    hashing: str = "md5",
) -> DataFrame:
    """A table of n rows with the specified columns, in dependency order."""
    table = add_columns(rows(spark, n), specs, context, seed, hashing=hashing)
    return table if keep_id else table.drop("row_id")
