"""Deriving, profiling, checking, generating and modelling tables on Spark."""

from tabulane.functions.distributions import register_distribution
from tabulane.functions.formula import formula, referenced_names
from tabulane.operators.kpi import kpi_gate, kpi_snapshot
from tabulane.operators.lookup import exists_match, first_per_group, group_value, join_chain, lookup, map_values
from tabulane.operators.modeling import fit, predict, register_model
from tabulane.operators.percentiles import exact_percentiles
from tabulane.operators.postprocess import post_process
from tabulane.operators.profile import (
    correlation,
    correlation_matrix,
    detect_types,
    group_stats,
    histogram,
    profile,
    profile_categories,
    profile_nulls,
    profile_numeric,
    regression_metrics,
    residual_stats,
    residuals,
    scatter_summary,
)
from tabulane.operators.projection import (
    complete_cases,
    completeness,
    count_rows,
    derive,
    distinct_values,
    latest_per_key,
    page,
    preview,
    select_columns,
    sort_table,
    split,
    thin,
    trailing_window,
    valid_flag,
)
from tabulane.operators.quality import check, constraint_report, quarantine
from tabulane.plans.generate import add_columns, generate, preview_with_profile, with_random
from tabulane.plans.recipes import (
    add_step,
    apply_recipe,
    delete_step,
    lineage,
    materialize,
    recipe_schema,
    recipe_warnings,
    register_transform,
    reorder_steps,
)
from tabulane.session import build_session
from tabulane.sources.events import append_events
from tabulane.sources.tables import (
    file_fingerprint,
    infer_schema,
    load_source,
    read_table,
    rows,
    table_checksum,
    write_table,
)
from tabulane.streaming.events import ingest_stream, kpi_stream

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("functions", "operators", "plans", "sources", "streaming", "session")]
