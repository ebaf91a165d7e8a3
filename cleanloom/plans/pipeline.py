"""Saved step lists: ``[{"op": name, "params": {...}}, ...]`` folded over a DataFrame.

Most steps only add to the plan: Catalyst sees the whole chain, so filters and column choices of late steps reach the scan. Steps
by row order count and sample their input when they are added, once for each order, and neighbouring running columns of one order
are one scan; before a second scan the frame is checkpointed.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import scan
from ..functions.core import OpError, as_list, per_column, q
from ..operators import calculate, columns, dates, format, groups, quality, rows, tables, text
from ..sources import files

_MODULES = (rows, columns, calculate, text, format, dates, groups, tables, quality)

# names of the operators, and the older step names that map on them
_NAMES = """
sort_rows filter_rows limit_rows remove_duplicates merge_duplicates fill_blanks add_rows sample_rows offset_rows head_rows
tail_rows shuffle_rows row_number explode_column select_columns remove_columns rename_columns reorder_columns add_column
split_column merge_columns copy_column change_column_type coalesce replace_null concat_columns generate_uuid fill_forward
fill_backward math_operation round_numbers percentage running_total rank conditional_value floor_ceil bin_values
absolute_value is_between case_when dense_rank ntile lag lead moving_average percent_rank first_value find_replace
extract_text text_length pad_text remove_characters string_contains substring regex_replace regex_extract format_date
format_phone change_text_casing trim_whitespace standardize_values extract_date_part date_diff date_add aggregate pivot
unpivot join_tables union_tables lookup detect_nulls validate_pattern is_duplicate detect_enum_drift normalize_boolean
normalize_enum_values drop_rows slice_rows fill_nulls interpolate explode convert_type add_expression sanitize_headers
standardize extract_pattern parse_date normalize handle_outliers percent_of_total bin_numeric date_diff_columns
extract_date_parts date_to_epoch substring_columns clean_text remove_html conditional_replace lag_lead transpose
validate_format format_phone_columns mask_data group_by cumulative join rank_values trim_columns change_case replace_values
convert_inferred
""".split()

ALIASES = {
    "deduplicate": "remove_duplicates", "drop_columns": "remove_columns", "rename_column": "rename_columns",
    "melt": "unpivot", "pad_string": "pad_text", "abs_value": "absolute_value", "floor_ceiling": "floor_ceil",
    "flag_duplicates": "is_duplicate", "bin": "bin_values", "limit": "limit_rows", "sample": "sample_rows",
    "split": "split_column", "merge": "merge_columns",
}

_OPS: dict[str, Callable[..., DataFrame]] = {}


def register_op(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add an operator: any function ``fn(df, **params) -> DataFrame``."""
    _OPS[name] = fn


for _m in _MODULES:
    for _n in _NAMES:
        if hasattr(_m, _n) and getattr(_m, _n).__module__ == _m.__name__:
            register_op(_n, getattr(_m, _n))


def custom(df: DataFrame, query: str) -> DataFrame:
    """Free user SQL over the frame, named ``{df}`` in the text."""
    return df.sparkSession.sql(query, df=df)


register_op("custom", custom)


# parameters that change only the findings of a step, not its frame
_FINDINGS = ("threshold", "add_drift_flag", "sample_size", "include_top_values", "top_n")

# steps that only look: the frame passes unchanged, their findings come from ``metrics``
_METRICS: dict[str, Callable[..., DataFrame]] = {
    "detect_nulls": quality.null_metrics, "profile_column": quality.profile_column, "validate_pattern": quality.pattern_metrics,
    "validate_schema": quality.validate_schema, "compare_schemas": quality.compare_schemas, "infer_types": quality.infer_types,
    "detect_renamed_columns": quality.detect_renamed_columns, "detect_enum_drift": quality.enum_metrics,
    "detect_format_drift": quality.format_metrics, "detect_distribution_drift": quality.distribution_drift,
    "normalize_boolean": quality.boolean_metrics, "generate_drift_report": quality.generate_drift_report,
}


def _observer(name: str) -> Callable[..., DataFrame]:
    def look(df: DataFrame, **params) -> DataFrame:
        return quality.convert_inferred(df, params.get("columns")) if name == "infer_types" and params.get("apply_conversion") else df

    return look


def detect_enum_drift(df: DataFrame, column: str, expected_values: Sequence, case_sensitive: bool = False, add_drift_flag: bool = False) -> DataFrame:
    """As a step it only looks, unless the flag column is asked for."""
    return quality.detect_enum_drift(df, column, expected_values, case_sensitive) if add_drift_flag else df


register_op("detect_enum_drift", detect_enum_drift)


for _n in _METRICS:
    if _n not in _OPS:
        register_op(_n, _observer(_n))
register_op("detect_header", files.apply_detected_header)


def metrics(df: DataFrame, step: Mapping) -> DataFrame:
    """The findings of a looking step as a small frame; parameters it has no use for are left out."""
    fn = _METRICS.get(ALIASES.get(step["op"], step["op"]))
    if fn is None:
        raise OpError(f"{step['op']!r} has no metrics")
    known = inspect.signature(fn).parameters
    return fn(df, **{k: v for k, v in (step.get("params") or {}).items() if k in known})


def effect(df: DataFrame, step: Mapping, tables: Mapping[str, DataFrame] | None = None, order_by=None) -> DataFrame:
    """What a step would do to its columns, in one pass: rows (column, rows_after, changed, new_nulls).

    A copy of each target column rides along through the step, so this is for steps that keep
    their rows and other columns (text, format, date, number and null steps).
    """
    params = step.get("params") or {}
    names = [c for p in ("column", "columns", "target_columns") for c in as_list(params.get(p)) if c in df.columns]
    fn = get_op(step["op"])
    old = {c: f"__old_{i}" for i, c in enumerate(names)}
    out = fn(df.withColumns({o: F.col(q(c)) for c, o in old.items()}), **_bind(df, params, tables or {}, fn, order_by))
    names = [c for c in names if c in out.columns and old[c] in out.columns]
    if not names:
        raise OpError("the step keeps none of its target columns")
    same = lambda c: F.col(old[c]).cast("string").eqNullSafe(F.col(q(c)).cast("string"))
    return per_column(out, {c: {"rows_after": F.count(F.lit(1)), "changed": F.count_if(~same(c)),
                                "new_nulls": F.count_if(F.col(old[c]).isNotNull() & F.col(q(c)).isNull())} for c in names})


# older step type -> (operator, parameter that takes the target columns, renamed parameters)
_OLDER: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "filter_rows": ("filter_rows", None, {}), "drop_rows": ("drop_rows", "target_columns", {}), "sort_rows": ("sort_rows", "columns", {}),
    "select_columns": ("select_columns", "columns", {}), "drop_columns": ("remove_columns", "columns", {}), "slice_rows": ("slice_rows", None, {}),
    "sample_rows": ("sample_rows", None, {"frac": "fraction", "random_state": "seed"}), "trim_whitespace": ("trim_columns", "target_columns", {}),
    "deduplicate": ("remove_duplicates", "subset", {}), "replace_values": ("replace_values", "target_columns", {"find": "old_value", "replace": "new_value"}),
    "fill_nulls": ("fill_nulls", "target_columns", {"fill_value": "value"}), "format_date": ("format_date", "column", {}),
    "add_column": ("add_expression", None, {"new_name": "name"}), "round_numbers": ("round_numbers", "column", {}), "abs_value": ("absolute_value", "column", {}),
    "floor_ceiling": ("floor_ceil", "column", {"operation": "method"}), "date_diff": ("date_diff_columns", "target_columns", {}), "date_add": ("date_add", "column", {}),
    "extract_date_part": ("extract_date_parts", "target_columns", {}), "substring": ("substring_columns", "target_columns", {}),
    "pad_string": ("pad_text", "column", {"width": "length", "fillchar": "pad_char"}), "coalesce": ("coalesce", "columns", {}),
    "split_column": ("split_column", "column", {}), "merge_columns": ("merge_columns", "columns", {"new_column_name": "new_column"}),
    "pivot": ("pivot", None, {}), "melt": ("unpivot", None, {"id_vars": "id_columns", "value_vars": "value_columns"}), "transpose": ("transpose", None, {}),
    "reorder_columns": ("reorder_columns", None, {}), "rename_column": ("rename_columns", None, {"rename_map": "mapping"}),
    "format_phone": ("format_phone_columns", "target_columns", {}), "flag_duplicates": ("is_duplicate", "subset", {"column_name": "new_column"}),
    "join": ("join", None, {}), "custom": ("custom", None, {"code": "query"}), "sanitize_headers": ("sanitize_headers", None, {}),
    "conditional_replace": ("conditional_replace", None, {}),
}
# defaults of the older steps that differ (fixed values)
_OLDER_DEFAULTS = {"pivot": {"aggfunc": "first", "fill_value": None}, "merge_columns": {"keep_original": True}, "flag_duplicates": {"new_column": "is_duplicate"},
                   "add_column": {"name": "new_column"}, "rename_column": {"strict": False}, "select_columns": {"strict": False},
                   "drop_columns": {"strict": False}, "pad_string": {"length": 10}, "split_column": {"keep_original": True}}


def older_step(plan: Mapping) -> dict:
    """An older plan (type, target_columns, conditions, parameters) as a step."""
    kind = plan.get("type", "")
    op, target, renamed = _OLDER.get(kind, (kind, "target_columns", {}))
    params = {**_OLDER_DEFAULTS.get(kind, {}), **{renamed.get(k, k): v for k, v in (plan.get("parameters") or {}).items()}}
    columns = plan.get("target_columns")
    if kind == "rename_column" and "new_name" in params:
        params["mapping"] = {columns[0]: params.pop("new_name")}
    elif kind == "reorder_columns":
        params["strict"] = not params.pop("keep_unlisted", False)
    elif target and columns and target not in params:
        params[target] = columns[0] if kind == "split_column" else columns
    if kind == "split_column" and params.get("expand") is False:
        params.setdefault("array_column", f"{params['column']}_split")
    if plan.get("conditions") and op in ("filter_rows", "drop_rows"):
        params["conditions"] = plan["conditions"]
    return {"op": op, "params": params}


def get_op(name: str) -> Callable[..., DataFrame]:
    name = ALIASES.get(name, name)
    if name not in _OPS:
        raise OpError(f"unknown operator {name!r}")
    return _OPS[name]


def list_ops() -> list[str]:
    return sorted(_OPS)


# parameters that hold other tables
_TABLE_PARAMS = ("right_table", "right_data", "lookup_table", "other_tables")


def _bind(df: DataFrame, params: Mapping, tables: Mapping[str, DataFrame], fn: Callable, order_by) -> dict:
    out = dict(_accepted(fn, params))
    for p in _TABLE_PARAMS:
        if p in out:
            one = lambda t: t if isinstance(t, DataFrame) else tables[t] if t in tables else df.sparkSession.table(t)
            out[p] = [one(t) for t in out[p]] if isinstance(out[p], (list, tuple)) else one(out[p])
    if order_by and "order_by" in inspect.signature(fn).parameters and "order_by" not in out:
        keys = [k for k in order_by if (k if isinstance(k, str) else k[0]).lstrip("-") in df.columns]
        if keys:
            out["order_by"] = keys
    return out


# operators that take an order and still read their input once: one sort, or one aggregate
_READ_ONCE = {"sort_rows", "limit_rows", "head_rows", "tail_rows", "slice_rows", "remove_duplicates", "merge_duplicates", "aggregate", "group_by", "pivot", "add_rows"}


def reads_often(name: str, fn: Callable) -> bool:
    """Operators cut into chunks by row order read their input several times (see ``scan``)."""
    return "order_by" in inspect.signature(fn).parameters and ALIASES.get(name, name) not in _READ_ONCE


def check_params(step: Mapping) -> list[str]:
    """Problems of one step that can be seen without data."""
    try:
        fn = get_op(step.get("op", ""))
    except OpError as e:
        return [str(e)]
    signature = inspect.signature(fn)
    if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in signature.parameters.values()):
        return []
    names = list(signature.parameters)[1:]
    given = step.get("params") or {}
    bad = [f"unknown parameter {p!r}" for p in given if p not in names and p not in _FINDINGS]
    needed = [n for n in names if signature.parameters[n].default is inspect.Parameter.empty and n != "order_by"]
    return bad + [f"missing parameter {n!r}" for n in needed if n not in given]


def validate(steps: Sequence[Mapping]) -> list[str]:
    return [f"step {i + 1} ({s.get('op')}): {p}" for i, s in enumerate(steps) for p in check_params(s)]


@dataclass
class StepReport:
    op: str
    success: bool
    error: str | None = None
    columns: list[str] = field(default_factory=list)
    ms: float = 0.0  # to add the step to the plan, with the jobs it ran for that


@dataclass
class PlanResult:
    df: DataFrame
    success: bool
    steps: list[StepReport]
    counts: DataFrame | None = None
    observed: list[tuple[int, StepReport, Observation]] = field(default_factory=list)

    def record(self) -> list[dict]:
        """What each step was: step, op, rows, columns, ms. Only after an action on ``df``, whose jobs have counted the rows; an action
        that stops early, like a limit, counts what it has read."""
        return [{"step": i, "op": r.op, "rows": seen.get["rows"], "columns": len(r.columns), "ms": r.ms} for i, r, seen in self.observed]


def _accepted(fn: Callable, params: Mapping) -> Mapping:
    """Parameters of a looking operator that only its metrics read are dropped for the transform."""
    names = inspect.signature(fn).parameters
    if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in names.values()):
        return params
    return {k: v for k, v in params.items() if k in names or k not in _FINDINGS}


# modules whose operators keep the rows as they are, and with them the balance of a cut
_KEEP_ROWS = (columns, calculate, text, format, dates)
# operators with running columns, and the parameters that name new columns
_RUNNING = ("running_total", "cumulative", "row_number")
_NEW = ("new_column", "name", "new_columns")


def _running_columns(step: Mapping, df: DataFrame, order_by) -> tuple[tuple, list] | None:
    """(group and order, running columns) of a step that has some, or None."""
    if step.get("op") not in _RUNNING or check_params(step):
        return None
    p = _bind(df, step.get("params") or {}, {}, get_op(step["op"]), order_by)
    if not p.get("order_by") or p.get("start", 1) != 1:
        return None
    part = tuple(as_list(p.get("partition_by") or p.get("group_by")))
    if step["op"] == "running_total":
        new = [(p["column"], p["new_column"], "sum")]
    elif step["op"] == "row_number":
        new = [(None, p.get("new_column", "row_num"), "count")]
    else:
        kind = p.get("operation", "sum")
        suffix = p["suffix"] if p.get("suffix") is not None else f"_cum{kind}"
        new = [(c, f"{c}{suffix}", kind) for c in as_list(p["target_columns"]) if c in df.columns]
    return (part, tuple(scan.keys_of(p["order_by"]))), new


def _together(steps: Sequence[Mapping], df: DataFrame, order_by) -> tuple[int, list, tuple] | None:
    """How many of the first steps are running columns of one order that do not build on one another, with those columns."""
    first = _running_columns(steps[0], df, order_by)
    if first is None or first[1] and any(c is not None and c not in df.columns for c, *_ in first[1]):
        return None
    how, found, n = first[0], list(first[1]), 1
    for step in steps[1:]:
        more = _running_columns(step, df, order_by)
        new = {name for _, name, _ in found}
        if more is None or more[0] != how or any(c is not None and c not in df.columns for c, *_ in more[1]) or new & {x for c, name, _ in more[1] for x in (c, name)}:
            break
        found, n = found + more[1], n + 1
    names = [name for _, name, _ in found]
    if n < 2 or set(names) & set(df.columns) or len(set(names)) < len(names) or any(c not in df.columns for c in [*how[0], *(k.name for k in how[1])]):
        return None
    return n, found, how


def _keeps_balance(step: Mapping, fn: Callable, often: bool) -> None:
    """Forget the cuts that a step may have put out of balance: all if it may change the rows, else those by a column it writes."""
    if fn.__module__ not in {m.__name__ for m in _KEEP_ROWS} and not often:
        scan.forget_cuts()
        return
    params = step.get("params") or {}
    names = {x for p, v in params.items() if p in _NEW or not often for x in (v.values() if isinstance(v, Mapping) else as_list(v) if isinstance(v, (str, list, tuple)) else ()) if isinstance(x, str)}
    scan.forget_cuts(names)


def run_plan(df: DataFrame, steps: Sequence[Mapping], tables: Mapping[str, DataFrame] | None = None, stop_on_error: bool = True,
             order_by=None, count_rows: bool = False, observe: bool = False) -> PlanResult:
    """Apply the steps in order. Steps that are cut into chunks by row order count and sample their input while the plan is
    built, once for each order (``scan.one_cut``), and neighbouring running columns of one order are taken in one scan; from the
    second scan on the frame is checkpointed first. All other steps are lazy. On a failed step the original frame comes back
    (``stop_on_error``) or the step is skipped. ``count_rows`` adds a lazy frame
    (step, rows) with the row count after every step; ``observe`` counts the rows of each step within the jobs that run anyway
    (``PlanResult.record``)."""
    with scan.one_cut():
        return _run(df, list(steps), tables or {}, stop_on_error, order_by, count_rows, observe)


def _run(df: DataFrame, steps: list[Mapping], tables: Mapping[str, DataFrame], stop_on_error: bool, order_by, count_rows: bool, observe: bool) -> PlanResult:
    original, reports, counts, observed, scans, i = df, [], [], [], 0, 0
    while i < len(steps):
        step, began, taken = steps[i], time.perf_counter(), 1
        try:
            problems = check_params(step)
            if problems:
                raise OpError("; ".join(problems))
            fn = get_op(step["op"])
            often = reads_often(step["op"], fn)
            if scans and often:
                df = scan.settle(df)  # an ordered step on top of another would repeat it
            scans += often
            group = _together(steps[i:], df, order_by)
            if group:
                taken, new, (part, keys) = group
                before = list(df.columns)
                df = calculate.running_columns(df, new, list(part), list(keys))
                mine = [_running_columns(s, df.select(*[q(c) for c in before]), order_by)[1] for s in steps[i: i + taken]]
            else:
                df = fn(df, **_bind(df, step.get("params") or {}, tables, fn, order_by))
                before, mine = list(df.columns), [[]]
            for s, names in zip(steps[i: i + taken], mine):
                before = before + [name for _, name, _ in names]
                reports.append(StepReport(s["op"], True, columns=list(before)))
                _keeps_balance(s, get_op(s["op"]), reads_often(s["op"], get_op(s["op"])))
        except (OpError, AnalysisException, KeyError, TypeError, ValueError) as e:
            reports.append(StepReport(step.get("op", ""), False, str(e)))
            if stop_on_error:
                return PlanResult(original, False, reports)
            i += 1
            continue
        if observe:
            seen = Observation()
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        for n, s in enumerate(steps[i: i + taken]):
            reports[n - taken].ms = round((time.perf_counter() - began) * 1000 / taken, 1)
            if count_rows:
                counts.append(df.agg(F.lit(i + n + 1).alias("step"), F.lit(s.get("op")).alias("op"), F.count(F.lit(1)).alias("rows")))
            if observe:
                observed.append((i + n + 1, reports[n - taken], seen))
        i += taken
    total = None
    for c in counts:
        total = c if total is None else total.unionByName(c)
    return PlanResult(df, True, reports, total, observed)


def dry_run(df: DataFrame, steps: Sequence[Mapping], tables: Mapping[str, DataFrame] | None = None, order_by=None) -> list[dict]:
    """Per step: the columns it would leave. The plan is analysed on an empty copy of the table."""
    # limit(0) frames: nothing is read or checkpointed at any size
    shadow = {k: v.limit(0) for k, v in (tables or {}).items()}
    result = run_plan(df.limit(0), steps, shadow, False, order_by)
    return [{"step": i + 1, "op": r.op, "ok": r.success, "error": r.error, "columns": r.columns} for i, r in enumerate(result.steps)]
