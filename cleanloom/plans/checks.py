"""Before/after quality checks and acceptance criteria.

Every check asks for aggregates of the two frames; all aggregates of a side are
computed together in one pass, and the rules are expressions over those two
rows. ``validate`` returns the issues as a frame.

A plan is a dict: ``type``, ``target_columns``, ``conditions``, ``parameters``,
``acceptance_criteria``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scan
from ..functions.core import OpError, as_list, col, is_numeric, need, num, q, rows_frame, text, type_class

ROW_REDUCING = ("drop_rows", "filter_rows", "deduplicate", "slice_rows")
HIGH_LOSS, EXTREME_LOSS = 0.5, 0.8

# expected result of each phone layout (fixed values)
PHONE_PATTERNS = {
    "nnn-nnn-nnnn": r"^\d{3}-\d{3}-\d{4}$",
    "(nnn) nnn-nnnn": r"^\(\d{3}\) \d{3}-\d{4}$",
    "nnn.nnn.nnnn": r"^\d{3}\.\d{3}\.\d{4}$",
    "nnnnnnnnnn": r"^\d{10}$",
    "+1-nnn-nnn-nnnn": r"^\+1-\d{3}-\d{3}-\d{4}$",
}


class Side:
    """One frame and the aggregates the checks asked of it."""

    def __init__(self, df: DataFrame, name: str):
        self.df, self.name = df, name
        self.aggs: dict[str, Column] = {}
        self.extra: dict[str, DataFrame] = {}

    def get(self, key: str, agg: Column) -> Column:
        """The aggregate's place in the side's one row; equal keys share it."""
        self.aggs.setdefault(key, agg)
        return F.col(self.name)[f"m{list(self.aggs).index(key)}"]

    def rows(self) -> Column:
        return self.get("rows", F.count(F.lit(1)))

    def nulls(self, c: str) -> Column:
        return self.get(f"nulls:{c}", F.count_if(col(c).isNull()))

    def scalar(self, name: str, frame: DataFrame) -> Column:
        """A one-row, one-column frame the check needs beside the shared pass."""
        self.extra[name] = frame
        return F.col(f"{self.name}_{name}")

    def duplicates(self, cols: list[str]) -> Column:
        cells = F.struct(*[col(c) for c in cols])
        counted = self.df.groupBy(cells.alias("r")).agg((F.count(F.lit(1)) - 1).alias("n"))
        return self.scalar("dups", counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))

    def row(self) -> DataFrame:
        aggs = [a.alias(f"m{i}") for i, a in enumerate(self.aggs.values())] or [F.count(F.lit(1)).alias("m0")]
        return self.df.agg(F.struct(*aggs).alias(self.name))


def _num(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def _issue(check: str, severity, column: str | None, message: str, before=None, after=None) -> Column:
    """A struct when ``severity`` is not null, else null."""
    s = severity if isinstance(severity, Column) else F.lit(severity)
    return F.when(s.isNotNull(), F.struct(
        F.lit(check).alias("check_name"), s.alias("severity"), F.lit(column).cast("string").alias("column"),
        F.lit(message).alias("message"), _num(before).alias("before"), _num(after).alias("after")))


def _kind(plan: Mapping) -> str:
    return str(plan.get("type", ""))


def _params(plan: Mapping) -> Mapping:
    return plan.get("parameters") or {}


def _targets(plan: Mapping) -> list[str]:
    return as_list(plan.get("target_columns"))


def schema_valid(b: Side, a: Side, plan: Mapping) -> list[Column]:
    gone = (a.rows() == 0) & (b.rows() > 0)
    out = [_issue("schema_valid", F.when(gone, "warning" if _kind(plan) in ROW_REDUCING else "error"), None, "all rows were removed", b.rows(), a.rows())]
    if not a.df.columns:
        out.append(_issue("schema_valid", "error", None, "all columns were removed", len(b.df.columns), 0))
    return out


def target_columns_exist(b: Side, a: Side, plan: Mapping) -> list[Column]:
    kind, have, out = _kind(plan), a.df.columns, []
    if kind == "drop_columns":
        return [_issue("target_columns_exist", "warning", c, "column was not removed") for c in _targets(plan) if c in have]
    if kind in ("rename_column", "add_column"):
        name = _params(plan).get("new_name" if kind == "rename_column" else "name")
        return [_issue("target_columns_exist", "error", name, "new column is missing")] if name and name not in have else []
    if kind not in ("select_columns", "group_by"):
        out = [_issue("target_columns_exist", "error", c, "target column is missing") for c in _targets(plan) if c not in have]
    return out


def column_types_preserved(b: Side, a: Side, plan: Mapping) -> list[Column]:
    out = []
    for c in b.df.columns:
        if c in a.df.columns:
            old, new = type_class(b.df.schema[c].dataType), type_class(a.df.schema[c].dataType)
            if old != new and (old, new) != ("integer", "float"):
                out.append(_issue("column_types_preserved", "info", c, f"type changed from {old} to {new}"))
    return out


def row_count_change(b: Side, a: Side, plan: Mapping) -> list[Column]:
    lost = F.try_divide((b.rows() - a.rows()).cast("double"), b.rows().cast("double"))
    return [_issue("row_count_change", F.when(lost >= EXTREME_LOSS, "warning"), None, "removes most of the data", b.rows(), a.rows()),
            _issue("row_count_change", F.when((lost >= HIGH_LOSS) & (lost < EXTREME_LOSS), "warning"), None, "large data reduction", b.rows(), a.rows())]


def filter_actually_filtered(b: Side, a: Side, plan: Mapping) -> list[Column]:
    return [_issue("filter_actually_filtered", F.when((b.rows() > 0) & (b.rows() == a.rows()), "warning"), None, "filter kept all rows", b.rows(), a.rows())]


def row_count_unchanged(b: Side, a: Side, plan: Mapping) -> list[Column]:
    return [_issue("row_count_unchanged", F.when(b.rows() != a.rows(), "warning"), None, "unexpected row change", b.rows(), a.rows())]


def aggregation_row_count(b: Side, a: Side, plan: Mapping) -> list[Column]:
    same = (b.rows() > 0) & (b.rows() == a.rows())
    one = (b.rows() > 0) & (b.rows() != a.rows()) & (a.rows() == 1)
    return [_issue("aggregation_row_count", F.when(same, "info"), None, "as many groups as rows", b.rows(), a.rows()),
            _issue("aggregation_row_count", F.when(one, "info"), None, "all rows became one", b.rows(), a.rows())]


def slice_bounds(b: Side, a: Side, plan: Mapping) -> list[Column]:
    want = F.least(F.lit(int(_params(plan).get("n", 10))), b.rows())
    return [_issue("slice_bounds", F.when(a.rows() != want, "warning"), None, "wrong number of rows", want, a.rows())]


def fill_nulls_success(b: Side, a: Side, plan: Mapping) -> list[Column]:
    out = []
    for c in _targets(plan):
        if c in b.df.columns and c in a.df.columns:
            nb, na = b.nulls(c), a.nulls(c)
            out.append(_issue("fill_nulls_success", F.when((nb > 0) & (na == nb), "warning"), c, "nulls were not filled", nb, na))
            out.append(_issue("fill_nulls_success", F.when((na > 0) & (na < nb), "info"), c, "some nulls remain", nb, na))
    return out


def new_nulls_introduced(b: Side, a: Side, plan: Mapping) -> list[Column]:
    kind = _kind(plan)
    if kind in ("add_column", "extract_pattern"):
        name = _params(plan).get("name" if kind == "add_column" else "new_column")
        if not name or name not in a.df.columns:
            return []
        n = a.nulls(name)
        many = (n > a.rows() * 0.5) if kind == "extract_pattern" else F.lit(False)
        return [_issue("new_nulls_introduced", F.when(n > 0, F.when(many, "warning").otherwise("info")), name, "new column has nulls", 0, n)]
    out = []
    for c in _targets(plan):
        if c in b.df.columns and c in a.df.columns:
            new = a.nulls(c) - b.nulls(c)
            level = F.when(new > 0, F.when(new > a.rows() * 0.1, "warning").otherwise("info"))
            out.append(_issue("new_nulls_introduced", level, c, "new null values", b.nulls(c), a.nulls(c)))
    return out


def drop_rows_null_check(b: Side, a: Side, plan: Mapping) -> list[Column]:
    cols = [c["column"] for c in plan.get("conditions") or [] if c.get("operator") == "isnull"]
    return [_issue("drop_rows_null_check", F.when(a.nulls(c) > 0, "warning"), c, "null rows remain", None, a.nulls(c))
            for c in cols if c in a.df.columns]


def deduplicate_success(b: Side, a: Side, plan: Mapping) -> list[Column]:
    sub = _targets(plan) or list(b.df.columns)
    need(a.df, sub)
    db, da = b.duplicates(sub), a.duplicates(sub)
    return [_issue("deduplicate_success", F.when((db > 0) & (da == db), "warning"), None, "duplicates remain", db, da),
            _issue("deduplicate_success", F.when((da > 0) & (da != db), "info"), None, "some duplicates remain", db, da),
            _issue("deduplicate_success", F.when(db == 0, "info"), None, "there were no duplicates", db, da)]


def new_duplicates_check(b: Side, a: Side, plan: Mapping) -> list[Column]:
    db, da = b.duplicates(list(b.df.columns)), a.duplicates(list(a.df.columns))
    return [_issue("new_duplicates_check", F.when((da - db) > a.rows() * 0.05, "warning"), None, "new duplicate rows", db, da)]


def join_duplicates(b: Side, a: Side, plan: Mapping) -> list[Column]:
    return [_issue("join_duplicates", F.when(a.rows() > b.rows() * 2, "warning"), None, "the join multiplied rows", b.rows(), a.rows())]


def numeric_bounds(b: Side, a: Side, plan: Mapping) -> list[Column]:
    cols = _targets(plan)
    if _kind(plan) == "add_column" and _params(plan).get("name") in a.df.columns:
        cols = [_params(plan)["name"]]
    out = []
    for c in cols:
        if c not in a.df.columns or not is_numeric(a.df, c):
            continue
        x = num(a.df, c)
        n = a.get(f"inf:{c}", F.count_if(F.abs(x) == float("inf")))
        out.append(_issue("numeric_bounds", F.when(n > 0, "warning"), c, "infinite values", None, n))
        if _kind(plan) == "normalize" and _params(plan).get("method", "minmax") == "minmax":
            lo, hi = a.get(f"min:{c}", F.min(x)), a.get(f"max:{c}", F.max(x))
            out.append(_issue("numeric_bounds", F.when((lo < -0.01) | (hi > 1.01), "warning"), c, "values outside [0, 1]", lo, hi))
    return out


def value_changes(b: Side, a: Side, plan: Mapping) -> list[Column]:
    old = _params(plan).get("old_value")
    total = F.lit(0)
    for c in _targets(plan) or [c for c in b.df.columns if c in a.df.columns]:
        if c in b.df.columns and c in a.df.columns and (isinstance(old, str) == (type_class(b.df.schema[c].dataType) == "string")):
            total = total + b.get(f"eq:{c}", F.count_if(col(c) == F.lit(old))) - a.get(f"eq:{c}", F.count_if(col(c) == F.lit(old)))
    return [_issue("value_changes", F.when(total == 0, "info"), None, "nothing was replaced", None, total)]


def sort_order_valid(b: Side, a: Side, plan: Mapping) -> list[Column]:
    """Looks at neighbours in ``parameters.order_by``, the columns that hold the row order."""
    cols = as_list(_params(plan).get("columns")) or _targets(plan)
    order = _params(plan).get("order_by")
    if not cols or cols[0] not in a.df.columns or not order:
        return []
    up = _params(plan).get("ascending", True)
    c = cols[0]
    kept = a.df.where(col(c).isNotNull())
    pairs = scan.shifted(kept, [], scan.need_order(kept, order), {c: "__prev"}, 1)
    wrong = (col(c) < F.col("__prev")) if up else (col(c) > F.col("__prev"))
    n = a.scalar("unsorted", pairs.agg(F.count_if(wrong).alias("n")))
    return [_issue("sort_order_valid", F.when(n > 0, "info"), c, "not sorted by the first key", None, n)]


def phone_format_valid(b: Side, a: Side, plan: Mapping) -> list[Column]:
    layout = _params(plan).get("output_format", "nnn-nnn-nnnn")
    p = PHONE_PATTERNS.get(layout, PHONE_PATTERNS["nnn-nnn-nnnn"])
    out = []
    for c in _targets(plan):
        if c not in a.df.columns:
            continue
        hit = lambda s: s.get(f"phone:{c}", F.count_if(text(s.df, c).rlike(p)))
        total = a.get(f"count:{c}", F.count(col(c)))
        rate = F.try_divide(hit(a).cast("double"), total.cast("double"))
        changed = hit(a) - hit(b) if c in b.df.columns else hit(a)
        level = F.when(rate < 0.5, "error").when(changed == 0, "warning").when(rate < 0.9, "warning")
        out.append(_issue("phone_format_valid", F.when(total > 0, level), c, "phone numbers do not have the layout", hit(b) if c in b.df.columns else None, hit(a)))
    return out


def aggregation_values(b: Side, a: Side, plan: Mapping) -> list[Column]:
    out = []
    for c, fn in (_params(plan).get("aggregations") or {}).items():
        if fn == "sum" and c in b.df.columns and c in a.df.columns and is_numeric(b.df, c):
            sb = b.get(f"sum:{c}", F.coalesce(F.sum(num(b.df, c)), F.lit(0.0)))
            sa = a.get(f"sum:{c}", F.coalesce(F.sum(num(a.df, c)), F.lit(0.0)))
            out.append(_issue("aggregation_values", F.when(F.abs(sb - sa) > F.abs(sb) * 0.01, "info"), c, "the total changed", sb, sa))
    return out


_CELL_OPS = ("trim_whitespace", "change_case", "replace_values", "fill_nulls", "rename_column", "convert_type", "round_numbers",
             "normalize", "sort_rows", "reorder_columns", "format_date", "parse_date")

# check -> the step types it runs after; None means all
CHECKS: dict[str, tuple[Callable, tuple[str, ...] | None]] = {
    "schema_valid": (schema_valid, None),
    "target_columns_exist": (target_columns_exist, None),
    "column_types_preserved": (column_types_preserved, ("trim_whitespace", "change_case", "replace_values", "fill_nulls", "deduplicate",
                                                        "sort_rows", "filter_rows", "drop_rows")),
    "row_count_change": (row_count_change, ROW_REDUCING),
    "filter_actually_filtered": (filter_actually_filtered, ("filter_rows",)),
    "row_count_unchanged": (row_count_unchanged, _CELL_OPS),
    "aggregation_row_count": (aggregation_row_count, ("group_by",)),
    "slice_bounds": (slice_bounds, ("slice_rows",)),
    "fill_nulls_success": (fill_nulls_success, ("fill_nulls",)),
    "new_nulls_introduced": (new_nulls_introduced, ("convert_type", "parse_date", "add_column", "extract_pattern")),
    "drop_rows_null_check": (drop_rows_null_check, ("drop_rows",)),
    "deduplicate_success": (deduplicate_success, ("deduplicate",)),
    "new_duplicates_check": (new_duplicates_check, ("fill_nulls", "replace_values", "change_case", "trim_whitespace")),
    "join_duplicates": (join_duplicates, ("join",)),
    "numeric_bounds": (numeric_bounds, ("round_numbers", "normalize", "add_column")),
    "value_changes": (value_changes, ("replace_values",)),
    "sort_order_valid": (sort_order_valid, ("sort_rows",)),
    "phone_format_valid": (phone_format_valid, ("format_phone",)),
    "aggregation_values": (aggregation_values, ("group_by",)),
}


def register_check(name: str, fn: Callable, applies_to: tuple[str, ...] | None = None) -> None:
    CHECKS[name] = (fn, applies_to)


def checks_for(kind: str) -> list[str]:
    return [n for n, (_, ops) in CHECKS.items() if ops is None or kind in ops]


def acceptance(b: Side, a: Side, plan: Mapping) -> list[Column]:
    """Issues of the plan's acceptance criteria; every failed one is an error."""
    out = []
    for i, crit in enumerate(plan.get("acceptance_criteria") or []):
        kind, c = crit.get("type"), crit.get("column")
        label = f"acceptance_{kind}"
        if kind == "column_format" and c in a.df.columns and crit.get("pattern"):
            hit = a.get(f"fmt{i}", F.count_if(text(a.df, c).rlike(f"^(?:{crit['pattern']})")))
            total = a.get(f"count:{c}", F.count(col(c)))
            rate = F.try_divide(hit.cast("double"), total.cast("double"))
            want = float(crit.get("min_match_rate", 0.9))
            out.append(_issue(label, F.when(rate < want, "error"), c, "too few values have the format", want, rate))
        elif kind == "value_changed" and c in b.df.columns and c in a.df.columns:
            key = as_list(crit.get("key"))
            if not key:
                raise OpError("value_changed needs key: the columns that identify a row")
            left = b.df.select(*[col(k) for k in key], col(c).alias("__old"))
            right = a.df.select(*[col(k).alias(f"__k{j}") for j, k in enumerate(key)], col(c).alias("__new"))
            cond = None
            for j, k in enumerate(key):
                t = left[k].eqNullSafe(right[f"__k{j}"])
                cond = t if cond is None else cond & t
            n = a.scalar(f"changed{i}", left.join(right, cond).agg(F.count_if(~F.col("__old").eqNullSafe(F.col("__new"))).alias("n")))
            out.append(_issue(label, F.when(n == 0, "error"), c, "no value changed", None, n))
        elif kind == "row_count_change":
            delta = a.rows() - b.rows()
            bad = {"increase": delta <= 0, "decrease": delta >= 0, "same": delta != 0}.get(crit.get("expected_change"))
            if bad is not None:
                out.append(_issue(label, F.when(bad, "error"), None, f"row count should {crit['expected_change']}", b.rows(), a.rows()))
        elif kind == "column_exists" and c:
            if bool(crit.get("should_exist", True)) != (c in a.df.columns):
                out.append(_issue(label, "error", c, "column presence is wrong"))
        elif kind == "no_nulls" and c in a.df.columns:
            out.append(_issue(label, F.when(a.nulls(c) > 0, "error"), c, "nulls remain", None, a.nulls(c)))
        elif kind == "unique_values" and c in a.df.columns:
            counts = a.df.where(col(c).isNotNull()).groupBy(col(c)).agg((F.count(F.lit(1)) - 1).alias("n"))
            n = a.scalar(f"repeat{i}", counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
            out.append(_issue(label, F.when(n > 0, "error"), c, "values repeat", None, n))
    return out


ISSUE_SCHEMA = "check_name string, severity string, column string, message string, before double, after double"


def validate(before: DataFrame, after: DataFrame, plan: Mapping, checks: list[str] | None = None) -> DataFrame:
    """Issue rows (check_name, severity, column, message, before, after) of the matching checks and criteria."""
    b, a = Side(before, "b"), Side(after, "a")
    issues: list[Column] = []
    for name in checks if checks is not None else checks_for(_kind(plan)):
        issues += CHECKS[name][0](b, a, plan)
    issues += acceptance(b, a, plan)
    if not issues:
        return rows_frame(before.sparkSession, [], ISSUE_SCHEMA)
    out = a.row().withColumn("b", b.row().scalar())
    for side in (a, b):
        for name, frame in side.extra.items():
            out = out.withColumn(f"{side.name}_{name}", frame.scalar())
    return out.select(F.inline(F.array_compact(F.array(*issues))))


def summarize(issues: DataFrame, strict: bool = False) -> DataFrame:
    """One row: passed, severity, errors, warnings, infos and the first message of the worst level."""
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    level = F.when(errors > 0, "error").when(warnings > 0, "warning").otherwise("success")
    worst = F.min(F.struct(F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2).alias("o"),
                           F.col("check_name"), F.col("message")))["message"]
    return issues.agg(
        ((errors == 0) & ((warnings == 0) | F.lit(not strict))).alias("passed"), level.alias("severity"), errors.alias("errors"),
        warnings.alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos"), worst.alias("suggestion"))


FILTER_KEEP, ROW_REMOVAL = 0.5, 0.2


def assess_risk(df: DataFrame, plan: Mapping, is_deployed: bool = False) -> DataFrame:
    """One row before a step runs: rows_before, rows_after, removal_percent, reasons, risk_level.

    Row effects are counted with the step's own predicate in one pass.
    """
    from ..functions import predicates

    kind, conds = _kind(plan), plan.get("conditions")
    rows = F.count(F.lit(1))
    fixed = []
    if is_deployed:
        fixed.append(F.lit("deployed"))
    if kind == "drop_columns" and _targets(plan):
        fixed.append(F.lit("drops columns"))
    if kind == "deduplicate":
        sub = _targets(plan) or list(df.columns)
        counted = df.groupBy(*[col(c) for c in sub]).agg(F.count(F.lit(1)).alias("n"))
        out = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))
    elif kind in ("filter_rows", "drop_rows") and conds:
        mask = predicates.combine(df, conds)
        out = df.agg(rows.alias("rows_before"), F.count_if(mask if kind == "filter_rows" else ~mask).alias("rows_after"))
    else:
        out = df.agg(rows.alias("rows_before")).withColumn("rows_after", F.col("rows_before"))
    removed = F.coalesce(F.try_divide((F.col("rows_before") - F.col("rows_after")).cast("double"), F.col("rows_before")), F.lit(0.0))
    risky = F.lit(None).cast("string")
    if kind == "filter_rows":
        risky = F.when(1 - removed < FILTER_KEEP, "filter keeps few rows")
    elif kind in ("drop_rows", "deduplicate"):
        risky = F.when(removed > ROW_REMOVAL, "removes many rows")
    out = out.withColumn("removal_percent", F.bround(removed * 100, 1)).withColumn("reasons", F.array_compact(F.array(*fixed, risky)))
    n = F.size("reasons")
    level = F.when(n == 0, "none").when(F.lit(is_deployed) | (n > 1), "high").otherwise("moderate")
    return out.withColumn("risk_level", level).withColumn("reasons", F.array_join("reasons", "; "))


def removed_sample(df: DataFrame, plan: Mapping, n: int = 3) -> DataFrame:
    """The first n of the rows a filter or drop would remove, by all columns that can be ordered."""
    from ..functions import predicates
    from ..operators.rows import _rest

    mask = predicates.combine(df, plan["conditions"])
    return df.where(~mask if _kind(plan) == "filter_rows" else mask).orderBy(*[F.col(q(c)) for c in _rest(df, [])]).limit(n)
