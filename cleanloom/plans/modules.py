"""Saved modules: a contract and a step list, run on incoming files behind a match gate."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import contract as contracts
from . import pipeline, profile
from ..functions.core import rows_frame
from ..sources import files


@dataclass
class Module:
    """What a run needs: the contract rows of its input and its steps."""

    contract_id: str
    contract: DataFrame
    steps: Sequence[Mapping]


def build_module(df: DataFrame, steps: Sequence[Mapping], contract_id: str = "module") -> Module:
    """A module whose contract is taken from a sample of good input."""
    return Module(contract_id, contracts.generate_contract(profile.profile_table(df, quartiles=False), contract_id), steps)


def save_module(module: Module, folder: str) -> Module:
    """Write contract and steps under a shared folder; the module that comes back reads the written contract."""
    spark = module.contract.sparkSession
    module.contract.write.mode("overwrite").parquet(f"{folder}/contract")
    rows_frame(spark, [(module.contract_id, json.dumps(list(module.steps)))], "contract_id string, steps string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/steps")
    return load_module(spark, folder)


def load_module(spark: SparkSession, folder: str) -> Module:
    row = spark.read.parquet(f"{folder}/steps").first()
    return Module(row["contract_id"], spark.read.parquet(f"{folder}/contract"), json.loads(row["steps"]))


def match_incoming(df: DataFrame, module: Module, file: str = "incoming") -> DataFrame:
    """Read the meaning of a frame's columns and match them against the module's contract: one row."""
    p = profile.column_meanings(df).select(F.lit(file).alias("file"), F.lit(module.contract_id).alias("contract_id"), "position", "column",
                                         "semantic_type", "dtype", "values_sketch")
    return contracts.match_schema(p, module.contract)


def apply_module(df: DataFrame, module: Module, mapping: Mapping[str, str] | None = None, tables=None, order_by=None) -> pipeline.PlanResult:
    """Rename by the mapping, then replay the steps."""
    rename = {k: v for k, v in (mapping or {}).items() if k != v and k in df.columns}
    return pipeline.run_plan(df.withColumnsRenamed(rename), module.steps, tables, True, order_by)


def profile_files(spark: SparkSession, paths, trim_footers: bool = True) -> DataFrame:
    """Read files of any layout and profile their data columns, without the summary and blank rows at the ends of files."""
    df = files.read_csv_safe(spark, paths, mark_footers=trim_footers)
    df = df.where(~F.col("is_footer")).drop("is_footer") if trim_footers else df
    return profile.profile_table(df.drop("source_file", "row_block", "row_id", "bad_line"))


RUN_SCHEMA = "file string, contract_id string, score double, level string, status string, error string"


@dataclass
class RunResult:
    record: DataFrame
    output: DataFrame | None
    status: str
    mapping: dict[str, str]


def run_module(df: DataFrame, module: Module, file: str = "incoming", force: bool = False, tables=None, order_by=None,
               hidden: Sequence[str] = ()) -> RunResult:
    """match -> gate -> replay. NO_MATCH and LOW fail, MEDIUM waits unless forced, HIGH runs.

    ``hidden`` columns ride along for the order and are no part of the match or the output. Only the match row (column
    names and a score) comes to the driver.
    """
    row = match_incoming(df.drop(*hidden), module, file).first()
    level, score = (row["level"], float(row["score"])) if row else ("NO_MATCH", 0.0)
    mapping = {m["incoming"]: m["target"] for m in row["mappings"]} if row else {}
    status, error, output = "success", None, None
    if level in ("NO_MATCH", "LOW"):
        status, error = "failed", f"match level {level}"
    elif level == "MEDIUM" and not force:
        status, error = "needs_confirmation", "match level MEDIUM"
    else:
        done = apply_module(df, module, mapping, tables, order_by)
        if done.success:
            output = done.df.drop(*hidden)
        else:
            status, error = "failed", next(s.error for s in done.steps if not s.success)
    record = rows_frame(df.sparkSession, [(file, module.contract_id, score, level, status, error)], RUN_SCHEMA)
    return RunResult(record, output, status, mapping)
