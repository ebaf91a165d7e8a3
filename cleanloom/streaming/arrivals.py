"""Run a module on files as they arrive.

The stream is only the list of new files; each micro-batch reads them with the
layout detection of ``sources.files`` (a CSV stream would misread files with
another column order), gates each layout and replays the steps. Output and run
records are written under the batch number, so a repeated batch after a failure
replaces its own output.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.modules import RUN_SCHEMA, Module, run_module, save_module
from ..sources import files

ORDER = ("source_file", "row_block", "row_id")


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.csv", max_files: int = 1000) -> DataFrame:
    """(path, length, modificationTime) of new files; the content column is never read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", max_files).load(folder).select("path", "length", "modificationTime"))


def layout_key(layout) -> str:
    """The same for the same layout, whatever else is in the batch."""
    parts = [layout["encoding"], layout["delimiter"], str(layout["header_row"]), *layout["fields"]]
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]


def run_files(spark: SparkSession, paths: list[str], module: Module, out: str, batch: int, force: bool = False, tables=None) -> None:
    """One micro-batch: every layout among the files is matched, gated and replayed once, in the files' line order.

    Each layout writes under its own key, so a repeated batch replaces what it wrote; a failed replay is a rejection.
    """
    plan = files.sniff(spark, paths)
    layouts = plan.groupBy("encoding", "delimiter", "header_row", "fields").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    for g in layouts:
        data = files.read_csv_safe(spark, g["files"]).drop("bad_line")
        result = run_module(data, module, ",".join(g["files"]), force, tables, list(ORDER), ORDER)
        key = f"batch={batch}/layout={layout_key(g)}"
        kept = result.output if result.output is not None else data
        kept.write.mode("overwrite").parquet(f"{out}/{'output' if result.output is not None else 'rejected'}/{key}")
        result.record.write.mode("overwrite").parquet(f"{out}/runs/{key}")


def stream_module_run(spark: SparkSession, folder: str, module: Module, out: str, checkpoint: str | None = None, force: bool = False,
                      max_files: int = 1000, once: bool = True, tables=None) -> StreamingQuery:
    """Start the query. The module is written under ``out`` first, so that no batch profiles its source again. ``once`` takes what is there and stops (``availableNow``).

    The checkpoint folder must be shared; by default it lies under ``spark.checkpoint.dir``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    where = checkpoint or (f"{base.rstrip('/')}/arrivals" if base else f"{out}/checkpoint")

    module = save_module(module, f"{out}/module")

    def batch(df: DataFrame, number: int) -> None:
        paths = [r["path"] for r in df.select("path").collect()]  # at most max_files paths
        if paths:
            run_files(spark, paths, module, out, number, force, tables)

    writer = arriving_files(spark, folder, max_files=max_files).writeStream.foreachBatch(batch).option("checkpointLocation", where)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def run_records(spark: SparkSession, out: str) -> DataFrame:
    """All run records written so far."""
    return spark.read.schema(RUN_SCHEMA).parquet(f"{out}/runs")
