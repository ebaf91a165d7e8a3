"""Versions of a table: Parquet snapshots, their mergeable profiles and a table of their parents.

A version that appends rows writes and profiles these rows alone: its data are the parts of its parent and its own, and its
profile is its parent's merged with that of the new rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.core import OpError, col
from ..functions.sketches import column_sketches, merged_sketches, sketched_profile
from ..operators.rows import head_rows

SCHEMA = """id string, parent_id string, session_id string, path string, row_count bigint, column_count int, columns array<string>,
steps string, description string, created_at timestamp, parts array<string>"""


class Versions:
    """Version nodes under one shared folder: ``snapshots/<id>``, ``profiles/<id>`` and ``nodes``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def nodes(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/nodes")
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def create(self, df: DataFrame, session_id: str, parent_id: str | None = None, steps: Sequence[Mapping] | None = None,
               description: str = "", node_id: str | None = None) -> str:
        """Write the snapshot and its profile, then its node. A node is listed only when both are complete."""
        return self._add(df, session_id, parent_id, None, steps, description, node_id)

    def append(self, rows: DataFrame, session_id: str, parent_id: str, description: str = "", node_id: str | None = None) -> str:
        """A version of the parent's rows and these, which need the parent's columns, in any order. Only the new rows are read and written."""
        parent, kind = self.node(parent_id), self.read(parent_id).schema
        if sorted(rows.columns) != sorted(kind.names):
            raise OpError(f"appended rows need the columns {kind.names}")
        return self._add(rows.select(*[col(f.name).cast(f.dataType) for f in kind.fields]), session_id, parent_id, parent, None, description, node_id)

    def _add(self, df: DataFrame, session_id: str, parent_id: str | None, onto, steps, description: str, node_id: str | None) -> str:
        node = node_id or uuid.uuid4().hex
        path, profile = f"{self.root}/snapshots/{node}", f"{self.root}/profiles/{node}"
        df.write.mode("overwrite").parquet(path)
        sketches = column_sketches(self.spark.read.schema(df.schema).parquet(path))
        if onto is not None:
            sketches = merged_sketches(self._sketches(parent_id), sketches)
        sketches.coalesce(1).write.mode("overwrite").parquet(profile)  # a row for each column
        parts = [*(_parts(onto) if onto is not None else []), path]
        row = self.spark.read.parquet(profile).agg(F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count")).select(
            F.lit(node).alias("id"), F.lit(parent_id).cast("string").alias("parent_id"), F.lit(session_id).alias("session_id"),
            F.lit(path).alias("path"), "row_count", F.lit(len(df.columns)).alias("column_count"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"), F.lit(json.dumps(list(steps or []))).alias("steps"),
            F.lit(description).alias("description"), F.current_timestamp().alias("created_at"), F.array(*[F.lit(p) for p in parts]).alias("parts"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/nodes")
        return node

    def _sketches(self, node_id: str) -> DataFrame:
        """The stored column sketches; a version of before there were any is read once more for them."""
        try:
            return self.spark.read.parquet(f"{self.root}/profiles/{node_id}")
        except AnalysisException:
            return column_sketches(self.read(node_id))

    def profile(self, node_id: str) -> DataFrame:
        """The profile stored with the version (``functions.sketches`` states its errors); reads no row of the table."""
        return sketched_profile(self._sketches(node_id))

    def node(self, node_id: str):
        rows = self.nodes().where(F.col("id") == node_id).limit(1).collect()
        if not rows:
            raise OpError(f"no version {node_id!r}")
        return rows[0]

    def read(self, node_id: str) -> DataFrame:
        return self.spark.read.parquet(*_parts(self.node(node_id)))

    def preview(self, node_id: str, n: int = 10, order_by=None) -> DataFrame:
        """The first rows in the given order, or in that of all columns that can be ordered."""
        df = self.read(node_id)
        return head_rows(df, n, order_by or [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)])

    def lineage(self, node_id: str, depth: int = 3) -> DataFrame:
        """The node and up to ``depth - 1`` ancestors, oldest first."""
        return lineage(self.nodes(), node_id, depth)

    def saved_steps(self, node_id: str, depth: int | None = None) -> list[dict]:
        """All steps from the root to this version, in order."""
        rows = self.lineage(node_id, self.nodes().count() if depth is None else depth).select("steps").collect()  # one short row per version
        return [s for r in rows for s in json.loads(r["steps"])]

    def undo(self, node_id: str, to: str | None = None) -> tuple[str, DataFrame]:
        """The parent (or named) version and its data."""
        target = to or self.node(node_id)["parent_id"]
        if not target:
            raise OpError("this version has no parent")
        return target, self.read(target)


def _parts(node) -> list[str]:
    return list(node["parts"] or [node["path"]])


def lineage(nodes: DataFrame, node_id: str, depth: int = 3) -> DataFrame:
    """Ancestor chain of a (id, parent_id, ...) table by a recursive query, oldest first."""
    query = """
        WITH RECURSIVE chain(id, parent_id, level) MAX RECURSION LEVEL {limit} AS (
          SELECT id, parent_id, 1 FROM {nodes} WHERE id = :node
          UNION ALL
          SELECT n.id, n.parent_id, c.level + 1 FROM {nodes} n JOIN chain c ON n.id = c.parent_id WHERE c.level < :depth
        )
        SELECT n.*, c.level FROM chain c JOIN {nodes} n ON n.id = c.id ORDER BY c.level DESC
        """
    return nodes.sparkSession.sql(query.replace("{limit}", str(int(depth) + 1)), args={"node": node_id, "depth": int(depth)}, nodes=nodes)
