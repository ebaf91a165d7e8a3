"""Reading the test tables and the derived inputs several queries share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark):
    """A new folder where all executors see it: under the checkpoint folder, or under the warehouse where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    """events with null values on the error rows."""
    return t(spark, folder, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


GAPPY = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value, props FROM events)"


def gappy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """orders with null status where it was P."""
    return t(spark, folder, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))


GAPPY_ORDERS = "(SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders)"


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    """every customer with all its orders; the order's cells are null where a customer has none and for orders of low priority."""
    c, o = t(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"), t(spark, folder, "orders")
    known = F.col("o_orderpriority") != "5-LOW"
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(*c.columns, *[F.when(known, F.col(x)).alias(x) for x in ORDER_COLUMNS])


CUSTOMER_ORDERS = "(SELECT c_custkey, c_name, c_mktsegment, " + ", ".join(
    f"CASE WHEN o_orderpriority <> '5-LOW' THEN {c} END AS {c}" for c in ORDER_COLUMNS) + " FROM customer LEFT JOIN orders ON c_custkey = o_custkey)"

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_BY = ", ".join(LINE_ORDER)
