"""Benchmark tables in the roles of sensors, sources and roads, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.workloads.registry import table

TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_TIME_TEXT = "%Y-%m-%d %H:%M:%S.%f"


def time_text(column: str = "event_timestamp") -> Column:
    return F.date_format(column, TIME_TEXT)


def sensor_events(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Events as sensor rows: one source per event type, one file per day and source."""
    events = table(spark, folder, "events", "event_id" if spread else None)
    time = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("position"),
        F.col("event_type").alias("source_path"),
        F.col("event_type").alias("source"),
        F.date_format(time, "yyyy-MM-dd").alias("file_path"),
        F.col("event_type").alias("sensor_id"),
        "user_id",
        time.alias("event_timestamp"),
        F.col("value").alias("speed_val"),
        F.get_json_object("props", "$.k").cast("double").alias("flow_val"),
    )


SQL_SENSOR_EVENTS = """
sensor_events AS (
  SELECT event_id AS position, event_type AS source, strftime(ts, '%Y-%m-%d') AS file_path,
         event_type AS sensor_id, user_id, ts AS event_timestamp, value AS speed_val,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS flow_val
  FROM events
)"""


def data_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as data sources. Three types by key; the nation is the element, none for key 0, 5, …"""
    key = F.col("s_suppkey")
    kind = F.when(key % 3 == 0, "GLOBAL").when(key % 3 == 1, "LOCAL").otherwise("UNASSOCIATED")
    return table(spark, folder, "supplier").select(
        F.col("s_name").alias("path"),
        F.col("s_name").alias("name"),
        kind.alias("association_type"),
        F.when(key % 5 != 0, F.col("s_nationkey").cast("string")).alias("associated_element_id"),
        key.alias("seq"),
    )


SQL_DATA_SOURCES = """
data_sources AS (
  SELECT s_name AS path, s_name AS name,
         CASE s_suppkey % 3 WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'LOCAL' ELSE 'UNASSOCIATED' END AS association_type,
         CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS associated_element_id,
         s_suppkey AS seq
  FROM supplier
)"""


def roads(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as edges: one per customer, and the opposite direction for even keys."""
    customers = table(spark, folder, "customer")
    key = F.col("c_custkey").cast("string")
    ids = F.when(F.col("c_custkey") % 2 == 0, F.array(key, F.concat(F.lit("-"), key))).otherwise(F.array(key))
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, "")
    return customers.select(F.explode(ids).alias("id"), name.alias("real_name"))


SQL_ROADS = """
roads AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
         CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '' END AS real_name FROM customer
  UNION ALL
  SELECT '-' || CAST(c_custkey AS VARCHAR),
         CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '' END FROM customer WHERE c_custkey % 2 = 0
)"""


def nation_names(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as named edges."""
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("string").alias("sumo_id"), F.col("n_name").alias("real_name")
    )


SQL_NATION_NAMES = """
nation_names AS (SELECT CAST(n_nationkey AS VARCHAR) AS sumo_id, n_name AS real_name FROM nation)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(part.strip() for part in parts)
