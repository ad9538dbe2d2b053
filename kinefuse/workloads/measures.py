"""Traffic physics over sensor rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.functions.numbers import safe_divide as divide
from kinefuse.operators import physics
from kinefuse.schemas import KINEMATIC_FIELDS, ROLES
from kinefuse.workloads.registry import query, table
from kinefuse.workloads.standins import (
    SQL_SENSOR_EVENTS,
    SQL_TIME_TEXT,
    sensor_events,
    time_text,
    with_sql,
)

SQL_SPEED = """
CASE WHEN count(speed_val) > 0 THEN
  CASE WHEN sum(CASE WHEN speed_val <> 0 THEN 1.0 / speed_val END) > 0
       THEN count(speed_val) / sum(CASE WHEN speed_val <> 0 THEN 1.0 / speed_val END) ELSE 0.0 END
END"""
SQL_HOURS = """
CASE WHEN (epoch_us(max(event_timestamp)) - epoch_us(min(event_timestamp))) // 1000 > 0
     THEN ((epoch_us(max(event_timestamp)) - epoch_us(min(event_timestamp))) // 1000) / 3600000.0 ELSE 1.0 END"""
SQL_FLOW = f"CASE WHEN count(flow_val) > 0 THEN sum(flow_val) ELSE count(*) / {SQL_HOURS} END"
SQL_KINEMATICS = f"""
kinematics AS (
  SELECT source, file_path, sensor_id, event_timestamp, speed_val, flow_val,
         CASE WHEN reported > 0 THEN mean_intensity WHEN speed_val > 0 THEN flow_val / speed_val ELSE 0.0 END AS intensity_val
  FROM (SELECT source, file_path, sensor_id, max(event_timestamp) AS event_timestamp,
               {SQL_SPEED} AS speed_val, {SQL_FLOW} AS flow_val,
               0 AS reported, CAST(NULL AS DOUBLE) AS mean_intensity
        FROM sensor_events GROUP BY source, file_path, sensor_id)
)"""


def file_kinematics(spark: SparkSession, folder: str) -> DataFrame:
    """Sensor rows to one row per source and day."""
    events = sensor_events(spark, folder).withColumns(
        {name: F.lit(None).cast("double") for name in ("intensity_val", "lat", "lon")}
    )
    return physics.summarise(events, list(physics.FILE_KEYS))


@query(
    with_sql(SQL_SENSOR_EVENTS, SQL_KINEMATICS)
    + f"""
SELECT source, file_path, sensor_id, strftime(event_timestamp, '{SQL_TIME_TEXT}') AS event_timestamp,
       round(speed_val, 6) AS speed_val, round(flow_val, 6) AS flow_val, round(intensity_val, 6) AS intensity_val
FROM kinematics"""
)
def kinematics_per_file(spark: SparkSession, folder: str) -> DataFrame:
    """Per file and sensor: space-mean speed, flow, intensity, latest time."""
    return file_kinematics(spark, folder).select(
        "source",
        "file_path",
        "sensor_id",
        time_text().alias("event_timestamp"),
        *[F.round(m, 6).alias(m) for m in ("speed_val", "flow_val", "intensity_val")],
    )


@query(
    """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END, 6) AS speed
FROM lineitem"""
)
def safe_divide(spark: SparkSession, folder: str) -> DataFrame:
    """Distance over time with zero times."""
    rows = table(spark, folder, "lineitem")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        F.round(divide(F.col("l_quantity"), F.col("l_discount")), 6).alias("speed"),
    )


@query(
    f"""
SELECT l_suppkey, round({SQL_SPEED}, 6) AS space_mean_speed
FROM (SELECT l_suppkey, CASE WHEN l_tax > 0.01 THEN l_discount * 100 - (CASE WHEN l_suppkey % 7 = 0 THEN 20 ELSE 0 END) END AS speed_val
      FROM lineitem)
GROUP BY l_suppkey"""
)
def harmonic_speed(spark: SparkSession, folder: str) -> DataFrame:
    """Space-mean speed with null, zero and negative speeds."""
    shift = F.when(F.col("l_suppkey") % 7 == 0, 20).otherwise(0)
    speed = F.when(F.col("l_tax") > 0.01, F.col("l_discount") * 100 - shift)
    rows = table(spark, folder, "lineitem").select("l_suppkey", speed.alias("speed_val"))
    return rows.groupBy("l_suppkey").agg(
        F.round(physics.space_mean_speed(F.col("speed_val")), 6).alias("space_mean_speed")
    )


_SOME_FLOW = "CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 AND flow_val > 50 THEN NULL ELSE flow_val END"


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + f"""
SELECT user_id, file_path, round({SQL_FLOW}, 6) AS flow
FROM (SELECT user_id, file_path, event_timestamp, {_SOME_FLOW} AS flow_val FROM sensor_events)
GROUP BY user_id, file_path"""
)
def flow_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Reported flow, or events per hour; many groups have one event and so no span."""
    rows = sensor_events(spark, folder).withColumn("flow_val", F.expr(_SOME_FLOW))
    return rows.groupBy("user_id", "file_path").agg(
        F.round(physics.flow_rate(F.col("flow_val"), F.col("event_timestamp")), 6).alias("flow")
    )


_SOME_INTENSITY = "CASE WHEN user_id % 2 = 0 AND flow_val > 30 THEN flow_val / 7 END"
_SOME_SPEED = "CASE WHEN user_id % 5 = 0 THEN 0.0 WHEN user_id % 7 = 0 THEN NULL ELSE speed_val END"


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + f"""
SELECT user_id, round(CASE WHEN n > 0 THEN mean WHEN speed > 0 THEN flow / speed ELSE 0.0 END, 6) AS intensity
FROM (SELECT user_id, count(intensity_val) AS n, avg(intensity_val) AS mean, {SQL_SPEED} AS speed, {SQL_FLOW} AS flow
      FROM (SELECT user_id, event_timestamp, {_SOME_INTENSITY} AS intensity_val, {_SOME_SPEED} AS speed_val, flow_val FROM sensor_events)
      GROUP BY user_id)"""
)
def traffic_intensity(spark: SparkSession, folder: str) -> DataFrame:
    """Reported intensity, or flow over speed."""
    rows = sensor_events(spark, folder).withColumns(
        {"intensity_val": F.expr(_SOME_INTENSITY), "speed_val": F.expr(_SOME_SPEED)}
    )
    speed = physics.space_mean_speed(F.col("speed_val"))
    flow = physics.flow_rate(F.col("flow_val"), F.col("event_timestamp"))
    intensity = physics.traffic_intensity(F.col("intensity_val"), flow, speed)
    return rows.groupBy("user_id").agg(F.round(intensity, 6).alias("intensity"))


_LAT = "CASE WHEN position % 3 = 0 THEN NULL ELSE speed_val END"


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + f"""
SELECT user_id, strftime(max(event_timestamp), '{SQL_TIME_TEXT}') AS latest,
       arg_min_null({_LAT}, position) AS lat, arg_min_null(flow_val, position) AS lon
FROM sensor_events GROUP BY user_id"""
)
def latest_and_first(spark: SparkSession, folder: str) -> DataFrame:
    """Latest time and first location of a group, a null first location kept."""
    rows = sensor_events(spark, folder).withColumns(
        {"lat": F.expr(_LAT), "lon": F.col("flow_val"), "intensity_val": F.lit(None).cast("double")}
    )
    return physics.summarise(rows, ["user_id"]).select(
        "user_id", time_text().alias("latest"), "lat", "lon"
    )


# Roles by source: one has speed and flow, one distance over time, one occupancy, one nothing.
_PAYLOAD = "map('v', CAST(speed_val AS STRING), 'q', CAST(flow_val AS STRING), 'dur', CAST(position % 4 AS STRING))"
_ROLE_OF = {
    "speed_col": "CASE WHEN source IN ('click', 'error') THEN 'v' END",
    "flow_col": "CASE WHEN source IN ('click', 'view') THEN 'q' END",
    "intensity_col": "CASE WHEN source IN ('click', 'purchase') THEN 'q' END",
    "distance_col": "CASE WHEN source IN ('view', 'purchase') THEN 'v' END",
    "time_col": "CASE WHEN source = 'view' THEN 'dur' END",
    "occupancy_col": "CASE WHEN source IN ('view', 'click', 'purchase') THEN 'dur' END",
}
_KIND = "CASE WHEN user_id % 2 = 0 THEN 'global' ELSE 'LOCAL' END"


def _with_roles(spark: SparkSession, folder: str) -> DataFrame:
    rows = sensor_events(spark, folder, spread=True)
    return rows.withColumns({role: F.expr(_ROLE_OF[role]) for role in ROLES}).withColumns(
        {
            "payload": F.expr(_PAYLOAD),
            "association_type": F.expr(_KIND),
            "lat_col": F.lit(None).cast("string"),
            "lon_col": F.lit(None).cast("string"),
        }
    )


_SQL_PROJECTION = """
SELECT position AS event_id,
  round(CASE WHEN source IN ('click', 'error') THEN speed_val
       WHEN source = 'view' AND position % 4 <> 0 THEN speed_val / (position % 4) END, 6) AS speed_val,
  CASE WHEN {local} AND source IN ('click', 'view') THEN flow_val END AS flow_val,
  CASE WHEN {local} AND source IN ('click', 'purchase') THEN flow_val
       WHEN source IN ('view', 'click', 'purchase') THEN CAST(position % 4 AS DOUBLE) END AS intensity_val
FROM sensor_events"""


@query(with_sql(SQL_SENSOR_EVENTS) + _SQL_PROJECTION.format(local="TRUE"))
def kinematic_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Per event: speed, flow and intensity from the source's role columns."""
    rows = _with_roles(spark, folder).withColumn("association_type", F.lit("LOCAL"))
    return physics.kinematic_projection(rows).select(
        F.col("position").alias("event_id"),
        F.round("speed_val", 6).alias("speed_val"),
        "flow_val",
        "intensity_val",
    )


@query(with_sql(SQL_SENSOR_EVENTS) + _SQL_PROJECTION.format(local="user_id % 2 <> 0"))
def global_mask(spark: SparkSession, folder: str) -> DataFrame:
    """The same with GLOBAL sources, which lose flow and intensity columns but keep occupancy."""
    return physics.kinematic_projection(_with_roles(spark, folder)).select(
        F.col("position").alias("event_id"),
        F.round("speed_val", 6).alias("speed_val"),
        "flow_val",
        "intensity_val",
    )


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + f"""
SELECT position AS event_id, strftime(event_timestamp, '{SQL_TIME_TEXT}') AS event_timestamp,
       speed_val, CAST(NULL AS DOUBLE) AS flow_val, CAST(NULL AS DOUBLE) AS lat
FROM sensor_events"""
)
def unmapped_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of sources without a map pass one by one, fields read by their own names."""
    payload = F.create_map(
        F.lit("speed_val"), F.col("speed_val").cast("string"), F.lit("flow_val"), F.lit("n/a")
    )
    rows = sensor_events(spark, folder).withColumn("payload", payload)
    return physics.pass_through(rows).select(
        F.col("position").alias("event_id"), time_text().alias("event_timestamp"), "speed_val", "flow_val", "lat"
    )


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + """
SELECT position AS event_id, CASE WHEN position % 4 = 0 THEN NULL ELSE speed_val END AS speed_val,
       CASE WHEN position % 4 = 1 THEN NULL ELSE flow_val END AS flow_val,
       CAST(NULL AS DOUBLE) AS intensity_val, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon
FROM sensor_events"""
)
def backfill_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Missing fields appear as null, NaN and unreadable text turn to null."""
    rows = sensor_events(spark, folder).select(
        F.col("position").alias("event_id"),
        F.when(F.col("position") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("speed_val")).alias("speed_val"),
        F.when(F.col("position") % 4 == 1, "none").otherwise(F.col("flow_val").cast("string")).alias("flow_val"),
    )
    return physics.backfill(rows).select("event_id", *KINEMATIC_FIELDS)


_SPEED_GAPS = "CASE WHEN position % 4 = 0 THEN NULL ELSE speed_val END"
_FLOW_GAPS = "CASE WHEN position % 6 = 0 THEN NULL ELSE flow_val END"
_INTENSITY_GAPS = "CASE WHEN position % 5 = 0 THEN NULL ELSE flow_val END"


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + f"""
SELECT source, count(*) AS row_count,
       CAST(count_if(speed_val IS NULL) AS BIGINT) AS missing_speed,
       CAST(count_if(flow_val IS NULL) AS BIGINT) AS missing_flow,
       CAST(count_if(intensity_val IS NULL) AS BIGINT) AS missing_intensity,
       CAST(count_if(speed_val IS NULL OR flow_val IS NULL OR intensity_val IS NULL) AS BIGINT) AS incomplete
FROM (SELECT source, {_SPEED_GAPS} AS speed_val, {_FLOW_GAPS} AS flow_val, {_INTENSITY_GAPS} AS intensity_val FROM sensor_events)
GROUP BY source"""
)
def missing_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of a source lack a measure."""
    rows = sensor_events(spark, folder).withColumn("intensity_val", F.expr(_INTENSITY_GAPS))
    rows = rows.withColumns({"speed_val": F.expr(_SPEED_GAPS), "flow_val": F.expr(_FLOW_GAPS)})
    return physics.missing_audit(rows, "source")


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + """
SELECT position AS event_id,
       concat_ws(',', CASE WHEN position % 4 = 0 THEN 'speed_val' END, CASE WHEN position % 6 = 0 THEN 'flow_val' END,
                 CASE WHEN position % 5 = 0 THEN 'intensity_val' END) AS missing
FROM sensor_events"""
)
def missing_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Which measures each row lacks."""
    rows = sensor_events(spark, folder).withColumn("intensity_val", F.expr(_INTENSITY_GAPS))
    rows = rows.withColumns({"speed_val": F.expr(_SPEED_GAPS), "flow_val": F.expr(_FLOW_GAPS)})
    return physics.missing_measures(rows).select(
        F.col("position").alias("event_id"), F.array_join("missing", ",").alias("missing")
    )
