"""Sensors to their places on the map, sections, and the delivered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.operators import associations, export
from kinefuse.operators.physics import FILE_KEYS, summarise
from kinefuse.schemas import UNIFIED_COLUMNS
from kinefuse.sinks.landing import raw_landing as landing
from kinefuse.storage import write_and_read
from kinefuse.workloads.measures import SQL_FLOW, SQL_SPEED, file_kinematics
from kinefuse.workloads.registry import query, table
from kinefuse.workloads.standins import (
    SQL_DATA_SOURCES,
    SQL_NATION_NAMES,
    SQL_SENSOR_EVENTS,
    SQL_TIME_TEXT,
    data_sources,
    nation_names,
    sensor_events,
    time_text,
    with_sql,
)

# Users as sensors: their number written as a supplier's name in other case; some match no supplier.
_SENSOR = "lower(concat('Supplier#', lpad(CAST(user_id AS STRING), 9, '0')))"
_SQL_SENSOR = "lower('Supplier#' || lpad(CAST(user_id AS VARCHAR), 9, '0'))"

# Each source once more under an upper-case name and with another element: the later row counts.
_SQL_NAMED = """
named AS (
  SELECT s.path AS source_name, s.association_type, s.associated_element_id, n.real_name, s.seq
  FROM data_sources s LEFT JOIN nation_names n ON s.associated_element_id = n.sumo_id
), lookup AS (
  SELECT lower(source_name) AS sensor_key, association_type, associated_element_id,
         CASE WHEN associated_element_id IN ('3', '4') THEN '' ELSE real_name END AS real_name FROM named
)"""


def _named(spark: SparkSession, folder: str) -> DataFrame:
    sources = data_sources(spark, folder).withColumnRenamed("path", "source_name").drop("name")
    return associations.association_names(sources, nation_names(spark, folder))


def _lookup(spark: SparkSession, folder: str) -> DataFrame:
    named = _named(spark, folder)
    emptied = F.when(F.col("associated_element_id").isin("3", "4"), "").otherwise(F.col("real_name"))
    later = named.withColumn("real_name", emptied)
    earlier = named.select(
        F.upper("source_name").alias("source_name"),
        F.lit("LOCAL").alias("association_type"),
        F.lit("old").alias("associated_element_id"),
        (F.col("seq") - 1_000_000).alias("seq"),
        F.lit("old name").alias("real_name"),
    )
    return write_and_read(associations.sensor_map(later.unionByName(earlier)), "lookup")


def _located_events(spark: SparkSession, folder: str) -> DataFrame:
    return sensor_events(spark, folder).select(
        "position",
        F.expr(_SENSOR).alias("sensor_id"),
        F.when(F.col("position") % 2 == 0, F.concat(F.lit("near "), "source")).alias("location_text_raw"),
    )


@query(
    with_sql(SQL_DATA_SOURCES, SQL_NATION_NAMES, _SQL_NAMED)
    + "\nSELECT source_name, association_type, associated_element_id, real_name FROM named"
)
def association_names(spark: SparkSession, folder: str) -> DataFrame:
    """Associations with the name of their edge."""
    return _named(spark, folder).drop("seq")


_SQL_LOOKUP = f"""
SELECT e.position AS event_id, coalesce(l.association_type, 'LOCAL') AS origin_type,
       l.associated_element_id AS mapped_id, l.real_name AS mapped_name, e.position, e.source
FROM (SELECT *, {_SQL_SENSOR} AS sensor FROM sensor_events) e LEFT JOIN lookup l ON e.sensor = l.sensor_key"""


@query(
    with_sql(SQL_SENSOR_EVENTS, SQL_DATA_SOURCES, SQL_NATION_NAMES, _SQL_NAMED)
    + f"\nSELECT event_id, origin_type, mapped_id, mapped_name FROM ({_SQL_LOOKUP})"
)
def sensor_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Origin and mapped place of each event's sensor; names compare without case, the last one counts."""
    found = associations.sensor_lookup(_located_events(spark, folder), _lookup(spark, folder))
    return found.select(F.col("position").alias("event_id"), "origin_type", "mapped_id", "mapped_name")


@query(
    with_sql(SQL_SENSOR_EVENTS, SQL_DATA_SOURCES, SQL_NATION_NAMES, _SQL_NAMED)
    + f"""
SELECT event_id, origin_type, CASE WHEN origin_type <> 'GLOBAL' THEN mapped_id END AS sumo_id,
       CASE WHEN origin_type <> 'GLOBAL' THEN
         CASE WHEN mapped_name <> '' THEN mapped_name WHEN position % 2 = 0 THEN 'near ' || source END END AS location_text
FROM ({_SQL_LOOKUP})"""
)
def location_assign(spark: SparkSession, folder: str) -> DataFrame:
    """Element and location text; GLOBAL sensors get neither, unnamed places use the event's own text."""
    found = associations.sensor_lookup(_located_events(spark, folder), _lookup(spark, folder))
    return associations.assign_location(found).select(
        F.col("position").alias("event_id"), "origin_type", "sumo_id", "location_text"
    )


def _sensor_days(spark: SparkSession, folder: str) -> DataFrame:
    events = sensor_events(spark, folder).withColumns(
        {
            "sensor_id": F.expr(_SENSOR),
            "intensity_val": F.lit(None).cast("double"),
            "lat": F.col("speed_val") / 10,
            "lon": -F.col("flow_val"),
        }
    )
    return summarise(events, list(FILE_KEYS))


_SQL_SENSOR_DAYS = f"""
sensor_days AS (
  SELECT *, CASE WHEN speed_val > 0 THEN flow_val / speed_val ELSE 0.0 END AS intensity_val
  FROM (SELECT source, file_path, {_SQL_SENSOR} AS sensor_id, max(event_timestamp) AS event_timestamp,
               {SQL_SPEED} AS speed_val, {SQL_FLOW} AS flow_val,
               arg_min(speed_val / 10, position) AS lat, arg_min(-flow_val, position) AS lon
        FROM sensor_events GROUP BY source, file_path, user_id)
)"""


@query(
    with_sql(SQL_SENSOR_EVENTS, SQL_DATA_SOURCES, SQL_NATION_NAMES, _SQL_NAMED, _SQL_SENSOR_DAYS)
    + f"""
SELECT strftime(d.event_timestamp, '{SQL_TIME_TEXT}') AS event_timestamp, d.sensor_id,
       CASE WHEN coalesce(l.association_type, 'LOCAL') <> 'GLOBAL' THEN l.associated_element_id END AS sumo_id,
       CASE WHEN coalesce(l.association_type, 'LOCAL') <> 'GLOBAL' AND l.real_name <> '' THEN l.real_name END AS location_text,
       d.lat, d.lon, coalesce(l.association_type, 'LOCAL') AS origin_type,
       CAST(round_even(d.speed_val, 0) AS BIGINT) AS speed_val, round_even(d.flow_val * 100, 0) / 100 AS flow_val,
       round_even(d.intensity_val * 100, 0) / 100 AS intensity_val, 'section_' || d.source AS source_table
FROM sensor_days d LEFT JOIN lookup l ON d.sensor_id = l.sensor_key"""
)
def unified_export(spark: SparkSession, folder: str) -> DataFrame:
    """Kinematics through their stored form to the eleven delivered columns, sorted by time."""
    stored = export.section_rows(_sensor_days(spark, folder))
    unified = export.sort_by_time(export.unified_rows(stored, _lookup(spark, folder)))
    return unified.withColumn("event_timestamp", time_text()).select(*UNIFIED_COLUMNS)


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + f"""
SELECT 'section_' || source AS section, file_path AS raw_file_reference, sensor_id,
       strftime(max(event_timestamp), '{SQL_TIME_TEXT}') AS event_timestamp,
       round({SQL_SPEED}, 6) AS speed_val, round({SQL_FLOW}, 6) AS flow_val, TRUE AS keeps_nulls
FROM sensor_events GROUP BY source, file_path, sensor_id"""
)
def section_write(spark: SparkSession, folder: str) -> DataFrame:
    """Kinematic rows as sections store them: text time, JSON payload with its nulls, file reference."""
    stored = export.section_rows(file_kinematics(spark, folder))

    def field(name: str):
        return F.round(F.get_json_object("data_payload", f"$.{name}").cast("double"), 6).alias(name)

    return stored.select(
        "section",
        "raw_file_reference",
        "sensor_id",
        "event_timestamp",
        field("speed_val"),
        field("flow_val"),
        F.col("data_payload").endswith('"lat":null,"lon":null}').alias("keeps_nulls"),
    )


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + f"""
SELECT position AS event_id, 'section_' || source AS source_table, strftime(event_timestamp, '{SQL_TIME_TEXT}') AS event_timestamp,
       CASE WHEN position % 4 <> 0 THEN speed_val END AS speed_val,
       CASE WHEN position % 4 = 2 THEN flow_val END AS lat,
       CASE WHEN position % 4 = 1 THEN 'by ' || source END AS location_text_raw
FROM sensor_events"""
)
def section_unpack(spark: SparkSession, folder: str) -> DataFrame:
    """Stored rows read back; broken payloads give nulls."""
    speed = F.concat(F.lit('{"speed_val":'), F.col("speed_val").cast("string"))
    turn = F.col("position") % 4
    document = (
        F.when(turn == 0, speed)
        .when(turn == 1, F.concat(speed, F.lit(',"location_text_raw":"by '), "source", F.lit('"}')))
        .when(turn == 2, F.concat(speed, F.lit(',"lat":"'), F.col("flow_val").cast("string"), F.lit('"}')))
        .otherwise(F.concat(speed, F.lit(',"lat":{"deg":1}}')))
    )
    rows = sensor_events(spark, folder, spread=True).select(
        F.concat(F.lit("section_"), "source").alias("section"),
        time_text().alias("event_timestamp"),
        F.col("position").cast("string").alias("sensor_id"),
        document.alias("data_payload"),
    )
    return export.unpack_section(rows).select(
        F.col("sensor_id").cast("long").alias("event_id"),
        "source_table",
        time_text().alias("event_timestamp"),
        "speed_val",
        "lat",
        "location_text_raw",
    )


@query(
    """
SELECT DISTINCT CASE event_type WHEN 'click' THEN 'sectionXclick' WHEN 'view' THEN 'sections' ELSE 'section_' || event_type END AS section
FROM events WHERE event_type <> 'error'"""
)
def section_list(spark: SparkSession, folder: str) -> DataFrame:
    """Sections by name; in the pattern the underscore stands for any character."""
    source = F.col("source")
    name = (
        F.when(source == "click", "sectionXclick")
        .when(source == "view", "sections")
        .when(source == "error", "raw_data_storage")
        .otherwise(F.concat(F.lit("section_"), source))
    )
    return export.section_list(sensor_events(spark, folder).select(name.alias("section")))


@query(
    """
SELECT source AS source_id, doc_id || '.v2.TXT' AS filename, '.txt' AS file_extension, md5(text) AS file_hash,
       CAST(strlen(text) AS BIGINT) AS file_size_bytes, md5(text) AS content_md5
FROM documents"""
)
def raw_landing(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as landed files with fingerprint and size."""
    files = table(spark, folder, "documents").select(
        "source",
        F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".v2.TXT")).alias("file_path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return landing(files).withColumn("content_md5", F.md5("raw_content")).drop("import_timestamp", "raw_content")


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + """
SELECT source, count(*) AS files, CAST(sum(n) AS BIGINT) AS events
FROM (SELECT source, file_path, count(*) AS n FROM sensor_events GROUP BY source, file_path)
GROUP BY ROLLUP (source)"""
)
def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Files and events per source and overall."""
    files = sensor_events(spark, folder).groupBy("source", "file_path").agg(F.count(F.lit(1)).alias("events"))
    return export.run_totals(files)


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + """
SELECT position AS event_id, source, speed_val, flow_val, NULL::DOUBLE AS lat FROM sensor_events
UNION ALL SELECT position, source, speed_val, NULL, flow_val FROM sensor_events"""
)
def union_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections with different columns below one another."""
    rows = sensor_events(spark, folder).withColumnRenamed("position", "event_id")
    first = rows.select("event_id", "source", "speed_val", "flow_val")
    second = rows.select("source", "event_id", F.col("flow_val").alias("lat"), "speed_val")
    return export.union_sections([first, second])
