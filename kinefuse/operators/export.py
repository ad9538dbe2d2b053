"""Stored sections to the delivered dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefuse.functions.numbers import round_hundredths, round_whole, text_to_number
from kinefuse.functions.payload import section_fields
from kinefuse.functions.text import base_name, section_name
from kinefuse.functions.times import mixed_time
from kinefuse.operators.associations import assign_location, sensor_lookup
from kinefuse.schemas import KINEMATIC_FIELDS, UNIFIED_COLUMNS

TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def payload_json(names: tuple[str, ...] = KINEMATIC_FIELDS) -> Column:
    """Payload columns as JSON text; null fields are kept."""
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def section_rows(kinematics: DataFrame) -> DataFrame:
    """Kinematic rows in the form the sections store: text time, JSON payload, file reference."""
    return kinematics.select(
        section_name(F.col("source")).alias("section"),
        F.date_format("event_timestamp", TIME_TEXT).alias("event_timestamp"),
        "sensor_id",
        payload_json().alias("data_payload"),
        base_name(F.col("file_path")).alias("raw_file_reference"),
    )


def unpack_section(rows: DataFrame) -> DataFrame:
    """Stored rows to times and kinematic fields; unreadable payloads give nulls."""
    fields = [*KINEMATIC_FIELDS, "location_text_raw"]
    opened = rows.withColumn("payload", section_fields(F.col("data_payload")))
    value = {f: F.try_element_at(F.col("payload"), F.lit(f)) for f in fields}
    return opened.select(
        F.col("section").alias("source_table"),
        mixed_time(F.col("event_timestamp")).alias("event_timestamp"),
        "sensor_id",
        *[text_to_number(value[f]).alias(f) for f in KINEMATIC_FIELDS],
        value["location_text_raw"].alias("location_text_raw"),
    )


def export_rounding(df: DataFrame) -> DataFrame:
    """Speed to whole numbers, flow and intensity to two digits, infinities to null."""
    return df.withColumns(
        {
            "speed_val": round_whole(F.col("speed_val")),
            "flow_val": round_hundredths(F.col("flow_val")),
            "intensity_val": round_hundredths(F.col("intensity_val")),
        }
    )


def unified_rows(sections: DataFrame, lookup: DataFrame) -> DataFrame:
    """Stored rows to the eleven delivered columns, not yet sorted."""
    rounded = export_rounding(unpack_section(sections))
    return assign_location(sensor_lookup(rounded, lookup)).select(*UNIFIED_COLUMNS)


def union_sections(sections: list[DataFrame]) -> DataFrame:
    """Sections below one another, columns by name; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sections)


def sort_by_time(df: DataFrame) -> DataFrame:
    """By event time, nulls last.

    The other columns break ties, so rows with one time (or none) still spread over many partitions.
    """
    rest = [c for c in ("sensor_id", "source_table", "lat", "lon", *("speed_val", "flow_val")) if c in df.columns]
    return df.orderBy(F.col("event_timestamp").asc_nulls_last(), *rest)


def section_list(rows: DataFrame) -> DataFrame:
    """Names of the sections present."""
    return rows.select("section").filter(F.col("section").like("section_%")).distinct()


def file_counts(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files (source_path, source, file_path) with the number of rows each gave, zero included."""
    keys = ["source_path", "file_path"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
    return files.join(counts, keys, "left").withColumn("events", F.coalesce("events", F.lit(0)))


def run_totals(files: DataFrame) -> DataFrame:
    """Files and events per source, and overall where `source` is null."""
    return files.rollup("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum("events").alias("events")
    )
