"""Stored sections: one table, partitioned by section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SECTION_ROW = (
    "event_timestamp string, sensor_id string, data_payload string, raw_file_reference string, section string"
)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """All sections; a filter on `section` reads only that folder."""
    return spark.read.schema(SECTION_ROW).parquet(path)
