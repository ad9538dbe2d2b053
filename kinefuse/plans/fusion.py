"""Sensor folders and a road network to one dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.operators.associations import association_names, sensor_map
from kinefuse.operators.export import unified_rows, union_sections
from kinefuse.operators.network import named_elements
from kinefuse.operators.physics import kinematics, unmapped_kinematics
from kinefuse.operators.resolution import resolve_on_row
from kinefuse.operators.roles import column_profile, discover_roles, scrub_map
from kinefuse.schemas import KINEMATIC_ROW, ROLES
from kinefuse.sinks.landing import write_raw_landing
from kinefuse.sinks.tables import write_sections, write_unified
from kinefuse.sources.chunks import landing_chunks, list_all_files
from kinefuse.sources.extract import column_values, events_of, explode_records
from kinefuse.sources.files import plain_path, sample_paths, with_owner
from kinefuse.sources.sections import read_sections
from kinefuse.sources.splits import read_parsed
from kinefuse.storage import new_path, run_folder, write_and_read


def land_raw_files(spark: SparkSession, folders: list[str], path: str) -> None:
    """Append every file below the folders to the raw table, as bytes with fingerprint.

    Hidden and empty files are landed too. A file is a row, a large one as many rows as it has chunks.
    """
    listing = write_and_read(list_all_files(spark, folders).distinct(), "listing")
    chunks = landing_chunks(listing).withColumn("file_path", plain_path(F.col("file_path")))
    write_raw_landing(with_owner(chunks, folders), path)


def discover_maps(spark: SparkSession, sources: DataFrame, folders: list[str], listing: DataFrame | None = None) -> DataFrame:
    """Kinematic map per source path from the first file of each folder; no other file is opened."""
    paths = sample_paths(spark, folders, listing)
    source = F.col("source_path").alias("source")
    parsed = read_parsed(spark, folders, paths=paths, listing=listing)
    cells = column_values(parsed).select(source, "column", "value")
    associations = sources.select(plain_path(F.col("path")).alias("source"), "association_type")
    return scrub_map(discover_roles(column_profile(cells), associations))


def source_maps(sources: DataFrame, maps: DataFrame) -> DataFrame:
    """What a file needs to know about its source: association type and map, one small row each.

    Paths are compared without scheme and trailing slashes.
    Written, so that Spark knows its size and joins it without moving the files' text.
    """
    wanted = maps.select(plain_path(F.col("source")).alias("path"), *ROLES, F.lit(True).alias("mapped"))
    joined = sources.select(plain_path(F.col("path")).alias("path"), "association_type").join(wanted, "path", "left")
    return write_and_read(
        joined.select(
            F.col("path").alias("source_path"),
            "association_type",
            *ROLES,
            F.coalesce("mapped", F.lit(False)).alias("has_map"),
        ),
        "maps",
    )


def file_kinematics(parsed: DataFrame, maps: DataFrame) -> DataFrame:
    """Parsed files, whole or in pieces, to kinematic rows.

    Column resolution and event projection happen on the file's own rows, so the first
    shuffle carries one partial aggregate per piece and sensor.
    """
    return kinematics(explode_records(resolve_on_row(parsed.join(maps, "source_path"))))


def build_kinematics(
    spark: SparkSession, sources: DataFrame, folders: list[str], maps: DataFrame | None = None
) -> DataFrame:
    """All files below the folders to kinematic rows, with discovered maps unless some are given.

    A path may be written with or without `file:` and trailing slashes. Which folders have a map decides how they are read, so each file is opened once. That answer
    has one flag per folder the caller named.
    """
    named = list(dict.fromkeys(folders))
    listing = write_and_read(list_all_files(spark, named).distinct(), "listing")
    found = discover_maps(spark, sources, named, listing) if maps is None else maps
    known = source_maps(sources, found)
    flags = _flags(spark, known, named)
    parts: list[DataFrame] = []
    if any(flags.values()):
        parts.append(file_kinematics(read_parsed(spark, [f for f, mapped in flags.items() if mapped], listing=listing), known))
    if not all(flags.values()):
        parsed = read_parsed(spark, [f for f, mapped in flags.items() if not mapped], listing=listing)
        parts.append(unmapped_kinematics(events_of(parsed)))
    if not parts:
        return spark.createDataFrame([], KINEMATIC_ROW)
    return union_sections(parts)


def _flags(spark: SparkSession, known: DataFrame, folders: list[str]) -> dict[str, bool]:
    """Whether each listed folder has a map; a folder that is no source is an error."""
    listed = spark.createDataFrame([(f,) for f in folders], "folder string")
    rows = listed.join(known, plain_path(F.col("folder")) == F.col("source_path"), "left")
    flags = {row.folder: row.has_map for row in rows.select("folder", "has_map").collect()}
    if unknown := sorted(f for f, mapped in flags.items() if mapped is None):
        raise ValueError(f"folders without a source: {', '.join(unknown)}")
    return flags


def association_lookup(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """Sensor lookup from the sources and the named edges; written for its size, see `source_maps`."""
    associations = sources.select(
        F.col("name").alias("source_name"), "association_type", "associated_element_id", "seq"
    )
    return write_and_read(sensor_map(association_names(associations, named_elements(edges))), "lookup")


def build_unified(
    spark: SparkSession,
    sources: DataFrame,
    folders: list[str],
    edges: DataFrame,
    maps: DataFrame | None = None,
) -> DataFrame:
    """The delivered dataset, not yet sorted.

    `sources` needs path, name, association_type, associated_element_id and seq; `folders` are the
    source paths to read; `maps`, when given, have the source path as `source`. The sections are written on the way, so everything after them starts from files.
    """
    path = new_path(spark, "sections")
    write_sections(build_kinematics(spark, sources, folders, maps), path)
    return unified_rows(read_sections(spark, path), association_lookup(sources, edges))


def deliver(
    spark: SparkSession,
    sources: DataFrame,
    folders: list[str],
    edges: DataFrame,
    path: str,
    maps: DataFrame | None = None,
) -> None:
    """Write the dataset of `build_unified`, time-sorted, and remove what was stored on the way."""
    with run_folder(spark):
        write_unified(build_unified(spark, sources, folders, edges, maps), path)
