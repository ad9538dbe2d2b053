"""Column roles: which column of a source carries which traffic variable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefuse.functions.numbers import text_to_number
from kinefuse.functions.payload import key_paths
from kinefuse.functions.responses import response_fields
from kinefuse.functions.text import null_words_to_null, strip
from kinefuse.schemas import ROLES
from kinefuse.sources.extract import json_records

# Names that point to a role.
ROLE_WORDS = {
    "speed_col": ("speed", "velocity", "speedKMH", "currentSpeed", "averageSpeed", "estimated_speed_kmh"),
    "flow_col": (
        "flow",
        "volume",
        "count",
        "flow_rate",
        "q",
        "vehicle_count",
        "detected_vehicle_count",
        "nVehContrib",
    ),
    "intensity_col": ("density", "k", "jam_severity", "level", "congestion", "intensity"),
    "distance_col": ("distance", "length"),
    "time_col": ("time", "duration"),
    "occupancy_col": ("occupancy", "occ", "occupancy_pct"),
}

# Words this short, and "time" (part of every timestamp's name), count only as the whole name.
_PART_FROM = 4
_WHOLE_ONLY = ("time",)

CONFIDENCE = 0.99


def source_key_paths(files: DataFrame) -> DataFrame:
    """Distinct sorted paths per source from files (source, json_text)."""
    paths = files.select("source", F.explode_outer(key_paths(F.col("json_text"))).alias("path"))
    return paths.groupBy("source").agg(F.array_sort(F.collect_set("path")).alias("paths"))


# A JSON document that is no array and no object.
_SCALAR = r'(?s)\A[ \t\r\n]*(?:-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|"(?:[^"\\]++|\\.)*+")[ \t\r\n]*\z'


def available_columns(text: Column) -> Column:
    """The columns of a document as one list: sorted paths of a JSON document, the first line of another text if it has a comma.

    JSON without objects has an empty list; a text without a comma in its first line has none.
    """
    first = strip(F.substring_index(text, "\n", 1))
    listed = F.array_join(F.array_sort(F.array_distinct(key_paths(text))), ", ")
    is_json = json_records(text).isNotNull() | text.rlike(_SCALAR)
    return F.when(is_json, listed).when(F.contains(first, F.lit(",")), first)


def column_profile(cells: DataFrame) -> DataFrame:
    """Per source and column, from (source, column, value): numeric values, and how many are not zero."""
    number = text_to_number(F.col("value"))
    return cells.groupBy("source", "column").agg(
        F.count(number).alias("numbers"), F.count_if(number != 0).alias("nonzero")
    )


def payload_cells(events: DataFrame) -> DataFrame:
    """Events (source, payload) to one row per payload entry."""
    return events.select("source", F.explode_outer("payload").alias("column", "value")).filter(
        F.col("column").isNotNull()
    )


def word_match(column: Column, role: str) -> Column:
    """2 when the last part of the name is one of the role's words, 1 when it contains one, else 0."""
    base = F.lower(F.substring_index(column, ".", -1))
    words = sorted({w.lower() for w in ROLE_WORDS[role]})
    parts = [w for w in words if len(w) >= _PART_FROM and w not in _WHOLE_ONLY]
    contains = reduce(lambda a, b: a | b, [F.contains(base, F.lit(w)) for w in parts], F.lit(False))
    return F.when(base.isin(words), 2).when(contains, 1).otherwise(0)


def discover_roles(profile: DataFrame, associations: DataFrame) -> DataFrame:
    """Kinematic map per source from its column profile and association type.

    Among the columns whose name points to a role, one with data other than zero beats an empty
    template, the whole word beats a part, and the name decides ties. A speed column rules out
    distance and time, an intensity column rules out occupancy; a GLOBAL source gets speed only.
    A source whose sample shows nothing gets a map without columns. The choice is a minimum per
    source, so it combines before the shuffle.
    """

    def best(role: str) -> Column:
        match = word_match(F.col("column"), role)
        rank = F.struct(
            F.when(F.col("nonzero") > 0, 0).otherwise(1).alias("template"),
            (2 - match).alias("fit"),
            F.col("column"),
        )
        return F.min(F.when((match > 0) & (F.col("numbers") > 0), rank))["column"].alias(role)

    chosen = profile.groupBy("source").agg(*[best(role) for role in ROLES])
    typed = associations.select("source", "association_type").join(chosen, "source", "left")
    is_global = F.upper("association_type") == "GLOBAL"
    has_speed = F.col("speed_col").isNotNull()
    ingredients = F.col("distance_col").isNotNull() & F.col("time_col").isNotNull() & ~has_speed

    def unless(condition: Column, role: str) -> Column:
        return F.when(~condition, F.col(role))

    return typed.select(
        "source",
        "speed_col",
        unless(is_global, "flow_col").alias("flow_col"),
        unless(is_global, "intensity_col").alias("intensity_col"),
        F.when(ingredients, F.col("distance_col")).alias("distance_col"),
        F.when(ingredients, F.col("time_col")).alias("time_col"),
        unless(is_global | F.col("intensity_col").isNotNull(), "occupancy_col").alias("occupancy_col"),
        F.lit(CONFIDENCE).alias("confidence_score"),
    )


def maps_from_responses(responses: DataFrame) -> DataFrame:
    """Kinematic maps from model responses (source, text)."""
    read = responses.select("source", response_fields(F.col("text")).alias("fields"))
    found = {role: F.try_element_at("fields", F.lit(role)) for role in ROLES}
    return read.select(
        "source", *[found[role].alias(role) for role in ROLES], F.lit(CONFIDENCE).alias("confidence_score")
    )


def scrub_map(maps: DataFrame) -> DataFrame:
    """Null words in the role columns become null."""
    return maps.withColumns({role: null_words_to_null(F.col(role)) for role in ROLES})


def coverage_warnings(maps: DataFrame) -> DataFrame:
    """For LOCAL sources, which of the three variables the map cannot give."""
    local = F.col("association_type") == "LOCAL"
    no_speed = F.col("speed_col").isNull() & (F.col("distance_col").isNull() | F.col("time_col").isNull())
    no_intensity = F.col("intensity_col").isNull() & F.col("occupancy_col").isNull()
    return maps.withColumns(
        {
            "lacks_speed": local & no_speed,
            "lacks_intensity": local & no_intensity,
            "lacks_flow": local & F.col("flow_col").isNull(),
        }
    )
