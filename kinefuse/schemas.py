"""Column layouts shared by the sources, operators and sinks."""

from pyspark.sql import types as T

# The roles a sensor column can play.
ROLES = (
    "speed_col",
    "flow_col",
    "intensity_col",
    "distance_col",
    "time_col",
    "occupancy_col",
)

# What the physics step measures, and where.
MEASURES = ("speed_val", "flow_val", "intensity_val")
KINEMATIC_FIELDS = ("speed_val", "flow_val", "intensity_val", "lat", "lon")

# How a data source relates to the map.
ASSOCIATION_TYPES = ("UNASSOCIATED", "GLOBAL", "LOCAL")

# Columns of the delivered dataset, in order.
UNIFIED_COLUMNS = (
    "event_timestamp",
    "sensor_id",
    "sumo_id",
    "location_text",
    "lat",
    "lon",
    "origin_type",
    "speed_val",
    "flow_val",
    "intensity_val",
    "source_table",
)

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

NODE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("real_name", T.StringType()),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("from_node", T.StringType()),
        T.StructField("to_node", T.StringType()),
        T.StructField("shape", T.ArrayType(POINT)),
        T.StructField("real_name", T.StringType()),
    ]
)

SOURCE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("file_types", T.ArrayType(T.StringType())),
        T.StructField("parser_id", T.StringType()),
        T.StructField("association_type", T.StringType()),
        T.StructField("associated_element_id", T.StringType()),
    ]
)

KINEMATIC_MAP = T.StructType(
    [T.StructField("source", T.StringType())]
    + [T.StructField(role, T.StringType()) for role in ROLES]
    + [T.StructField("confidence_score", T.DoubleType())]
)

# One row per file and sensor (per event where a source has no map).
KINEMATIC_ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source_path", "source", "file_path", "sensor_id")]
    + [T.StructField("event_timestamp", T.TimestampType())]
    + [T.StructField(n, T.DoubleType()) for n in KINEMATIC_FIELDS]
)
