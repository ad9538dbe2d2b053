"""Traffic physics: speed, flow and intensity per event and per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefuse.functions.numbers import nan_to_null, safe_divide, text_to_number
from kinefuse.functions.payload import unmark, value_at
from kinefuse.schemas import KINEMATIC_FIELDS, MEASURES, ROLES

MILLIS_PER_HOUR = 3_600_000.0


def _own_nanos() -> Column:
    return F.unix_micros("event_timestamp") * 1000.0


def named_number(name: Column) -> Column:
    """Number in the `payload` column of that name, null when there is no such column.

    The event's own time and sensor count as columns; a time reads as nanoseconds since 1970.
    """
    return (
        F.when(name == "event_timestamp", _own_nanos())
        .when(name == "sensor_id", text_to_number(F.col("sensor_id")))
        .when(name.isNotNull(), text_to_number(F.try_element_at(F.col("payload"), name)))
    )


def path_text(path: Column) -> Column:
    """The same, as text, for a path of keys into the unflattened `record`."""
    return (
        F.when(path == F.array(F.lit("event_timestamp")), _own_nanos().cast("string"))
        .when(path == F.array(F.lit("sensor_id")), F.col("sensor_id"))
        .when(path.isNotNull(), unmark(value_at(F.col("record"), path)))
    )


def mask_global(association: Column, value: Column) -> Column:
    """Value, null for a GLOBAL source."""
    return F.when(F.upper(association) == "GLOBAL", None).otherwise(value)


def kinematic_projection(events: DataFrame) -> DataFrame:
    """Events with resolved role columns to per-event speed, flow, intensity and location.

    Role columns hold names of `payload` columns.
    """
    places = (*ROLES, "lat_col", "lon_col")
    return _project(events, {c: named_number(F.col(c)) for c in places})


def path_projection(events: DataFrame) -> DataFrame:
    """The same for role columns that hold paths into the unflattened `record`.

    The texts are columns of their own, so that each is looked up once and not once per use.
    """
    places = (*ROLES, "lat_col", "lon_col")
    read = events.withColumns({f"{c}_text": path_text(F.col(c)) for c in places})
    return _project(read, {c: text_to_number(F.col(f"{c}_text")) for c in places})


def _project(events: DataFrame, number: dict[str, Column]) -> DataFrame:
    """Speed comes from its own column or from distance over time, intensity from its own column or
    from occupancy. A GLOBAL source has no flow and intensity columns but keeps occupancy.
    """
    association = F.col("association_type")
    has_both = F.col("distance_col").isNotNull() & F.col("time_col").isNotNull()
    derived = F.when(has_both, safe_divide(number["distance_col"], number["time_col"]))
    has_intensity = mask_global(association, F.col("intensity_col")).isNotNull()
    return events.withColumns(
        {
            "speed_val": F.when(F.col("speed_col").isNotNull(), number["speed_col"]).otherwise(derived),
            "flow_val": mask_global(association, number["flow_col"]),
            "intensity_val": F.when(has_intensity, number["intensity_col"]).otherwise(
                number["occupancy_col"]
            ),
            "lat": number["lat_col"],
            "lon": number["lon_col"],
        }
    )


def space_mean_speed(speed: Column) -> Column:
    """Harmonic mean. Zero speeds count as vehicles but add nothing to the sum of 1/v."""
    count = F.count(speed)
    slowness = F.sum(F.try_divide(F.lit(1.0), speed))
    return F.when(count > 0, F.when(slowness > 0, count / slowness).otherwise(0.0))


def span_hours(time: Column) -> Column:
    """Hours between first and last event in whole milliseconds; 1.0 when there is no span."""
    millis = F.floor((F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 1000)
    return F.when(millis > 0, millis / MILLIS_PER_HOUR).otherwise(1.0)


def flow_rate(flow: Column, time: Column) -> Column:
    """Sum of the reported flows, or events per hour when none is reported."""
    return F.when(F.count(flow) > 0, F.sum(flow)).otherwise(F.count(F.lit(1)) / span_hours(time))


def traffic_intensity(intensity: Column, flow: Column, speed: Column) -> Column:
    """Mean of the reported intensities, or flow over speed when none is reported.

    `flow` and `speed` are the aggregates above.
    """
    derived = F.when(speed > 0, flow / speed).otherwise(0.0)
    return F.when(F.count(intensity) > 0, F.avg(intensity)).otherwise(derived)


def summarise(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: speed, flow, intensity, latest time, first location in row order.

    All aggregates combine before the shuffle, so a file or sensor of any size sends one row per task.
    """
    speed = space_mean_speed(F.col("speed_val"))
    flow = flow_rate(F.col("flow_val"), F.col("event_timestamp"))
    return events.groupBy(*keys).agg(
        F.max("event_timestamp").alias("event_timestamp"),
        speed.alias("speed_val"),
        flow.alias("flow_val"),
        traffic_intensity(F.col("intensity_val"), flow, speed).alias("intensity_val"),
        F.min_by("lat", "position").alias("lat"),
        F.min_by("lon", "position").alias("lon"),
    )


def pass_through(events: DataFrame) -> DataFrame:
    """Events of a source without a kinematic map: no aggregation, fields read by their own names."""
    return backfill(
        events.withColumns(
            {f: text_to_number(F.try_element_at(F.col("payload"), F.lit(f))) for f in KINEMATIC_FIELDS}
        )
    )


def backfill(df: DataFrame) -> DataFrame:
    """All five kinematic fields as doubles: null where the column is missing or NaN."""
    kinds = dict(df.dtypes)

    def field(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("double")
        if kinds[name] == "string":
            return text_to_number(F.col(name))
        return nan_to_null(F.col(name).cast("double"))

    return df.withColumns({name: field(name) for name in KINEMATIC_FIELDS})


def missing_measures(df: DataFrame) -> DataFrame:
    """Add the names of the measures a row lacks."""
    return df.withColumn(
        "missing", F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in MEASURES]))
    )


def missing_audit(df: DataFrame, key: str) -> DataFrame:
    """Per key: rows, rows that lack something, and how many lack each measure."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("speed_val").isNull()).alias("missing_speed"),
        F.count_if(F.col("flow_val").isNull()).alias("missing_flow"),
        F.count_if(F.col("intensity_val").isNull()).alias("missing_intensity"),
        F.count_if(
            F.col("speed_val").isNull() | F.col("flow_val").isNull() | F.col("intensity_val").isNull()
        ).alias("incomplete"),
    )


FILE_KEYS = ("source_path", "source", "file_path", "sensor_id")


def kinematics(events: DataFrame) -> DataFrame:
    """Event records with resolved paths to one row per file and sensor."""
    fields = (*FILE_KEYS, "event_timestamp", *KINEMATIC_FIELDS)
    projected = path_projection(events).select(*fields, "position")
    return summarise(projected, list(FILE_KEYS)).select(*fields)


def unmapped_kinematics(events: DataFrame) -> DataFrame:
    """The same columns for events of sources without a map, one row per event."""
    return pass_through(events).select(*FILE_KEYS, "event_timestamp", *KINEMATIC_FIELDS)
