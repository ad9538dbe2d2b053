"""Data sources and the map elements they belong to.

Interactive edits arrive as change tables and are applied in bulk. A `seq` column gives their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefuse.schemas import ASSOCIATION_TYPES

_TYPE = "association_type"
_ELEMENT = "associated_element_id"


def _set(sources: DataFrame, joined: DataFrame, association: Column, element: Column) -> DataFrame:
    return joined.withColumns({_TYPE: association, _ELEMENT: element}).select(*sources.columns)


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """One source per path, the first by `seq`; combines before the shuffle."""
    rest = [c for c in sources.columns if c not in ("path", "seq")]
    first = sources.groupBy("path").agg(F.min_by(F.struct("seq", *rest), "seq").alias("kept"))
    return first.select("path", "kept.*").select(*sources.columns)


def toggle_association(sources: DataFrame, toggles: DataFrame) -> DataFrame:
    """Flip GLOBAL and LOCAL once per row of `toggles` (path); anything else first turns GLOBAL.

    A toggled source loses its element.
    """
    counted = toggles.groupBy("path").agg(F.count(F.lit(1)).alias("flips"))
    joined = sources.join(counted, "path", "left")
    was_global = F.col(_TYPE) == "GLOBAL"
    ends_global = was_global == (F.col("flips") % 2 == 0)
    touched = F.col("flips").isNotNull()
    return _set(
        sources,
        joined,
        F.when(touched, F.when(ends_global, "GLOBAL").otherwise("LOCAL")).otherwise(F.col(_TYPE)),
        F.when(~touched, F.col(_ELEMENT)),
    )


def set_association(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Set types from `changes` (path, new_type, seq); the last valid one wins and clears the element."""
    valid = changes.withColumn("new_type", F.upper("new_type")).filter(
        F.col("new_type").isin(*ASSOCIATION_TYPES)
    )
    last = valid.groupBy("path").agg(F.max_by("new_type", "seq").alias("new_type"))
    joined = sources.join(last, "path", "left")
    return _set(
        sources,
        joined,
        F.coalesce("new_type", _TYPE),
        F.when(F.col("new_type").isNull(), F.col(_ELEMENT)),
    )


def associate_batch(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Attach free sources to elements from `requests` (path, element_id, seq), first request first.

    A source that has an element keeps it. The opposite direction of an edge is not attached.
    """
    first = requests.groupBy("path").agg(F.min_by("element_id", "seq").alias("element_id"))
    joined = sources.join(first, "path", "left")
    free = F.col(_ELEMENT).isNull() | (F.col(_ELEMENT) == "")
    takes = free & F.col("element_id").isNotNull()
    return _set(
        sources,
        joined,
        F.when(takes, "LOCAL").otherwise(F.col(_TYPE)),
        F.when(takes, F.col("element_id")).otherwise(F.col(_ELEMENT)),
    )


def element_sources(sources: DataFrame, elements: DataFrame) -> DataFrame:
    """Sources that sit exactly on the given elements (element_id)."""
    wanted = elements.select("element_id").distinct()
    return sources.join(wanted, F.col(_ELEMENT) == F.col("element_id"), "left_semi")


def available_sources(sources: DataFrame, element_id: str) -> DataFrame:
    """LOCAL sources that are free or already on this element."""
    return sources.filter(
        (F.col(_TYPE) == "LOCAL") & (F.col(_ELEMENT).isNull() | (F.col(_ELEMENT) == element_id))
    )


def assignment_diff(sources: DataFrame, elements: DataFrame, assignments: DataFrame) -> DataFrame:
    """What saving the wanted sources of each edited element adds and removes.

    `elements` (element_id) are the edited ones, `assignments` (element_id, path) their new sets.
    """
    current = sources.join(
        elements.select(F.col("element_id")).distinct(), F.col(_ELEMENT) == F.col("element_id")
    ).select("element_id", "path")
    wanted = assignments.select("element_id", "path").distinct()
    keys = ["element_id", "path"]
    added = wanted.join(current, keys, "left_anti").withColumn("change", F.lit("add"))
    removed = current.join(wanted, keys, "left_anti").withColumn("change", F.lit("remove"))
    return added.unionByName(removed)


def apply_assignments(sources: DataFrame, elements: DataFrame, assignments: DataFrame) -> DataFrame:
    """Sources after each edited element was saved once, in the order of `assignments.seq`.

    A wanted source moves to the element and becomes LOCAL unless it already was there; a source no
    edited element wants loses an edited element. The last wish for a source wins.
    """
    wishes = assignments.groupBy("path").agg(
        F.max_by("element_id", "seq").alias("new_element"),
        (F.min("element_id") == F.max("element_id")).alias("one_wish"),
    )
    edited = elements.select(F.col("element_id").alias("edited")).distinct()
    joined = sources.join(wishes, "path", "left").join(edited, F.col(_ELEMENT) == F.col("edited"), "left")
    wished = F.col("new_element").isNotNull()
    stays = F.col("one_wish") & F.col("new_element").eqNullSafe(F.col(_ELEMENT))
    return _set(
        sources,
        joined,
        F.when(wished & ~F.coalesce(stays, F.lit(False)), "LOCAL").otherwise(F.col(_TYPE)),
        F.when(wished, F.col("new_element")).when(F.col("edited").isNull(), F.col(_ELEMENT)),
    )


def delete_sources(sources: DataFrame, deleted: DataFrame) -> DataFrame:
    """Sources without the deleted ones (path)."""
    return sources.join(deleted.select("path"), "path", "left_anti")


def readiness(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: may the dataset be made? There are nodes, and every LOCAL source has an element."""
    node_count = nodes.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("open"))
    open_local = sources.agg(
        F.lit(0).cast("long").alias("n"),
        F.count_if((F.col(_TYPE) == "LOCAL") & F.col(_ELEMENT).isNull()).alias("open"),
    )
    return (
        node_count.unionByName(open_local)
        .agg(F.sum("n").alias("node_count"), F.sum("open").alias("open_local_sources"))
        .withColumn("is_ready", (F.col("node_count") > 0) & (F.col("open_local_sources") == 0))
    )


def association_names(associations: DataFrame, edge_metadata: DataFrame) -> DataFrame:
    """Associations with the name of their edge, null for free sources, nodes and unnamed edges."""
    return associations.join(
        edge_metadata.select(F.col("sumo_id"), "real_name"), F.col(_ELEMENT) == F.col("sumo_id"), "left"
    ).select(*associations.columns, "real_name")


def sensor_map(named: DataFrame) -> DataFrame:
    """Lookup by lower-case source name; of names that differ only in case the last by `seq` counts."""
    return named.groupBy(F.lower("source_name").alias("sensor_key")).agg(
        F.max_by(F.struct(_TYPE, _ELEMENT, "real_name"), "seq").alias("place")
    )


def sensor_lookup(events: DataFrame, lookup: DataFrame) -> DataFrame:
    """Origin and mapped place of each event's sensor; an unknown sensor is LOCAL without a place.

    `lookup` should be a written table (`storage.write_and_read`): with its size known, a small one
    is broadcast and the events stay where they are, a large one is joined by shuffle.
    """
    return events.join(lookup, F.lower("sensor_id") == F.col("sensor_key"), "left").select(
        *events.columns,
        F.coalesce(f"place.{_TYPE}", F.lit("LOCAL")).alias("origin_type"),
        F.col(f"place.{_ELEMENT}").alias("mapped_id"),
        F.col("place.real_name").alias("mapped_name"),
    )


def assign_location(events: DataFrame) -> DataFrame:
    """Element id and location text; a GLOBAL sensor has neither.

    Where the mapped name is missing or empty, the event's own `location_text_raw` is used.
    """
    is_global = F.col("origin_type") == "GLOBAL"
    own = F.col("location_text_raw") if "location_text_raw" in events.columns else F.lit(None).cast("string")
    text = F.coalesce(F.when(F.col("mapped_name") != "", F.col("mapped_name")), own)
    kept = [c for c in events.columns if c not in ("mapped_id", "mapped_name", "location_text_raw")]
    return events.select(
        *kept,
        F.when(~is_global, F.col("mapped_id")).alias("sumo_id"),
        F.when(~is_global, text).alias("location_text"),
    )
