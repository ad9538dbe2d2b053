"""Road network operators: edge pairs, names, what can be drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinefuse.functions.text import pair_id


def edge_pairs(edges: DataFrame) -> DataFrame:
    """Each edge id with the id of its opposite direction, null when the network lacks it."""
    known = edges.select(F.col("id").alias("pair_id"))
    return edges.select("id", pair_id(F.col("id")).alias("wanted")).join(
        known, F.col("wanted") == F.col("pair_id"), "left"
    ).select("id", "pair_id")


def road_status(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether an edge or its opposite direction has a source.

    Every source on an edge marks that edge and each id whose opposite it is; the edges then look
    themselves up once.
    """
    known = edges.select("id")
    used = sources.select(F.col("associated_element_id").alias("id")).filter("id IS NOT NULL").distinct()
    edge = F.col("id")
    forward = F.when(edge.rlike(r"\A-(?!-)"), F.substr(edge, F.lit(2)))
    ids = F.array_compact(F.array(edge, F.concat(F.lit("-"), edge), forward))
    marked = used.join(known, "id", "left_semi").select(F.explode(ids).alias("id")).distinct()
    return known.join(marked.withColumn("found", F.lit(True)), "id", "left").select(
        "id", F.coalesce("found", F.lit(False)).alias("is_associated")
    )


def rename_edges(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """Apply renames (element_id, real_name, seq) to edges and their pairs; the last one wins.

    An empty name clears the name. A rename of an unknown edge changes nothing, its pair included.
    """
    known = renames.join(edges.select(F.col("id").alias("element_id")), "element_id", "left_semi")
    targets = known.withColumn("id", F.explode(F.array("element_id", pair_id(F.col("element_id")))))
    return _rename(edges, targets)


def rename_nodes(nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """Apply renames (element_id, real_name, seq) to nodes; the last one wins."""
    return _rename(nodes, renames.withColumnRenamed("element_id", "id"))


def _rename(elements: DataFrame, targets: DataFrame) -> DataFrame:
    last = targets.groupBy("id").agg(
        F.max_by(F.struct("real_name"), "seq").alias("change"),
    )
    name = F.col("change.real_name")
    return elements.join(last, "id", "left").withColumn(
        "real_name",
        F.when(F.col("change").isNull(), F.col("real_name")).otherwise(F.when(name != "", name)),
    ).select(*elements.columns)


def named_elements(elements: DataFrame) -> DataFrame:
    """Identifier and name of the elements that have a name."""
    return elements.filter(F.col("real_name") != "").select(F.col("id").alias("sumo_id"), "real_name")


def drawable_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.size("shape") >= 2)


def drawable_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("node_type").eqNullSafe("internal"))
