"""Road networks from XML: junctions, edges, geometry. Compressed maps are read as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.functions.numbers import text_to_number

JUNCTION_XML = "_id string, _type string, _x string, _y string"
EDGE_XML = "_id string, _from string, _to string, _function string, lane array<struct<_shape:string>>"


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def road_nodes(junctions: DataFrame) -> DataFrame:
    """Junction attributes to nodes; internal ones and those without id or position are left out."""
    return junctions.filter(~F.col("_type").eqNullSafe("internal")).select(
        F.col("_id").alias("id"),
        text_to_number(F.col("_x")).alias("x"),
        text_to_number(F.col("_y")).alias("y"),
        F.coalesce("_type", F.lit("unknown")).alias("node_type"),
        F.lit(None).cast("string").alias("real_name"),
    ).filter("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")


def shape_points(shape: Column) -> Column:
    """`x,y[,z] x,y[,z] …` to points without z; null when a point cannot be read."""

    def point(text: Column) -> Column:
        parts = F.split(text, ",")
        return F.struct(
            text_to_number(F.get(parts, F.lit(0))).alias("x"),
            text_to_number(F.get(parts, F.lit(1))).alias("y"),
        )

    points = F.transform(F.split(shape, " "), point)
    readable = F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when((shape != "") & readable, points)


def edge_geometry(lanes: Column) -> Column:
    """Points of the first lane that has a readable shape."""
    shapes = F.transform(lanes, lambda lane: shape_points(lane["_shape"]))
    return F.get(F.filter(shapes, lambda s: s.isNotNull()), F.lit(0))


def road_edges(edges: DataFrame) -> DataFrame:
    """Edge attributes and lanes to edges; internal, incomplete and shapeless ones are left out."""
    return edges.filter(~F.col("_function").eqNullSafe("internal")).select(
        F.col("_id").alias("id"),
        F.col("_from").alias("from_node"),
        F.col("_to").alias("to_node"),
        edge_geometry(F.col("lane")).alias("shape"),
        F.lit(None).cast("string").alias("real_name"),
    ).filter("id IS NOT NULL AND from_node IS NOT NULL AND to_node IS NOT NULL AND shape IS NOT NULL")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return road_nodes(_elements(spark, path, "junction", JUNCTION_XML))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return road_edges(_elements(spark, path, "edge", EDGE_XML))
