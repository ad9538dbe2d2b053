"""Project documents: one JSON object with nodes, edges and data sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefuse.functions.text import known_association
from kinefuse.schemas import EDGE, NODE, SOURCE

# In a document a shape is a list of [x, y] lists.
_EDGE_TEXT = T.StructType(
    [f if f.name != "shape" else T.StructField("shape", T.ArrayType(T.ArrayType(T.DoubleType()))) for f in EDGE]
)
DOCUMENT = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("edges", T.ArrayType(_EDGE_TEXT)),
        T.StructField("data_sources", T.ArrayType(SOURCE)),
    ]
)


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """The document as one row; a folder of documents gives one row each."""
    return spark.read.schema(DOCUMENT).option("multiLine", "true").json(path)


def project_nodes(document: DataFrame) -> DataFrame:
    nodes = document.select(F.inline("nodes"))
    return nodes.withColumn("node_type", F.coalesce("node_type", F.lit("unknown")))


def project_edges(document: DataFrame) -> DataFrame:
    points = F.transform("shape", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    edges = document.select(F.inline("edges"))
    return edges.withColumn("shape", F.coalesce(points, F.array().cast("array<struct<x:double,y:double>>")))


def project_sources(document: DataFrame) -> DataFrame:
    """Data sources of a document. An unknown association type reads as UNASSOCIATED."""
    sources = document.select(F.posexplode("data_sources").alias("seq", "source")).select("seq", "source.*")
    return sources.withColumn("association_type", known_association(F.col("association_type")))
