"""The road network: XML elements, pairs, names, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.operators import network as net
from kinefuse.sources import network as xml
from kinefuse.sources import project
from kinefuse.storage import new_path
from kinefuse.workloads.registry import query, table
from kinefuse.workloads.standins import SQL_ROADS, roads, with_sql


# Edges in one map file; it bounds what one group holds.
EDGES_PER_MAP = 500


def _key() -> Column:
    return F.col("s_suppkey").cast("string")


def _junctions(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.get(
        F.array(F.lit(' type="internal"'), F.lit(""), F.lit(' type="priority"')), (F.col("s_suppkey") % 3).cast("int")
    )
    x = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit(' x="'), F.col("s_acctbal").cast("string"), F.lit('"')))
    document = F.concat(F.lit('<junction id="j'), _key(), F.lit('"'), kind, x, F.lit(' y="'), _key(), F.lit('.5"/>'))
    parsed = F.from_xml(document, xml.JUNCTION_XML)
    return table(spark, folder, "supplier").select(parsed.alias("element")).select("element.*")


def _edge_texts(spark: SparkSession, folder: str) -> DataFrame:
    """XML of edges with three lanes: the first one empty, unreadable or good by key."""
    turn = F.col("s_suppkey") % 4
    function = F.when(F.col("s_suppkey") % 7 == 0, ' function="internal"').when(
        F.col("s_suppkey") % 7 == 1, ' function="connector"'
    ).otherwise("")
    to = F.when(F.col("s_suppkey") % 11 == 0, "").otherwise(' to="b"')
    first = F.when(turn == 0, "").when(turn == 1, ' shape="1,2 x,4"').when(turn == 2, ' shape="9,8,7 6,5,4 3,2,1"').otherwise("")
    second = F.when(turn == 3, "").otherwise(F.concat(F.lit(' shape="'), _key(), F.lit(',2.5 3,4"')))
    document = F.concat(
        F.lit('<edge id="e'), _key(), F.lit('" from="a"'), to, function, F.lit("><lane"), first, F.lit("/><lane"),
        second, F.lit("/></edge>"),
    )
    return table(spark, folder, "supplier").select("s_suppkey", document.alias("value"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.from_xml("value", xml.EDGE_XML)
    return _edge_texts(spark, folder).select(parsed.alias("element")).select("element.*")


@query(
    """
SELECT 'j' || s_suppkey AS id, s_acctbal AS x, s_suppkey + 0.5::DOUBLE AS y,
       CASE s_suppkey % 3 WHEN 1 THEN 'unknown' ELSE 'priority' END AS node_type
FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0"""
)
def road_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Junctions to nodes."""
    return xml.road_nodes(_junctions(spark, folder)).drop("real_name")


_SQL_KEPT_EDGES = "s_suppkey % 4 <> 3 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0"


@query(
    f"""
SELECT 'e' || s_suppkey AS id, 'a' AS from_node, 'b' AS to_node, CAST(CASE s_suppkey % 4 WHEN 2 THEN 3 ELSE 2 END AS INTEGER) AS points
FROM supplier WHERE {_SQL_KEPT_EDGES}"""
)
def road_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with their ends; internal, incomplete and shapeless ones are left out."""
    return xml.road_edges(_edges(spark, folder)).select("id", "from_node", "to_node", F.size("shape").alias("points"))


@query(
    f"""
SELECT 'e' || s_suppkey AS id, CAST(CASE s_suppkey % 4 WHEN 2 THEN 3 ELSE 2 END AS INTEGER) AS points
FROM supplier WHERE {_SQL_KEPT_EDGES}"""
)
def gzip_map(spark: SparkSession, folder: str) -> DataFrame:
    """Edges out of compressed map files that are written from the suppliers and read back."""
    path = new_path(spark, "map")
    files = _edge_texts(spark, folder).groupBy(F.floor(F.col("s_suppkey") / EDGES_PER_MAP)).agg(F.collect_list("value").alias("edges"))
    text = F.concat(F.lit("<net>"), F.array_join("edges", "\n"), F.lit("</net>")).alias("value")
    files.select(text).write.options(compression="gzip", maxRecordsPerFile=1).text(path)
    return xml.read_edges(spark, path).select("id", F.size("shape").alias("points"))


@query(
    f"""
SELECT 'e' || s_suppkey AS id, p.place AS place,
       CASE WHEN s_suppkey % 4 = 2 THEN [9.0, 6.0, 3.0][p.place + 1] ELSE [CAST(s_suppkey AS DOUBLE), 3.0][p.place + 1] END::DOUBLE AS x,
       CASE WHEN s_suppkey % 4 = 2 THEN [8.0, 5.0, 2.0][p.place + 1] ELSE [2.5, 4.0][p.place + 1] END::DOUBLE AS y
FROM supplier, (VALUES (0::INTEGER), (1), (2)) p(place)
WHERE {_SQL_KEPT_EDGES} AND (p.place < 2 OR s_suppkey % 4 = 2)"""
)
def edge_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """Points of the first readable lane, without z."""
    edges = xml.road_edges(_edges(spark, folder))
    return edges.select("id", F.posexplode("shape").alias("place", "point")).select("id", "place", "point.x", "point.y")


@query(
    with_sql(SQL_ROADS)
    + """
SELECT r.id, p.id AS pair_id FROM roads r LEFT JOIN roads p
  ON p.id = CASE WHEN starts_with(r.id, '-') THEN substr(r.id, 2) ELSE '-' || r.id END"""
)
def edge_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each edge with its opposite direction."""
    return net.edge_pairs(roads(spark, folder))


# Orders in the role of sources: they sit on the edge of their customer, either direction.
_ELEMENT = "CASE WHEN o_orderstatus = 'F' THEN concat('-', CAST(o_custkey AS STRING)) WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS STRING) END"


@query(
    with_sql(SQL_ROADS)
    + f"""
, used AS (SELECT DISTINCT {_ELEMENT.replace('STRING', 'VARCHAR')} AS element FROM orders)
SELECT r.id, r.id IN (SELECT element FROM used WHERE element IS NOT NULL)
   OR coalesce(p.id IN (SELECT element FROM used WHERE element IS NOT NULL), FALSE) AS is_associated
FROM roads r LEFT JOIN roads p ON p.id = CASE WHEN starts_with(r.id, '-') THEN substr(r.id, 2) ELSE '-' || r.id END"""
)
def road_status(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that have a source in either direction."""
    sources = table(spark, folder, "orders").select(
        F.expr(_ELEMENT).alias("associated_element_id")
    )
    return net.road_status(roads(spark, folder), sources)


_NEW_NAME = "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Road ', CAST(o_orderkey AS STRING)) END"


@query(
    with_sql(SQL_ROADS)
    + f"""
, renames AS (SELECT {_ELEMENT.replace('STRING', 'VARCHAR')} AS element_id, {_NEW_NAME.replace('STRING', 'VARCHAR')} AS new_name, o_orderkey AS seq FROM orders),
targets AS (
  SELECT element_id AS id, new_name, seq FROM renames WHERE element_id IN (SELECT id FROM roads)
  UNION ALL
  SELECT CASE WHEN starts_with(element_id, '-') THEN substr(element_id, 2) ELSE '-' || element_id END, new_name, seq
  FROM renames WHERE element_id IN (SELECT id FROM roads)
), latest AS (SELECT id, arg_max(new_name, seq) AS new_name FROM targets GROUP BY id)
SELECT r.id, CASE WHEN l.id IS NULL THEN r.real_name WHEN l.new_name <> '' THEN l.new_name END AS real_name
FROM roads r LEFT JOIN latest l ON r.id = l.id"""
)
def rename_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Renames reach both directions of a road; the last one wins, an empty name clears."""
    renames = table(spark, folder, "orders").select(
        F.expr(_ELEMENT).alias("element_id"), F.expr(_NEW_NAME).alias("real_name"), F.col("o_orderkey").alias("seq")
    )
    return net.rename_edges(roads(spark, folder), renames)


@query(with_sql(SQL_ROADS) + "\nSELECT id AS sumo_id, real_name FROM roads WHERE real_name <> ''")
def named_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements that have a name."""
    return net.named_elements(roads(spark, folder))


@query(
    """
SELECT p_partkey AS id, 'edge' AS kind FROM part WHERE p_size % 4 >= 2
UNION ALL
SELECT p_partkey, 'node' FROM part WHERE p_type IS DISTINCT FROM 'ECONOMY'"""
)
def drawable_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with two points or more, nodes that are not internal."""
    parts = table(spark, folder, "part")
    size = (F.col("p_size") % 4).cast("int")
    points = F.when(size > 0, F.array_repeat(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), size))
    edges = parts.select(F.col("p_partkey").alias("id"), points.alias("shape"))
    nodes = parts.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_type") == "ECONOMY", "internal").otherwise(F.col("p_type")).alias("node_type"),
    )
    return net.drawable_edges(edges).select("id", F.lit("edge").alias("kind")).unionByName(
        net.drawable_nodes(nodes).select("id", F.lit("node").alias("kind"))
    )


@query(
    """
SELECT s_name AS path, 'source' AS kind, CASE s_suppkey % 3 WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'LOCAL' ELSE 'UNASSOCIATED' END AS detail, 0.0::DOUBLE AS x FROM supplier
UNION ALL SELECT s_name, 'node', 'unknown', s_acctbal FROM supplier
UNION ALL SELECT s_name, 'edge', 'n>m', s_acctbal FROM supplier"""
)
def project_load(spark: SparkSession, folder: str) -> DataFrame:
    """Project documents to nodes, edges and sources."""
    name = F.col("s_name")
    types = F.get(F.array(F.lit("GLOBAL"), F.lit("LOCAL"), F.lit("SOMEWHERE")), (F.col("s_suppkey") % 3).cast("int"))
    balance = F.col("s_acctbal").cast("string")
    text = F.concat(
        F.lit('{"nodes":[{"id":"'), name, F.lit('","x":'), balance, F.lit(',"y":2}],"edges":[{"id":"'), name,
        F.lit('","from_node":"n","to_node":"m","shape":[['), balance, F.lit(',1],[2,3]],"real_name":null}],"data_sources":[{"path":"'),
        name, F.lit('","name":"n","file_types":["CSV"],"id":"s1","parser_id":null,"association_type":"'), types,
        F.lit('","associated_element_id":null}]}'),
    )
    documents = table(spark, folder, "supplier").select(F.from_json(text, project.DOCUMENT).alias("d")).select("d.*")
    sources = project.project_sources(documents)
    nodes, edges = project.project_nodes(documents), project.project_edges(documents)
    return (
        sources.select("path", F.lit("source").alias("kind"), F.col("association_type").alias("detail"), F.lit(0.0).alias("x"))
        .unionByName(nodes.select(F.col("id").alias("path"), F.lit("node").alias("kind"), F.col("node_type").alias("detail"), "x"))
        .unionByName(
            edges.select(
                F.col("id").alias("path"), F.lit("edge").alias("kind"),
                F.concat("from_node", F.lit(">"), "to_node").alias("detail"), F.get("shape", F.lit(0))["x"].alias("x"),
            )
        )
    )
