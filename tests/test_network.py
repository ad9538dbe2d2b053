"""Road networks, project documents, names."""

import gzip
import json

from kinefuse.operators import network as n
from kinefuse.sources.network import read_edges, read_nodes
from kinefuse.sources.project import project_edges, project_nodes, project_sources, read_project

NET = """<?xml version="1.0"?>
<net>
  <edge id=":i" function="internal"><lane id="l" shape="0,0 1,1"/></edge>
  <edge id="e1" from="n1" to="n2"><lane id="a"/><lane id="b" shape="1,x 2,2"/><lane id="c" shape="3.25,-7.5 12.0,81.75"/><lane id="d" shape="0,0 9,9"/></edge>
  <edge id="-e1" from="n2" to="n1" function="normal"><lane shape="1,2,3 4,5,6 7,8,9"/></edge>
  <edge id="shapeless" from="n1" to="n2"><lane id="x"/></edge>
  <edge id="open" from="n1"><lane shape="0,0 1,1"/></edge>
  <edge id="point" from="n1" to="n2"><lane shape="5,6"/></edge>
  <edge id="gap" from="n1" to="n2"><lane shape="5,6  7,8"/></edge>
  <junction id="n1" type="priority" x="64.0" y="-2.5"/>
  <junction id="n2" x="1" y="2"/>
  <junction id=":in" type="internal" x="1" y="2"/>
  <junction id="n3" type="dead_end" x="1"/>
  <junction type="dead_end" x="1" y="1"/>
</net>
"""


def test_network_file(spark, tmp_path):
    plain, packed = tmp_path / "map.net.xml", tmp_path / "map.net.xml.gz"
    plain.write_text(NET)
    with gzip.open(packed, "wt") as target:
        target.write(NET)
    for path in (str(plain), str(packed)):
        nodes = {r.id: (r.x, r.y, r.node_type) for r in read_nodes(spark, path).collect()}
        assert nodes == {"n1": (64.0, -2.5, "priority"), "n2": (1.0, 2.0, "unknown")}
        edges = {r.id: (r.from_node, r.to_node, [tuple(p) for p in r.shape]) for r in read_edges(spark, path).collect()}
        assert edges == {
            "e1": ("n1", "n2", [(3.25, -7.5), (12.0, 81.75)]),
            "-e1": ("n2", "n1", [(1.0, 2.0), (4.0, 5.0), (7.0, 8.0)]),
            "point": ("n1", "n2", [(5.0, 6.0)]),
        }
    assert {r.id for r in n.drawable_edges(read_edges(spark, str(plain))).collect()} == {"e1", "-e1"}


IDS = ["e1", "-e1", "e2", "--e2", "-e2", "-e3", "e4", "--e5"]


def pair(edge):
    other = edge[1:] if edge.startswith("-") else "-" + edge
    return other if other in IDS else None


def test_pairs_and_status(spark):
    edges = spark.createDataFrame([(i, None) for i in IDS], "id string, real_name string")
    assert {r.id: r.pair_id for r in n.edge_pairs(edges).collect()} == {i: pair(i) for i in IDS}
    for used in (["e1"], ["-e2"], ["e2", "e3"], ["-e5", "e4", None], []):
        sources = spark.createDataFrame([(u,) for u in used], "associated_element_id string")
        have = {r.id: r.is_associated for r in n.road_status(edges, sources).collect()}
        assert have == {i: i in used or (pair(i) is not None and pair(i) in used) for i in IDS}, used


def test_renames(spark):
    edges = [(i, "old") for i in IDS]
    renames = [("e1", "A", 1), ("-e1", "B", 2), ("e4", "", 3), ("e3", "C", 4), ("-e2", None, 5), ("e2", "D", 4), ("--e5", "E", 6)]
    have = n.rename_edges(
        spark.createDataFrame(edges, "id string, real_name string"),
        spark.createDataFrame(renames, "element_id string, real_name string, seq long"),
    )
    names = dict(edges)
    for element, name, _ in sorted(renames, key=lambda r: r[2]):
        if element in names:
            for target in (element, pair(element)):
                if target:
                    names[target] = name or None
    assert {r.id: r.real_name for r in have.collect()} == names
    nodes = n.rename_nodes(
        spark.createDataFrame([("x", None), ("-x", None)], "id string, real_name string"),
        spark.createDataFrame([("x", "Square", 1)], "element_id string, real_name string, seq long"),
    )
    assert {r.id: r.real_name for r in nodes.collect()} == {"x": "Square", "-x": None}
    assert [tuple(r) for r in n.named_elements(have).orderBy("sumo_id").collect()] == sorted(
        (k, v) for k, v in names.items() if v
    )


def test_project(spark, tmp_path):
    document = {
        "nodes": [{"id": "n1", "x": 1.0, "y": 2.0, "node_type": "priority", "real_name": "Sq"}, {"id": "n2", "x": 0, "y": 0}],
        "edges": [{"id": "e1", "from_node": "n1", "to_node": "n2", "shape": [[1.0, 2.0], [3, 4]], "real_name": None}, {"id": "e2", "from_node": "a", "to_node": "b"}],
        "data_sources": [
            {"path": "/a", "name": "a", "file_types": ["CSV"], "id": "src_1", "parser_id": None, "association_type": "GLOBAL", "associated_element_id": None},
            {"path": "/b", "name": "b", "association_type": "sideways", "associated_element_id": "e1"},
        ],
    }
    path = tmp_path / "town.json"
    path.write_text(json.dumps(document, indent=2))
    read = read_project(spark, str(path))
    assert [(r.id, r.node_type, r.real_name) for r in project_nodes(read).collect()] == [("n1", "priority", "Sq"), ("n2", "unknown", None)]
    assert [(r.id, [tuple(p) for p in r.shape]) for r in project_edges(read).collect()] == [("e1", [(1, 2), (3, 4)]), ("e2", [])]
    assert [(r.seq, r.path, r.association_type, r.associated_element_id) for r in project_sources(read).collect()] == [
        (0, "/a", "GLOBAL", None),
        (1, "/b", "UNASSOCIATED", "e1"),
    ]
    path.write_text("{}")
    assert project_sources(read_project(spark, str(path))).count() == 0
