"""Folders: listing, types, registration, text."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from kinefuse.functions.text import base_name, file_extension, section_name
from kinefuse.sources import extract, files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in put+1%"
    (root / "radar" / "deep").mkdir(parents=True)
    (root / "loop").mkdir()
    (root / "radar" / "b.JSON").write_text('{"speed": 1}')
    (root / "radar" / "deep" / "a+x %.csv").write_bytes(b"speed\n\xff2\n")
    (root / "radar" / "town.net.xml").write_text("<net/>")
    with gzip.open(root / "loop" / "c.json.gz", "wt") as target:
        target.write('[{"speed": 3}]')
    (root / "loop" / "notes.txt").write_text("speed\n4")
    return root


def test_listing(spark, tree):
    listed = files.file_inventory(files.list_files(spark, [str(tree), str(tree / "missing")]))
    rows = {r.name: (r.extension, r.file_type, r.is_parsed, r.size_bytes) for r in listed.collect()}
    assert rows == {
        "b.JSON": (".json", "JSON", True, 12),
        "a+x %.csv": (".csv", "CSV", True, 9),
        "town.net.xml": (".xml", None, False, 6),
        "c.json.gz": (".gz", "JSON", True, os.path.getsize(tree / "loop" / "c.json.gz")),
        "notes.txt": (".txt", None, False, 7),
    }
    assert files.list_files(spark, [str(tree / "missing")]).count() == 0
    (tree / "radar" / "kind=x").mkdir()
    (tree / "radar" / "kind=x" / "y.csv").write_text("a")
    flat = files.list_files(spark, [str(tree / "radar")], recursive=False)
    assert {os.path.basename(r.path) for r in flat.collect()} == {"b.JSON", "town.net.xml"}


def test_registration(spark, tree):
    listing = files.folder_listing(files.list_files(spark, [str(tree)]))
    types = files.file_types(listing)
    assert {os.path.basename(r.folder): r.file_types for r in types.collect()} == {
        "radar": ["JSON"], "deep": ["CSV"], "loop": ["JSON"],
    }
    names = spark.createDataFrame(
        [("data.csv", "d"), ("info.JSON", "d"), ("map.net.xml", "d"), ("other.txt", "d"), ("x.xml", "e"), ("y.XLSX", "e"), ("z.net.xml.gz", "f")],
        "name string, folder string",
    )
    found = files.file_types(names)
    assert {r.folder: r.file_types for r in found.collect()} == {"d": ["CSV", "JSON"], "e": ["Excel", "XML"], "f": []}
    sources = files.register_sources(found.withColumn("association_type", F.lit("local")))
    assert {(r.path, r.name, r.association_type, r.associated_element_id) for r in sources.collect()} == {
        ("d", "d", "UNASSOCIATED", None), ("e", "e", "UNASSOCIATED", None),
    }


def test_text_and_owners(spark, tree):
    folders = [str(tree), str(tree / "radar") + "/", str(tree / "missing")]
    rows = files.read_text_files(spark, folders).collect()
    owned = sorted((r.source, os.path.basename(r.file_path), r.text) for r in rows)
    radar = [("radar", "a+x %.csv", "speed\n2\n"), ("radar", "b.JSON", '{"speed": 1}'), ("radar", "town.net.xml", "<net/>")]
    whole = [("in put+1%", n, t) for _, n, t in radar] + [("in put+1%", "c.json.gz", '[{"speed": 3}]'), ("in put+1%", "notes.txt", "speed\n4")]
    assert owned == sorted(radar + whole)
    assert all(r.file_path.startswith(str(tree)) for r in rows)
    sampled = files.sample_paths(spark, [str(tree / "radar"), str(tree / "loop"), str(tree / "missing")])
    assert sorted(sampled) == [str(tree / "loop" / "c.json.gz"), str(tree / "radar" / "b.JSON")]


def test_one_behaviour_at_every_split_size(spark, tmp_path):
    """Quoted line breaks, headers that return as rows, and JSON named .csv give the same events however files are packed into splits."""
    folder = tmp_path / "big"
    folder.mkdir()
    header = 'speed,"name, x",lat'
    lines = [f'{i},"v ""{i}""\nw",{i / 8}' if i % 3 else header for i in range(900)]
    (folder / "one.csv").write_text("\n\n" + header + "\n" + "\n".join(lines))
    (folder / "two.csv").write_text("a,b\r\n" + "".join(f"{i},{i}\r\n" for i in range(700)))
    (folder / "named.csv").write_text('[{"a": 1}, {"a": 2}]')

    def events():
        rows = extract.extract_events(files.read_text_files(spark, [str(folder)])).collect()
        return sorted((os.path.basename(r.file_path), r.position, sorted((k, v or "") for k, v in r.payload.items())) for r in rows)

    want = events()
    assert [x[0] for x in want].count("one.csv") == 900 and [x[0] for x in want].count("two.csv") == 700
    assert [x[2] for x in want if x[0] == "named.csv"] == [[("a", "1")], [("a", "2")]]
    assert [x[2] for x in want if x[0] == "one.csv"][1] == [("lat", "0.125"), ("name, x", 'v "1"\nw'), ("speed", "1")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert events() == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_names(spark):
    frame = spark.createDataFrame(
        [("Radar Principal", "/a/b.c/x.tar.GZ"), ("Ñandú-1", "/a/.hidden"), ("", "noext"), ("中(1)", "/d/f.txt/")], "n string, p string"
    )
    rows = frame.select(section_name(F.col("n")).alias("s"), base_name(F.col("p")).alias("b"), file_extension(base_name(F.col("p"))).alias("e")).collect()
    assert [r.s for r in rows] == ["section_radar_principal", "section_ñandú_1", None, "section_中_1_"]
    assert [r.b for r in rows] == ["x.tar.GZ", ".hidden", "noext", "f.txt"]
    assert [r.e for r in rows] == [".gz", "", "", ".txt"]
