"""Sinks and the whole job on a small folder tree."""

import datetime as dt
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from kinefuse.operators import export
from kinefuse.plans import fusion
from kinefuse.schemas import KINEMATIC_ROW, UNIFIED_COLUMNS
from kinefuse.sinks.landing import write_raw_landing
from kinefuse.sinks.tables import write_metadata, write_sections, write_unified
from kinefuse.sources import files
from kinefuse.sources.sections import read_sections

SOURCES = "path string, name string, association_type string, associated_element_id string, seq long"


@pytest.fixture
def city(tmp_path):
    """Four sources: JSON speeds, CSV occupancy, a GLOBAL feed, a folder that is missing."""
    for name in ("Radar A", "loop", "feed"):
        (tmp_path / name).mkdir()
    radar, loop, feed = tmp_path / "Radar A", tmp_path / "loop", tmp_path / "feed"
    (radar / "a.json").write_text(
        json.dumps([
            {"speed": 50, "time": 1600000000000, "geo": {"lat": None, "lon": "2.5"}},
            {"speed": 25, "time": 1600003600000, "geo": {"lat": 1.5, "lon": 3}},
            {"speed": 0, "time": 1600001800000},
        ])
    )
    # Another file of the source has its speed elsewhere; the map finds it by its last part.
    (radar / "b.json").write_text(json.dumps({"jams": [{"kin": {"Speed": "30.5"}, "date": "2024-01-01"}]}))
    (loop / "c.csv").write_text("vehicle_count,occ,length,duration\n5,0.5,100,10\n7,0.7,50,0\n")
    (feed / "d.json").write_text(json.dumps({"alerts": [{"velocity": 10, "count": 4, "occ": 0.2, "pubMillis": 1600000000000}]}))
    return tmp_path


def sources_of(spark, city):
    rows = [
        (str(city / "Radar A"), "Radar A", "LOCAL", "e1", 0),
        (str(city / "loop"), "loop", "LOCAL", None, 1),
        (str(city / "feed"), "feed", "GLOBAL", "e1", 2),
        (str(city / "gone"), "gone", "LOCAL", None, 3),
    ]
    return spark.createDataFrame(rows, SOURCES), [r[0] for r in rows]


def test_discovered_maps(spark, city):
    sources, folders = sources_of(spark, city)
    maps = {os.path.basename(r.source): r for r in fusion.discover_maps(spark, sources, folders).collect()}
    assert maps["Radar A"].speed_col == "speed"
    assert (maps["loop"].flow_col, maps["loop"].occupancy_col) == ("vehicle_count", "occ")
    assert (maps["loop"].distance_col, maps["loop"].time_col) == ("length", "duration")
    assert (maps["feed"].speed_col, maps["feed"].flow_col, maps["feed"].occupancy_col) == ("velocity", None, None)
    assert maps["gone"].speed_col is None


def test_whole_job(spark, city, tmp_path):
    sources, folders = sources_of(spark, city)
    edges = spark.createDataFrame([("e1", "Main St"), ("e2", None)], "id string, real_name string")
    unified = fusion.build_unified(spark, sources, folders, edges)
    assert unified.columns == list(UNIFIED_COLUMNS)
    target = str(tmp_path / "out.parquet")
    assert write_unified(unified, target)
    rows = spark.read.parquet(target).collect()
    assert len(rows) == 4
    a, b = sorted((r for r in rows if r.source_table == "section_radar_a"), key=lambda r: r.event_timestamp)
    # 3 events over one hour; the zero counts in N; the first row's latitude is null.
    assert (a.speed_val, a.flow_val, a.intensity_val, a.lat, a.lon) == (50, 3.0, 0.06, None, 2.5)
    assert a.event_timestamp == dt.datetime(2020, 9, 13, 13, 26, 40)
    assert (a.sensor_id, a.sumo_id, a.location_text, a.origin_type) == ("Radar A", "e1", "Main St", "LOCAL")
    # 30.5 rounds to the even neighbour, one event is one per hour.
    assert (b.speed_val, b.flow_val, b.intensity_val) == (30, 1.0, 0.03)
    (loop,) = (r for r in rows if r.source_table == "section_loop")
    assert (loop.speed_val, loop.flow_val, loop.intensity_val, loop.sumo_id) == (10, 12.0, 0.6, None)
    (feed,) = (r for r in rows if r.source_table == "section_feed")
    assert (feed.origin_type, feed.sumo_id, feed.location_text) == ("GLOBAL", None, None)
    assert (feed.speed_val, feed.flow_val, feed.intensity_val) == (10, 1.0, 0.1)


def test_given_and_missing_maps(spark, city):
    """A given map is used as it is; a source without one passes its events on one by one."""
    sources, folders = sources_of(spark, city)
    given = spark.createDataFrame(
        [(str(city / "loop"), None, "occ", "occ", None, None, None)],
        "source string, speed_col string, flow_col string, intensity_col string, distance_col string, time_col string, occupancy_col string",
    )
    rows = fusion.build_kinematics(spark, sources, folders, given).collect()
    assert sorted(r.source for r in rows) == ["Radar A"] * 4 + ["feed", "loop"]
    (loop,) = (r for r in rows if r.source == "loop")
    assert (loop.speed_val, loop.flow_val, loop.intensity_val) == (None, 1.2, 0.6)
    assert all(r.speed_val is None for r in rows)


def test_paths_in_any_spelling(spark, city):
    sources, folders = sources_of(spark, city)
    want = sorted(map(str, fusion.build_kinematics(spark, sources, folders).drop("event_timestamp").collect()))
    spelled = sources.withColumn("path", F.concat(F.lit("file://"), "path", F.lit("/")))
    have = fusion.build_kinematics(spark, spelled, [f + "//" for f in folders]).drop("event_timestamp").collect()
    assert sorted(map(str, have)) == want
    with pytest.raises(ValueError, match="without a source"):
        fusion.build_kinematics(spark, sources, [*folders, str(city)])


def test_delivery_leaves_nothing_behind(spark, city, tmp_path):
    sources, folders = sources_of(spark, city)
    edges = spark.createDataFrame([("e1", "First street")], "id string, real_name string")
    shared = os.path.join(spark.conf.get("spark.checkpoint.dir"), "kinefuse")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    fusion.deliver(spark, sources, folders, edges, str(tmp_path / "unified"))
    assert spark.read.parquet(str(tmp_path / "unified")).count() > 0
    assert set(os.listdir(shared)) == before


def test_last_of_repeated_keys_counts(spark, city):
    (city / "feed" / "d.json").write_text('[{"velocity": 1, "geo": {"lat": 1, "lat": 7}, "velocity": 20, "pubMillis": 1600000000000}]')
    sources, _ = sources_of(spark, city)
    (row,) = fusion.build_kinematics(spark, sources, [str(city / "feed")]).collect()
    assert row.speed_val == 20.0


def test_job_plan(spark, city):
    """Files are parsed once, small tables are broadcast, and only per-file aggregates are shuffled."""
    sources, folders = sources_of(spark, city)
    plan = fusion.build_kinematics(spark, sources, folders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
    assert plan.count("FileScan text") == 1


def test_sections_round_trip(spark, tmp_path):
    rows = [
        ("/s", "Source 1", "/s/d/a.csv", "Source 1", dt.datetime(2024, 1, 1, 0, 0, 0, 5), 50.0, None, 1.25, -23.5, None),
        ("/s", "Source 1", "/s/b.csv", "Source 1", None, None, None, None, None, None),
        ("/t", "other", "/t/c.csv", "other", dt.datetime(2024, 1, 2), 1.0, 2.0, 3.0, 4.0, 5.0),
    ]
    path = str(tmp_path / "sections")
    write_sections(spark.createDataFrame(rows, KINEMATIC_ROW), path)
    stored = read_sections(spark, path)
    assert {r.section for r in export.section_list(stored).collect()} == {"section_source_1", "section_other"}
    first = stored.filter("raw_file_reference = 'a.csv'").first()
    assert json.loads(first.data_payload) == {"speed_val": 50.0, "flow_val": None, "intensity_val": 1.25, "lat": -23.5, "lon": None}
    back = {(r.sensor_id, r.event_timestamp): r for r in export.unpack_section(stored).collect()}
    assert back[("Source 1", dt.datetime(2024, 1, 1, 0, 0, 0, 5))].speed_val == 50.0
    assert back[("Source 1", None)].lat is None
    pruned = stored.filter("section = 'section_other'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(section" in pruned


def test_stored_rows_of_other_making(spark):
    rows = [
        ("section_x", "2026-01-01T00:00:00Z", "sensor1", '{"speed_val": 50, "lat": -23.5, "id": 1}'),
        ("section_x", "never", "sensor1", "{broken"),
        ("section_x", "2026-01-01 03:00:00+03:00", "sensor1", '{"speed_val": "Infinity", "flow_val": 1.005, "location_text_raw": "by"}'),
    ]
    stored = spark.createDataFrame(rows, "section string, event_timestamp string, sensor_id string, data_payload string")
    got = export.export_rounding(export.unpack_section(stored)).collect()
    assert [r.event_timestamp for r in got] == [dt.datetime(2026, 1, 1), None, dt.datetime(2026, 1, 1)]
    assert [(r.speed_val, r.lat, r.location_text_raw) for r in got] == [(50, -23.5, None), (None, None, None), (None, None, "by")]
    assert got[2].flow_val == 1.0


def test_nothing_to_deliver(spark, tmp_path):
    empty = spark.createDataFrame([], "event_timestamp timestamp, sensor_id string")
    target = tmp_path / "none.parquet"
    assert not write_unified(empty, str(target)) and not target.exists()


def test_sorted_delivery(spark):
    rows = [(None, "b"), (dt.datetime(2024, 1, 2), "a"), (None, "a"), (dt.datetime(2024, 1, 1), "z")]
    got = export.sort_by_time(spark.createDataFrame(rows, "event_timestamp timestamp, sensor_id string")).collect()
    assert [r.sensor_id for r in got] == ["z", "a", "a", "b"]


def test_landing_and_metadata(spark, tmp_path):
    rows = [("s", "/s/a.CSV", bytearray(b"x,y\n")), ("s", "/s/b", bytearray(b""))]
    target = str(tmp_path / "raw")
    write_raw_landing(spark.createDataFrame(rows, "source string, file_path string, content binary"), target)
    landed = {r.filename: r for r in spark.read.parquet(target).collect()}
    assert landed["a.CSV"].file_hash == hashlib.md5(b"x,y\n").hexdigest()
    assert (landed["a.CSV"].file_extension, landed["a.CSV"].file_size_bytes) == (".csv", 4)
    assert (landed["b"].file_extension, landed["b"].raw_content) == ("", bytearray(b""))
    named = spark.createDataFrame([("n1", "Node 1"), ("n2", None), ("n3", "")], "id string, real_name string")
    associations = spark.createDataFrame([("s", "/s")], "source_name string, source_path string")
    for _ in range(2):
        write_metadata(named, named, associations, str(tmp_path / "meta"))
    for table in ("node_metadata", "edge_metadata"):
        assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "meta" / table)).collect()] == [("n1", "Node 1")]
    assert os.path.isdir(tmp_path / "meta" / "data_associations")


def test_two_sources_with_one_name(spark, tmp_path):
    """Same folder name, different paths: own maps, one shared section, no row twice."""
    folders = [str(tmp_path / part / "cam") for part in ("east", "west")]
    for folder, text in zip(folders, ("speed\n10\n", "velocity\n20\n")):
        os.makedirs(folder)
        with open(os.path.join(folder, "f.csv"), "w") as target:
            target.write(text)
    sources = spark.createDataFrame([(f, "cam", "LOCAL", None, i) for i, f in enumerate(folders)], SOURCES)
    edges = spark.createDataFrame([], "id string, real_name string")
    rows = fusion.build_unified(spark, sources, folders, edges).collect()
    assert sorted((r.speed_val, r.source_table) for r in rows) == [(10, "section_cam"), (20, "section_cam")]


def test_landed_folders_and_counts(spark, city, tmp_path):
    sources, folders = sources_of(spark, city)
    target = str(tmp_path / "raw")
    (city / "loop" / "_x").write_text("hidden")
    (city / "loop" / "none").write_text("")
    fusion.land_raw_files(spark, folders, target)
    assert {(r.filename, r.file_size_bytes, r.chunk) for r in spark.read.parquet(target).collect()} >= {("_x", 6, 0), ("none", 0, 0)}
    for name in ("_x", "none"):
        (city / "loop" / name).unlink()
    landed = {(r.source_id, r.filename) for r in spark.read.parquet(target).collect()}
    assert landed == {("Radar A", "a.json"), ("Radar A", "b.json"), ("loop", "c.csv"), ("feed", "d.json"), ("loop", "_x"), ("loop", "none")}
    (city / "loop" / "header.csv").write_text("a,b\n")
    listed = files.list_files(spark, folders).withColumnRenamed("path", "file_path")
    rows = fusion.build_kinematics(spark, sources, folders)
    totals = export.run_totals(export.file_counts(files.with_owner(listed, folders), rows))
    assert {(r.source, r.files, r.events) for r in totals.collect()} == {
        ("Radar A", 2, 2), ("loop", 2, 1), ("feed", 1, 1), (None, 5, 4),
    }


def test_run_totals(spark):
    totals = export.run_totals(spark.createDataFrame([("a", 3), ("a", 0), ("b", 5)], "source string, events long"))
    assert {(r.source, r.files, r.events) for r in totals.collect()} == {("a", 2, 3), ("b", 1, 5), (None, 3, 8)}


def test_union_of_different_sections(spark):
    one = spark.range(1).select(F.lit(1).alias("a"))
    two = spark.range(1).select(F.lit(2).alias("b"))
    assert {tuple(r) for r in export.union_sections([one, two]).collect()} == {(1, None), (None, 2)}
