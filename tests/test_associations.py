"""Batches of edits against the same edits made one by one."""

import random

from kinefuse.operators import associations as a

SOURCE = "path string, name string, association_type string, associated_element_id string, seq long"
ELEMENTS = ["e1", "-e1", "e2", "n1", None]


def make_sources(rng, count=40):
    return [
        {
            "path": f"p{i}",
            "name": f"n{i}",
            "association_type": rng.choice(["GLOBAL", "LOCAL", "UNASSOCIATED"]),
            "associated_element_id": rng.choice(ELEMENTS),
            "seq": i,
        }
        for i in range(count)
    ]


def frame(spark, sources):
    return spark.createDataFrame([tuple(s.values()) for s in sources], SOURCE)


def state(df):
    return {r.path: (r.association_type, r.associated_element_id) for r in df.collect()}


def plain(sources):
    return {s["path"]: (s["association_type"], s["associated_element_id"]) for s in sources}


def test_toggles(spark):
    rng = random.Random(1)
    sources = make_sources(rng)
    toggles = [f"p{rng.randrange(50)}" for _ in range(90)]
    have = state(a.toggle_association(frame(spark, sources), spark.createDataFrame([(t,) for t in toggles], "path string")))
    for path in toggles:
        for s in sources:
            if s["path"] == path:
                s["association_type"] = "LOCAL" if s["association_type"] == "GLOBAL" else "GLOBAL"
                s["associated_element_id"] = None
    assert have == plain(sources)


def test_set_types(spark):
    rng = random.Random(2)
    sources = make_sources(rng)
    changes = [(f"p{rng.randrange(50)}", rng.choice(["global", "Local", "UNASSOCIATED", "other", ""]), i) for i in range(80)]
    have = state(a.set_association(frame(spark, sources), spark.createDataFrame(changes, "path string, new_type string, seq long")))
    for path, kind, _ in changes:
        for s in sources:
            if s["path"] == path and kind.upper() in ("GLOBAL", "LOCAL", "UNASSOCIATED"):
                s["association_type"], s["associated_element_id"] = kind.upper(), None
    assert have == plain(sources)


def test_associate(spark):
    rng = random.Random(3)
    sources = make_sources(rng)
    requests = [(f"p{rng.randrange(50)}", rng.choice(["e1", "e2", "e3"]), i) for i in range(60)]
    have = state(a.associate_batch(frame(spark, sources), spark.createDataFrame(requests, "path string, element_id string, seq long")))
    for path, element, _ in requests:
        for s in sources:
            if s["path"] == path and not s["associated_element_id"]:
                s["associated_element_id"], s["association_type"] = element, "LOCAL"
    assert have == plain(sources)


def test_assignments(spark):
    for seed in range(3):
        rng = random.Random(10 + seed)
        sources = make_sources(rng)
        order = ["e2", "e1", "n1", "e9"]
        wanted = {e: {f"p{rng.randrange(40)}" for _ in range(rng.randrange(12))} for e in order}
        elements = spark.createDataFrame([(e,) for e in order], "element_id string")
        wishes = spark.createDataFrame(
            [(e, p, i) for i, e in enumerate(order) for p in wanted[e]], "element_id string, path string, seq long"
        )
        before = frame(spark, sources)
        diff = {(r.element_id, r.path, r.change) for r in a.assignment_diff(before, elements, wishes).collect()}
        current = {e: {s["path"] for s in sources if s["associated_element_id"] == e} for e in order}
        assert diff == {(e, p, "add") for e in order for p in wanted[e] - current[e]} | {
            (e, p, "remove") for e in order for p in current[e] - wanted[e]
        }
        have = state(a.apply_assignments(before, elements, wishes))
        for element in order:
            now = {s["path"] for s in sources if s["associated_element_id"] == element}
            for s in sources:
                if s["path"] in now - wanted[element]:
                    s["associated_element_id"] = None
                elif s["path"] in wanted[element] - now:
                    s["associated_element_id"], s["association_type"] = element, "LOCAL"
        assert have == plain(sources)


def test_selections(spark):
    rng = random.Random(4)
    sources = make_sources(rng)
    df = frame(spark, sources)
    free = {r.path for r in a.available_sources(df, "e1").collect()}
    assert free == {s["path"] for s in sources if s["association_type"] == "LOCAL" and s["associated_element_id"] in (None, "e1")}
    on = {r.path for r in a.element_sources(df, spark.createDataFrame([("e1",), ("e1",)], "element_id string")).collect()}
    assert on == {s["path"] for s in sources if s["associated_element_id"] == "e1"}
    left = a.delete_sources(df, spark.createDataFrame([("p1",), ("p1",), ("px",)], "path string"))
    assert {r.path for r in left.collect()} == {s["path"] for s in sources} - {"p1"}
    twice = df.union(df.withColumn("seq", df.seq + 100))
    assert state(a.dedupe_sources(twice)) == plain(sources)


def test_readiness(spark):
    nodes = spark.createDataFrame([("n1",)], "id string")
    none = spark.createDataFrame([], "id string")
    open_local = frame(spark, [dict(path="p", name="n", association_type="LOCAL", associated_element_id=None, seq=1)])
    closed = frame(spark, [dict(path="p", name="n", association_type="LOCAL", associated_element_id="e", seq=1)])
    empty = spark.createDataFrame([], SOURCE)
    ready = [a.readiness(n, s).first().is_ready for n, s in ((nodes, closed), (nodes, open_local), (none, closed), (nodes, empty))]
    assert ready == [True, False, False, True]


def test_places(spark):
    associations = spark.createDataFrame(
        [("Sensor1", "LOCAL", "edge_1", 1), ("Node", "LOCAL", "n1", 2), ("sky", "GLOBAL", "edge_1", 3), ("SENSOR1", "LOCAL", "edge_2", 4)],
        "source_name string, association_type string, associated_element_id string, seq long",
    )
    names = spark.createDataFrame([("edge_1", "Main St"), ("edge_2", "")], "sumo_id string, real_name string")
    lookup = a.sensor_map(a.association_names(associations, names))
    events = spark.createDataFrame(
        [("sensor1", "raw"), ("NODE", None), ("Sky", "raw"), ("ghost", "raw")], "sensor_id string, location_text_raw string"
    )
    rows = a.assign_location(a.sensor_lookup(events, lookup)).collect()
    assert {r.sensor_id: (r.origin_type, r.sumo_id, r.location_text) for r in rows} == {
        "sensor1": ("LOCAL", "edge_2", "raw"),
        "NODE": ("LOCAL", "n1", None),
        "Sky": ("GLOBAL", None, None),
        "ghost": ("LOCAL", None, "raw"),
    }
