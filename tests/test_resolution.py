"""Column resolution and roles."""

import random

from pyspark.sql import functions as F

from kinefuse.operators import resolution, roles
from kinefuse.schemas import ROLES


def resolve(wanted, columns):
    """The four tiers, one after the other."""
    if not wanted:
        return None
    want, low = wanted.lower(), [c.lower() for c in columns]
    base = want.split(".")[-1]
    tests = (
        lambda c: c == want,
        lambda c: want.endswith("." + c) or c.endswith("." + want),
        lambda c: c.split(".")[-1] == base,
        lambda c: base in c.split(".")[-1] or c.split(".")[-1] in base,
    )
    for test in tests:
        for name, c in zip(columns, low):
            if test(c):
                return name
    return None


def test_tiers(spark):
    cases = [
        ("Speed", ["x", "SPEED", "speed"], "SPEED"),
        ("a.speed", ["aspeed", "speed"], "speed"),
        ("speed", ["b.speeds", "x.y.speed"], "x.y.speed"),
        ("a.speed", ["b.speed"], "b.speed"),
        ("speed", ["b.avg_speed_kmh", "speedy"], "b.avg_speed_kmh"),
        ("vehicle_count", ["count"], "count"),
        ("speed", ["flow"], None),
        ("", ["a"], None),
        (None, ["a"], None),
    ]
    frame = spark.createDataFrame([(i, w, c) for i, (w, c, _) in enumerate(cases)], "i int, w string, c array<string>")
    rows = frame.select("i", resolution.resolve_in(F.col("c"), F.col("w")).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == [want for _, _, want in cases]
    assert [resolve(w, c) for w, c, _ in cases] == [want for _, _, want in cases]


def test_both_forms_against_plain_python(spark):
    rng = random.Random(3)
    parts = ["speed", "avg", "a", "Flow", "k", "lat", "x_lon", "sp", "count"]

    def name():
        return ".".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))

    maps, events, expected = [], [], {}
    for n in range(60):
        source = f"s{n}"
        wanted = [name() if rng.random() < 0.8 else None for _ in ROLES]
        maps.append((source, *wanted))
        # The file's columns appear over several rows; a row repeats some of them.
        columns = list(dict.fromkeys(name() for _ in range(rng.randrange(1, 8))))
        for position in range(len(columns)):
            shown = columns[: position + 1]
            rng.shuffle(shown)
            if position == 0 or columns[position] in shown:
                events.append((source, "f", position, {c: "1" for c in columns[position : position + 1]}))
        expected[source] = {role: resolve(w, columns) for role, w in zip(ROLES, wanted)}
        for ending in ("lat", "lon"):
            expected[source][f"{ending}_col"] = next((c for c in columns if c.lower().endswith(ending)), None)
    map_frame = spark.createDataFrame(maps, "source string, " + ", ".join(f"{r} string" for r in ROLES))
    event_frame = spark.createDataFrame(events, "source string, file_path string, position long, payload map<string,string>")
    tall = resolution.resolve_by_file(resolution.file_columns(event_frame), map_frame)
    for row in tall.collect():
        assert {k: row[k] for k in expected[row.source]} == expected[row.source], row.source
    listed = event_frame.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("position", F.map_keys("payload")[0].alias("name"))))["name"].alias("names")
    )
    columns = F.transform("names", lambda n: F.struct(n.alias("name"), F.split(n, r"\.").alias("path")))
    for row in resolution.resolve_on_row(listed.withColumn("columns", columns).join(map_frame, "source")).collect():
        found = {k: None if row[k] is None else ".".join(row[k]) for k in expected[row.source]}
        assert found == expected[row.source], row.source


def test_roles(spark):
    def rows(source, **columns):
        return [(source, {k: v[i] for k, v in columns.items() if v[i] is not None}) for i in range(2)]

    events = (
        rows("mixed", currentSpeed=("0.0", "0"), currentSpeed_kmh=("31", "0"), q=("1", "2"), jam_severity=("0", "0"), occ=("1", "1"))
        + rows("parts", length=("5", "6"), duration=("1", "2"), timestamp=("5", "6"), occupancy_pct=("0.5", "x"))
        + rows("global", speed=("5", "6"), count=("5", "6"), k=("1", "1"), occ=("1", "1"))
        + rows("words", speed=("fast", "slow"), velocity=("1", "2"))
        + rows("nothing", name=("a", "b"))
    )
    frame = spark.createDataFrame(events, "source string, payload map<string,string>")
    kinds = spark.createDataFrame(
        [(s, "GLOBAL" if s == "global" else "LOCAL") for s in ("mixed", "parts", "global", "words", "nothing")],
        "source string, association_type string",
    )
    got = {r.source: r for r in roles.discover_roles(roles.column_profile(roles.payload_cells(frame)), kinds).collect()}

    def chosen(source):
        return {role: got[source][role] for role in ROLES if got[source][role] is not None}

    assert chosen("mixed") == {"speed_col": "currentSpeed_kmh", "flow_col": "q", "intensity_col": "jam_severity"}
    assert chosen("parts") == {"distance_col": "length", "time_col": "duration", "occupancy_col": "occupancy_pct"}
    assert chosen("global") == {"speed_col": "speed"}
    assert chosen("words") == {"speed_col": "velocity"}
    assert chosen("nothing") == {}
    assert {r.confidence_score for r in got.values()} == {0.99}


def test_null_words_and_warnings(spark):
    maps = spark.createDataFrame(
        [("LOCAL", "None", "q", "", None, None, "o"), ("LOCAL", None, None, None, "d", "t", None), ("GLOBAL", None, None, None, None, None, None)],
        "association_type string, " + ", ".join(f"{r} string" for r in ROLES),
    )
    rows = roles.coverage_warnings(roles.scrub_map(maps)).collect()
    assert [(r.lacks_speed, r.lacks_intensity, r.lacks_flow) for r in rows] == [
        (True, False, False),
        (False, True, True),
        (False, False, False),
    ]
