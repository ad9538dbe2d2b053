"""Traffic physics on hand-computed rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kinefuse.functions.numbers import round_hundredths, round_whole, safe_divide, text_to_number
from kinefuse.operators import physics

T0 = dt.datetime(2024, 1, 1)
COLUMNS = (
    "k string, position long, event_timestamp timestamp, speed_val double, flow_val double, "
    "intensity_val double, lat double, lon double"
)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def summary(spark, rows):
    frame = spark.createDataFrame(rows, COLUMNS)
    return {r.k: r for r in physics.summarise(frame, ["k"]).collect()}


def test_summaries(spark):
    rows = [
        # Two speeds and a zero: 3 / (1/50 + 1/25), first location null, 2 events per hour reported nowhere.
        ("zero", 2, at(0), 50.0, None, None, 1.0, 1.0),
        ("zero", 1, at(1800), 25.0, None, None, None, 2.0),
        ("zero", 3, at(3600), 0.0, None, None, 3.0, 3.0),
        ("all_zero", 1, at(0), 0.0, 4.0, None, None, None),
        ("all_zero", 2, at(0), 0.0, None, None, None, None),
        ("negative", 1, at(0), -5.0, None, None, None, None),
        ("no_speed", 1, at(0), None, 7.0, None, None, None),
        ("one", 1, at(5), 10.0, None, None, None, None),
        ("reported", 1, at(0), 10.0, 3.0, 0.5, None, None),
        ("reported", 2, at(7200), 10.0, None, 1.5, None, None),
        ("reported", 3, at(7200), 10.0, 2.0, None, None, None),
        ("below_ms", 1, T0, 10.0, None, None, None, None),
        ("below_ms", 2, T0 + dt.timedelta(microseconds=999), 10.0, None, None, None, None),
        ("no_time", 1, None, 10.0, None, None, None, None),
        ("infinite", 1, at(0), math.inf, None, None, None, None),
        ("infinite", 2, at(0), 20.0, None, None, None, None),
    ]
    got = summary(spark, rows)
    zero = got["zero"]
    assert zero.speed_val == pytest.approx(3 / (1 / 50 + 1 / 25))
    assert zero.flow_val == 3.0 and zero.lat is None and zero.lon == 2.0
    assert zero.event_timestamp == at(3600)
    assert zero.intensity_val == pytest.approx(3.0 / zero.speed_val)
    assert (got["all_zero"].speed_val, got["all_zero"].flow_val, got["all_zero"].intensity_val) == (0, 4, 0)
    assert (got["negative"].speed_val, got["negative"].intensity_val) == (0, 0)
    assert (got["no_speed"].speed_val, got["no_speed"].flow_val, got["no_speed"].intensity_val) == (None, 7, 0)
    assert (got["one"].flow_val, got["one"].intensity_val) == (1.0, 0.1)
    assert (got["reported"].flow_val, got["reported"].intensity_val) == (5.0, 1.0)
    assert got["below_ms"].flow_val == 2.0
    assert got["no_time"].flow_val == 1.0 and got["no_time"].event_timestamp is None
    assert got["infinite"].speed_val == 40.0


def test_summary_is_one_hash_shuffle(spark):
    frame = spark.createDataFrame([], COLUMNS)
    plan = physics.summarise(frame, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2 and "SortAggregate" not in plan


def test_projection(spark):
    roles = "speed_col string, flow_col string, intensity_col string, distance_col string, time_col string, occupancy_col string"
    schema = f"n int, association_type string, {roles}, lat_col string, lon_col string, payload map<string,string>, event_timestamp timestamp, sensor_id string"
    payload = {"v": "50", "d": "10", "t": "0", "q": "3", "k": "0.5", "o": "0.9", "lat": "1.5", "bad": "x", "nan": "NaN"}

    def row(n, kind, speed=None, flow=None, intensity=None, distance=None, time=None, occupancy=None):
        return (n, kind, speed, flow, intensity, distance, time, occupancy, "lat", None, payload, at(1), "101")

    frame = spark.createDataFrame(
        [
            row(0, "LOCAL", speed="v", flow="q", intensity="k", distance="d", time="v", occupancy="o"),
            row(1, "LOCAL", distance="d", time="v", occupancy="o"),
            row(2, "LOCAL", distance="d", time="t"),
            row(3, "global", speed="bad", flow="q", intensity="k", occupancy="o"),
            row(4, "GLOBAL", speed="sensor_id", distance="d"),
            row(5, "LOCAL", speed="event_timestamp", flow="nan", intensity="absent"),
        ],
        schema,
    )
    got = {r.n: r for r in physics.kinematic_projection(frame).collect()}

    def measures(n):
        return got[n].speed_val, got[n].flow_val, got[n].intensity_val

    assert measures(0) == (50, 3, 0.5) and got[0].lat == 1.5 and got[0].lon is None
    assert measures(1) == (0.2, None, 0.9)
    assert measures(2) == (None, None, None)
    assert measures(3) == (None, None, 0.9)
    assert measures(4) == (101, None, None)
    assert measures(5) == (1704067201 * 1e9, None, None)


def test_backfill_and_gaps(spark):
    frame = spark.createDataFrame([(float("nan"), "7", 1), (2.0, "x", 2)], "speed_val double, flow_val string, lat int")
    filled = physics.backfill(frame)
    assert [tuple(r) for r in filled.orderBy("lat").collect()] == [
        (None, 7.0, 1.0, None, None),
        (2.0, None, 2.0, None, None),
    ]
    gaps = physics.missing_measures(filled).orderBy("lat").collect()
    assert [r.missing for r in gaps] == [["speed_val", "intensity_val"], ["flow_val", "intensity_val"]]


def test_numbers(spark):
    texts = ["12", "-1.5", "+3", ".5", "5.", "1e3", " 12", "12 ", "1d", "0x1", "", "abc", "NaN", "inf", "-Infinity", "1_0", "12\n", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in frame.select("i", text_to_number(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [12, -1.5, 3, 0.5, 5, 1000] + [None] * 7 + [math.inf, -math.inf, None, None, None]
    values = [0.5, 1.5, 2.5, -0.5, 1.015, 2.675, math.inf, -math.inf, math.nan, None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = frame.select("i", round_whole(F.col("v")).alias("w"), round_hundredths(F.col("v")).alias("h")).orderBy("i").collect()
    assert [r.w for r in rows] == [0, 2, 2, 0, 1, 3, None, None, None, None]
    import numpy as np

    assert [r.h for r in rows[:6]] == [float(np.round(v, 2)) for v in values[:6]]
    assert [r.h for r in rows[6:]] == [None] * 4
    assert spark.range(1).select(safe_divide(F.lit(1.0), F.lit(0.0)).alias("q")).first().q is None
