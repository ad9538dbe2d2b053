"""Model responses: what each text must give is stated by hand or known from how the text was built."""

import json
import random

from pyspark.sql import functions as F

from kinefuse.functions import responses as r

# Text, its last block, its reasoning, its fields.
CASES = [
    ("radar file, nothing to map", None, "radar file, nothing to map", {}),
    ('loops first {"flow_col": "old"} then {"flow_col": "n_veh"} done', '{"flow_col": "n_veh"}', 'loops first {"flow_col": "old"} then', {"flow_col": "n_veh"}),
    ("<think>metres over seconds</think>{\"time_col\": \"t_s\"}", '{"time_col": "t_s"}', "metres over seconds", {"time_col": "t_s"}),
    ("columns look plain\n{\"speed_col\": \" kmh \"}", '{"speed_col": " kmh "}', "columns look plain", {"speed_col": "kmh"}),
    ('{"speed_col": "null", "flow_col": "NONE", "time_col": "", "distance_col": null, "occupancy_col": 7}', '{"speed_col": "null", "flow_col": "NONE", "time_col": "", "distance_col": null, "occupancy_col": 7}', "", {"occupancy_col": "7"}),
    ("distance_col = 'len_m',\nflow_col=None\n time_col=dur=2", None, "distance_col = 'len_m',\nflow_col=None\n time_col=dur=2", {"distance_col": "len_m", "time_col": "dur=2"}),
    ("<think>short</think>\nintensity_col=\"k\"", None, "short", {"intensity_col": "k"}),
    ("", None, "", {}),
    ("ends } here", None, "ends", {}),
    ("{ open only", None, "{ open only", {}),
    ("outer {\"a\": {\"b\": \"c\"}}", '{"a": {"b": "c"}}', "outer", None),
    ("not json {speed} flow_col=q", "{speed}", "not json", {"not json  flow_col": "q"}),
    ("<think>never closed {\"speed_col\": \"ä 1\"}", '{"speed_col": "ä 1"}', "never closed", {"speed_col": "ä 1"}),
]


def read(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = frame.select("i", r.last_json_text(F.col("t")).alias("block"), r.reasoning(F.col("t")).alias("reasoning"), r.response_fields(F.col("t")).alias("fields"))
    return sorted(rows.collect(), key=lambda row: row.i)


def test_stated_responses(spark):
    for row, (text, block, reasoning, fields) in zip(read(spark, [c[0] for c in CASES]), CASES, strict=True):
        assert row.block == block, text
        assert row.reasoning == reasoning, text
        if fields is not None:
            assert row.fields == fields, text


def test_responses_built_from_known_parts(spark):
    rng = random.Random(5)
    thoughts = ["flow is counted", "no time column here", "Größe in m", "a = b"]
    blocks = [{"speed_col": "v"}, {"flow_col": "q", "time_col": "t"}, {"intensity_col": "k {1}"[:1]}]
    built = []
    for _ in range(200):
        thought, fields, tagged, noise = rng.choice(thoughts), rng.choice(blocks), rng.random() < 0.5, rng.choice(["", " {x} ", "\n"])
        block = json.dumps(fields, indent=rng.choice([None, 1]))
        text = f"<think>{thought}</think>{noise}{block}" if tagged else f"{thought}\n{noise}{block}"
        built.append((text, block, thought if tagged else f"{thought}\n{noise}".strip(), fields))
    for row, (text, block, reasoning, fields) in zip(read(spark, [b[0] for b in built]), built, strict=True):
        assert (row.block, row.reasoning, row.fields) == (block, reasoning, fields), text


def test_lines_built_from_known_parts(spark):
    rng = random.Random(6)
    built = []
    for _ in range(100):
        fields, lines = {}, []
        for name in rng.sample(["speed_col", "flow_col", "time_col", "distance_col"], rng.randrange(1, 5)):
            value, quote, gap = rng.choice(["v", "n veh", "NULL", "x-1"]), rng.choice(["", "'", '"']), rng.choice(["", " "])
            lines.append(f"{gap}{name}{gap}={gap}{quote}{value}{quote}{rng.choice(['', ','])}{gap}")
            if value != "NULL":
                fields[name] = value
        built.append(("\n".join(lines), fields))
    for row, (text, fields) in zip(read(spark, [b[0] for b in built]), built, strict=True):
        assert row.block is None and row.fields == fields, text


def test_missing(spark):
    have = spark.range(1).select(
        r.missing_roles(r.response_fields(F.lit('{"speed_col": "v", "flow_col": null, "occupancy_col": "o"}'))).alias("m")
    )
    assert have.first().m == ["flow_col", "intensity_col", "distance_col", "time_col"]
