"""Text files to events, against the standard library's parsers."""

import csv
import datetime as dt
import io
import json
import random

from pyspark.sql import functions as F

from kinefuse.functions.payload import flatten_record, key_paths, mark_text, parse_record, unmark, value_at
from kinefuse.functions.text import lenient_utf8
from kinefuse.functions.times import event_time, iso_time, time_number, time_value
from kinefuse.sources.extract import (
    explode_records,
    extract_events,
    json_records,
    parse_files,
    split_csv_fields,
    split_csv_records,
)

MODIFIED = dt.datetime(2024, 5, 6, 7, 8, 9)


def files(spark, texts):
    rows = [("/d/s", "s", f"/d/s/{i:04d}", MODIFIED, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(
        rows, "source_path string, source string, file_path string, modified timestamp, text string"
    )


def events_of(spark, texts):
    """Per text, the (payload, time) of its events in order."""
    rows = extract_events(files(spark, texts)).orderBy("file_path", "position").collect()
    found = {i: [] for i in range(len(texts))}
    for row in rows:
        found[int(row.file_path[-4:])].append((row.payload, row.event_timestamp))
    return [found[i] for i in range(len(texts))]


def test_documents(spark):
    cases = {
        '[{"lane": 3, "gap_s": 1.75}, {"lane": 4}]': [{"lane": "3", "gap_s": "1.75"}, {"lane": "4"}],
        '{"jams": [{"level": 2}, {"level": 5}], "page": 1}': [{"level": "2"}, {"level": "5"}],
        "lane,gap_s\n3,1.75": [{"lane": "3", "gap_s": "1.75"}],
        "\x03\x00\x7f": [],
        "": [],
        "12": [],
        '"[{}]"': [],
        "[]": [],
        "{}": [{}],
        "[1, null, {}]": [{}],
        # Lines of JSON are no JSON document, so they are read as CSV under their first line.
        '{"a":1}\n{"b":2}': [{'{"a":1}': '{"b":2}'}],
        '[{"a":1}] x\n1': [{'[{"a":1}] x': "1"}],
        "{'a':1}\n5": [{"{'a':1}": "5"}],
        '﻿{"a":1}\n5': [{'﻿{"a":1}': "5"}],
        '{"a":1,}\n5,6': [{'{"a":1': "5", "}": "6"}],
        # An empty array or one that starts with another value holds no events.
        '{"none":[],"mixed":[1,{"a":1}],"b":2}': [{"none": "[]", "mixed": '[1,{"a":1}]', "b": "2"}],
        '{"x":[{"a":1},5,{"a":2}],"s":1,"y":[{"b":3}]}': [{"a": "1"}, {"a": "2"}, {"b": "3"}],
        '{"o":{"p":{"q":1}},"a":"{\\"z\\":1}","e":{}}': [{"a": '{"z":1}', "o.p.q": "1"}],
        '["{\\"a\\":1}", {"b":1}]': [{"b": "1"}],
        'a,a,b\n1,2\n3,4,5,6\n\n"x ""y"", \nz",7,8': [
            {"a": "2", "b": None},
            {"a": "4", "b": "5"},
            {"a": "7", "b": "8"},
        ],
    }
    found = events_of(spark, list(cases))
    for text, events in zip(cases, found):
        assert [payload for payload, _ in events] == cases[text], text
    dated = events_of(spark, ["a\n1", '[{"time": 1600000000000}]'])
    assert dated[0][0][1] == MODIFIED
    assert dated[1][0][1] == dt.datetime(2020, 9, 13, 12, 26, 40)


def test_file_columns_keep_first_appearance(spark):
    text = '[{"n":{"b":1},"a":2},{"c":3,"sensor_id":4,"n":{"d":5}}]'
    row = parse_files(files(spark, [text])).select("columns.name").first()
    assert row.name == ["a", "n.b", "c", "sensor_id", "n.d", "event_timestamp"]


def _value(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind < 5:
        return rng.choice([1, -2.5, True, None, "x", "12", '{"a":1}', "[1]", 'q"\\', "é,\n", "-", "true"])
    if kind < 6:
        return [_value(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["a", "b", "c.d", '{"k', "9", "ü"]): _value(rng, depth - 1) for _ in range(rng.randrange(4))}


def _document(rng):
    """A document and the events it was built to hold; None where it holds no events by kind."""
    kind = rng.randrange(5)
    if kind == 0:
        document, events = [], []
        for _ in range(rng.randrange(5)):
            if rng.random() < 0.7:
                event = _value(rng, 2)
                event = event if isinstance(event, dict) else {"v": event}
                events.append(event)
                document.append(event)
            else:
                document.append(rng.choice([1, None, "x", [2], True]))
        return document, events
    if kind == 1:
        events = [{"n": k, "inner": _value(rng, 2)} for k in range(rng.randrange(1, 6))]
        cut = rng.randrange(1, len(events) + 1)
        document = {"page": 1, "first": [*events[:cut], 5], "none": [], "others": [1, {"n": -1}]}
        if events[cut:]:
            document["second"] = events[cut:]
        return document, events
    if kind == 2:
        document = {"n": rng.randrange(9), "text": rng.choice(["x", 'q"', "é"]), "list": [1, 2]}
        return document, [document]
    return (rng.choice([12, "words", None, True]), None) if kind == 3 else ({}, [{}])


def test_random_documents(spark):
    rng = random.Random(7)
    built = []
    for _ in range(400):
        document, events = _document(rng)
        text = json.dumps(document, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if isinstance(document, (dict, list)) and rng.random() < 0.3:
            text, events = rng.choice([(text[:-1], None), (text + "]", None), ("," + text, None)])
        built.append((text, events))
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(built)], "i int, t string")
    found = {r.i: r.r for r in frame.select("i", json_records(F.col("t")).alias("r")).collect()}
    for i, (text, events) in enumerate(built):
        have = None if found[i] is None else [json.loads(x.replace("\\u0002", "")) for x in found[i]]
        assert have == events, text


def _flat(data):
    def walk(value, name):
        if isinstance(value, dict):
            for key, inner in value.items():
                yield from walk(inner, f"{name}.{key}")
        else:
            yield name, value

    plain = {k: v for k, v in data.items() if not isinstance(v, dict)}
    nested = [pair for k, v in data.items() if isinstance(v, dict) for pair in walk(v, k)]
    return {**plain, **dict(nested)}


def test_any_depth_is_flattened(spark):
    texts = []
    for depth in range(1, 13):
        text = "10"
        for level in range(depth, 0, -1):
            text = f'{{"k{level}": {text}, "s{level}": {level}}}'
        texts.append(text)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", flatten_record(parse_record(mark_text(F.col("t")))).alias("flat"), key_paths(F.col("t")).alias("paths")).collect()
    for row in rows:
        deepest = ".".join(f"k{level}" for level in range(1, row.i + 2))
        assert row.flat[deepest] == "10" and len(row.flat) == row.i + 2
        assert deepest in row.paths and len(set(row.paths)) == 2 * (row.i + 1)


def _paths(data, prefix=""):
    if isinstance(data, dict):
        for key, value in data.items():
            path = f"{prefix}.{key}" if prefix else key
            yield path
            yield from _paths(value, path)
    elif isinstance(data, list):
        for item in data:
            yield from _paths(item, prefix)


def test_random_payloads_against_json(spark):
    rng = random.Random(8)
    documents = []
    while len(documents) < 300:
        value = _value(rng, 5)
        if isinstance(value, dict):
            documents.append(value)
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, t string")
    rows = frame.select(
        "i",
        flatten_record(parse_record(mark_text(F.col("t")))).alias("flat"),
        F.array_sort(F.array_distinct(key_paths(F.col("t")))).alias("paths"),
    ).withColumn("names", F.map_keys("flat")).collect()
    for row in rows:
        want = _flat(documents[row.i])
        assert row.names == list(want), documents[row.i]
        for name, value in want.items():
            have = row.flat[name]
            if isinstance(value, list):
                assert json.loads(have) == value
            elif isinstance(value, str) or value is None:
                assert have == value
            else:
                assert json.loads(have) == value
        assert sorted(row.paths) == sorted(set(_paths(documents[row.i]))), documents[row.i]


def test_random_csv_against_csv(spark):
    rng = random.Random(9)
    pieces = ["a", "", '"', '""', ",", ",", "\n", "b c", '"x,y"', '"l\nm"', "é", "1.5"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(500)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", F.transform(split_csv_records(F.col("t")), split_csv_fields).alias("r")).collect()
    for row in rows:
        text = texts[row.i]
        want = [r for r in csv.reader(io.StringIO(text)) if r]
        # A quoted empty field alone on its line is a row of one empty field.
        assert row.r == want, repr(text)


def test_event_times(spark):
    utc = dt.datetime
    cases = {
        '{"timestamp": 1600000000}': utc(2020, 9, 13, 12, 26, 40),
        '{"time": 1600000000500}': utc(2020, 9, 13, 12, 26, 40, 500000),
        '{"pubMillis": 1600000000000}': utc(2020, 9, 13, 12, 26, 40),
        '{"date": "2024-01-02"}': utc(2024, 1, 2),
        '{"date": "2024-01-02T03:04:05Z"}': utc(2024, 1, 2, 3, 4, 5),
        '{"date": "2024-01-02 03:04:05.25+02:00"}': utc(2024, 1, 2, 1, 4, 5, 250000),
        '{"date": "20240102T030405"}': utc(2024, 1, 2, 3, 4, 5),
        '{"date": "2024-01-02T03"}': utc(2024, 1, 2, 3),
        '{"date": "2024"}': MODIFIED,
        '{"time": "1600000000", "date": "2024-01-02"}': MODIFIED,
        '{"time": null, "date": "2024-01-02"}': MODIFIED,
        '{"time": {"a": 1}}': MODIFIED,
        '{"time": 1e300}': MODIFIED,
        '{"time": true}': utc(1970, 1, 1, 0, 0, 1),
        '{"event_timestamp": -1}': utc(1969, 12, 31, 23, 59, 59),
        '{"Time": 5}': MODIFIED,
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    value = frame.select("i", time_value(parse_record(mark_text(F.col("t")))).alias("v"))
    rows = value.select("i", F.coalesce(event_time(F.col("v"), time_number(F.col("v"))), F.lit(MODIFIED)).alias("time")).collect()
    for row in rows:
        text = list(cases)[row.i]
        assert row.time == cases[text], text
    assert spark.range(1).select(iso_time(F.lit("yesterday")).alias("t")).first().t is None


def test_lenient_decode(spark):
    cases = [b"a\xffb", "né�x".encode(), b"\xef\xbf\xbd\xe2\x82", b"\xed\xa0\x80ok", b"", b"\xc3\x28"]
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    for row in frame.select("i", lenient_utf8(F.col("c")).alias("t")).collect():
        assert row.t == cases[row.i].decode("utf-8", errors="ignore")


def test_paths_read_what_flattening_gives(spark):
    """Per file, the columns in order of first appearance, and by path the value of every event."""
    rng = random.Random(11)
    texts, events = [], []
    for _ in range(120):
        items = [x for x in (_value(rng, 3) for _ in range(rng.randrange(1, 9))) if isinstance(x, dict)]
        if rng.random() < 0.6:
            texts.append(json.dumps([*items, 7, None]))
            events.append(items)
        else:
            document = {"n": 1, "first": items, "second": items[:1]}
            texts.append(json.dumps(document))
            events.append(items + items[:1] if items else [document])
    parsed = parse_files(files(spark, texts))
    listed = parsed.select("file_path", "columns.name", "columns.path").collect()
    columns = {int(r.file_path[-4:]): r.name for r in listed}
    paths = {int(r.file_path[-4:]): r.path for r in listed}
    rows = explode_records(parsed.withColumn("found", F.col("columns")))
    read = F.transform("found", lambda c: unmark(value_at(F.col("record"), c["path"])))
    have = {(int(r.file_path[-4:]), r.position): r.v for r in rows.select("file_path", "position", read.alias("v")).collect()}
    count = 0
    for i, text in enumerate(texts):
        flat = [_flat(record) for record in events[i]]
        names = list(dict.fromkeys(name for f in flat for name in f))
        assert list(dict.fromkeys(columns[i])) == names + ["event_timestamp", "sensor_id"], text
        for place, f in enumerate(flat):
            # Of a name listed twice, the nested path reads both.
            nested = {n: v for n, p, v in zip(columns[i], paths[i], have[(i, place)]) if len(p) > 1}
            values = {**dict(zip(columns[i], have[(i, place)])), **nested}
            for name in names:
                value = values[name]
                if name not in f and value is not None:
                    # The name is an object here; as a number its text is null.
                    assert isinstance(json.loads(value.replace("\\u0002", "")), dict)
                elif not isinstance(f.get(name), (list, bool, int, float)):
                    assert value == f.get(name), (text, place, name)
                elif not isinstance(f[name], list):
                    assert json.loads(value) == f[name]
            count += 1
    assert count == len(have)
