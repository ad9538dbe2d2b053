"""Files read in pieces give the same events as files read whole, wherever the splits fall."""

import csv
import gzip
import hashlib
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from kinefuse.sources import splits
from kinefuse.sources.chunks import landing_chunks, list_all_files, read_chunks
from kinefuse.sources.extract import events_of
from kinefuse.sources.files import plain_path, read_text_files
from kinefuse.sources.extract import extract_events


def states(text):
    """The state of a CSV reader after each character, one character at a time."""
    state = splits.START
    for c in text:
        if state == splits.QUOTED:
            state = splits.AFTER if c == '"' else splits.QUOTED
        elif c == '"' and state in (splits.START, splits.AFTER):
            state = splits.QUOTED
        elif c in ",\r\n":
            state = splits.START
        else:
            state = splits.PLAIN
        yield state


def test_csv_reports():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice('",\r\nax ') for _ in range(rng.randrange(30)))
        for start, lead in splits._LEADS.items():
            lead = lead.decode()
            wanted = ([start] + list(states(lead + text))[len(lead) :])[-1]
            assert splits.csv_ends(text.encode())[start] == wanted, (text, start)


def json_walk(text, state):
    """State, depth and structural characters of a JSON reader, one character at a time."""
    depth, seen = 0, []
    for k, c in enumerate(text):
        if state == splits.ESCAPED:
            state = splits.INSIDE
        elif state == splits.INSIDE:
            state = splits.ESCAPED if c == "\\" else splits.OUTSIDE if c == '"' else splits.INSIDE
        elif c == '"':
            state = splits.INSIDE
        elif c in "[]{},":
            depth += {"[": 1, "{": 1, ",": 0}.get(c, -1)
            seen.append((k, c))
    return state, depth, seen


def test_json_reports():
    rng = random.Random(2)
    for _ in range(500):
        # A backslash outside of strings is no JSON; there the readers may differ.
        text = "".join(rng.choice('"",[]{}ax ') for _ in range(rng.randrange(30)))
        inner = "".join(rng.choice('"\\\\x') for _ in range(rng.randrange(6)))
        for start in (splits.OUTSIDE, splits.INSIDE, splits.ESCAPED):
            for whole in (text, inner + text):
                if "\\" in whole and start == splits.OUTSIDE:
                    continue
                state, depth, seen = json_walk(whole, start)
                if "\\" in whole and '"' in whole.split("\\")[0]:
                    continue
                ends, grown = splits.json_ends(whole.encode())
                if "\\" not in whole or state == ends[start]:
                    assert (ends[start], grown[start]) == (state, depth), (whole, start)


def documents(rng):
    """Texts of all kinds: arrays, objects with event arrays, CSV with quoted line breaks, and broken ones."""

    def value(depth=0):
        kind = rng.randrange(8 if depth < 2 else 5)
        if kind < 5:
            return [rng.randrange(1000), rng.random(), None, rng.choice(["", 'a "q" \\', "[{,", "ü€😀", "x\ny", "12"]), True][kind]
        if kind == 5:
            return [value(depth + 1) for _ in range(rng.randrange(3))]
        return {rng.choice("abcde"): value(depth + 1) for _ in range(rng.randrange(3))}

    def event():
        return {rng.choice(["speed", "n", "geo", "kind", "time"]): value() for _ in range(rng.randrange(1, 4))}

    def dumps(data):
        return json.dumps(data, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]))

    def table():
        out = io.StringIO()
        rows = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        rows.writerow(["speed", "note", "kind"])
        for _ in range(rng.randrange(12)):
            rows.writerow([rng.randrange(90), rng.choice(["plain", "a,b", 'q "x"', "two\nlines", "c\r\nd", ""]), rng.choice("xyz")][: rng.randrange(1, 4)])
        return out.getvalue()

    texts = [dumps([event() if rng.random() < 0.8 else value() for _ in range(rng.randrange(8))]) for _ in range(14)]
    for _ in range(14):
        fields = {f"k{i}": rng.choice([[event() for _ in range(rng.randrange(5))], value(), [value(), event()]]) for i in range(rng.randrange(5))}
        texts.append(dumps(fields))
    texts += [table() for _ in range(14)]
    texts += ["", "\n\n", "\n\nspeed,n\n\n1,2\n", "a\r\n\r\n1\r2\n3", '"open,1\n2,3\n4', 'x"y,z\n1"2,"3""4"5\n', "[]", "{}", "[ ]", " [ 1 , 2 ] ", "﻿[{}]", "12"]
    texts += ['[{"a":1},]', '[{"a":1},,{"b":2}]', '[,{"a":1}]', '[{"a":1}] x', '[{"a":1}][{"b":2}]', '[{"a":1}', '{"e":[{"a":1},]}', '{"e":[{"a":1}],}', '{"e":[{"a":1}]} {"f":1}']
    texts += ['{"e":[{"a":1},{"a":2},{"a":3}],"f":[{"b":1}],"e":[{"c":1},{"c":2},{"c":3},{"c":4}]}', '{"f":[3,{"a":1},{"b":2}],"e":[ \n {"a":1},{"b":2}]}', '[[{"a":1}],{"b":[1,{"c":2},3]},{"d":{"e":{"f":1}}}]']
    texts += ["h1,[1\n2,3]\n", '[1,2\n3,"4]"\n', "{'a':1}\n5,6\n7", '{"a":1}\n{"b":2}\n']
    return texts


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("splits") / "s"
    top.mkdir()
    for k, text in enumerate(documents(random.Random(4))):
        (top / f"{k:04d}.txt").write_bytes(text.encode())
    (top / "bad.csv").write_bytes(b"speed,n\xff\n1,\xc3\n\xe2\x82,2\n")
    (top / "zipped.json.gz").write_bytes(gzip.compress(b'[{"speed":1},{"speed":2},{"n":"x"}]'))
    return str(top)


def rows_of(events):
    rows = events.select("file_path", "position", "event_timestamp", "sensor_id", "payload").collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.file_path, r.position)):
        found.setdefault(os.path.basename(r.file_path), []).append((r.position, r.event_timestamp, r.sensor_id, r.payload))
    return found


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_same_events_at_every_split_size(spark, folder, size):
    whole = extract_events(read_text_files(spark, [folder]))
    wanted = rows_of(whole)
    found = rows_of(events_of(splits.read_parsed(spark, [folder], size)))
    assert found.keys() == wanted.keys()
    for name, events in wanted.items():
        assert found[name] == events, (name, open(os.path.join(folder, name), "rb").read())


def test_same_columns_of_a_file(spark, folder):
    columns = lambda parsed: {r.file_path: [c.name for c in r.columns] for r in parsed.select("file_path", "columns").collect()}
    whole, pieces = (columns(splits.read_parsed(spark, [folder], size)) for size in (1 << 20, 30))
    assert pieces and all(pieces[f] == whole[f] for f in pieces)


def test_hidden_and_empty_files(spark, tmp_path):
    top = tmp_path / "sensors"
    (top / "sub" / ".deep").mkdir(parents=True)
    names = {"a.csv": b"v\n1\n", "_x.csv": b"v\n2\n", ".y.json": b'[{"v":3}]', "none.csv": b"", "sub/.deep/z.csv": b"v\n4\n", "_a=b.csv": b"v\n5\n", ".a.csv.crc": b"crc", ".lone.crc": b"v\n6\n"}
    for name, content in names.items():
        (top / name).write_bytes(content)
    listed = {r.path[len(str(top)) + 1 :]: r.length for r in list_all_files(spark, [str(top), str(tmp_path / "gone")]).collect()}
    assert listed == {n: len(c) for n, c in names.items() if n != ".a.csv.crc"}
    # Two folders, one below the other: its file belongs to both.
    folders = [str(top), str(top / "sub")]
    events = events_of(splits.read_parsed(spark, folders)).select("source", "payload").collect()
    assert sorted((r.source, r.payload["v"]) for r in events) == [("sensors", str(k)) for k in range(1, 7)] + [("sub", "4")]
    spelled = events_of(splits.read_parsed(spark, [f"file://{top}//"])).select("payload").collect()
    assert sorted(r.payload["v"] for r in spelled) == [str(k) for k in range(1, 7)]


def test_chunks_and_landing(spark, tmp_path):
    content = bytes(random.Random(6).randrange(256) for _ in range(10_000))
    (tmp_path / "raw.bin").write_bytes(content)
    (tmp_path / "packed.gz").write_bytes(gzip.compress(content, mtime=0))
    (tmp_path / "empty").write_bytes(b"")
    listing = list_all_files(spark, [str(tmp_path)])
    for size in (999, 1 << 20):
        parts = {}
        for r in read_chunks(listing, size).orderBy("file_path", "chunk").collect():
            parts.setdefault(os.path.basename(r.file_path), []).append(bytes(r.content))
        assert {n: b"".join(p) for n, p in parts.items()} == {"raw.bin": content, "packed.gz": content}
        landed = landing_chunks(listing, size).collect()
        for name in ("raw.bin", "packed.gz", "empty"):
            whole = (tmp_path / name).read_bytes()
            rows = sorted((r.chunk, bytes(r.content), r.file_hash, r.file_size_bytes) for r in landed if os.path.basename(r.file_path) == name)
            assert [r[0] for r in rows] == list(range(max(1, -(-len(whole) // size))))
            assert b"".join(r[1] for r in rows) == whole
            assert {r[2:] for r in rows} == {(hashlib.md5(whole).hexdigest(), len(whole))}


def test_chunks_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "raw.csv").write_bytes(b"speed,n\n" + b"1,2\n" * 5_000)
    listing = list_all_files(spark, [str(tmp_path)])
    for chunks in (read_chunks(listing, 500), landing_chunks(listing, 500)):
        tasks = chunks.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 41


def test_no_task_gets_a_whole_file(spark, tmp_path, monkeypatch):
    """Contents and records are dealt out by chunk or piece, never by their file alone."""
    (tmp_path / "a.csv").write_text("id,note\n" + "".join(f'{k},"x\n{k}"\n' for k in range(400)))
    (tmp_path / "b.json").write_text(json.dumps([{"id": k, "a": {"b": k}} for k in range(400)]))
    (tmp_path / "c.json").write_text("[1,2\n" + "".join(f"{k},{k}\n" for k in range(400)))
    plans = {}

    def explained(frame, label):
        plan = frame._jdf.queryExecution().executedPlan()
        plans.setdefault(label, []).append((frame, [line for line in plan.toString().split("\n") if "Exchange hashpartitioning(file_path#" in line]))

    def write(frame, label, **options):
        if options:
            explained(frame, label)
        return write_and_read(frame, label, **options)

    write_and_read = splits.write_and_read
    monkeypatch.setattr(splits, "write_and_read", write)
    parsed = splits.read_parsed(spark, [str(tmp_path)], 100)
    explained(parsed, "parsed")
    assert {"chunks", "json-cuts", "json-documents", "json-pieces", "csv-cuts", "parsed"} <= set(plans)
    for label, found in plans.items():
        for _, exchanges in found:
            assert all(line.split("hashpartitioning(")[1].split(")")[0].count("#") > 1 for line in exchanges), (label, exchanges)
    # Three files lie in many pieces, each with the number of records before it.
    pieces = sorted((os.path.basename(r.file_path), r.first_position, r.n) for r in parsed.select("file_path", "first_position", F.size("records").alias("n")).collect())
    for name in ("a.csv", "b.json", "c.json"):
        own = [p for p in pieces if p[0] == name]
        assert len(own) > 10 and sum(n for *_, n in own) >= 400


def test_no_files(spark, tmp_path):
    assert splits.read_parsed(spark, [str(tmp_path / "gone")]).count() == 0
    assert plain_path(F.lit("file:///a/b/")) is not None
