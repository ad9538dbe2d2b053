"""One log of edits of all kinds against the same edits made one at a time."""

import random

import pytest
from pyspark.sql import functions as F

from kinefuse.operators import edit_log

SOURCES = "path string, association_type string, associated_element_id string, seq long, name string"
TYPES = ("UNASSOCIATED", "GLOBAL", "LOCAL")


def one_at_a_time(sources, edits):
    """Sources by path as [type, element], edited in order."""
    state = {p: [t, e] for p, t, e, *_ in sources}
    for path, _, kind, element, new_type, paths in sorted(edits, key=lambda x: x[1]):
        if kind == "save":
            wanted = {p for p in paths or [] if p in state}
            for p, s in state.items():
                if p in wanted:
                    if s[1] != element:
                        state[p] = ["LOCAL", element]
                elif element is not None and s[1] == element:
                    s[1] = None
        elif kind == "add" and path not in state and path is not None:
            state[path] = [(new_type or "").upper() if (new_type or "").upper() in TYPES else "UNASSOCIATED", None]
        elif path in state:
            s = state[path]
            if kind == "delete":
                del state[path]
            elif kind == "toggle":
                state[path] = ["LOCAL" if s[0] == "GLOBAL" else "GLOBAL", None]
            elif kind == "set" and (new_type or "").upper() in TYPES:
                state[path] = [new_type.upper(), None]
            elif kind == "request" and not s[1] and element is not None:
                state[path] = ["LOCAL", element]
    return state


def log(rng, count, paths, elements):
    edits = []
    for seq in range(count):
        kind = rng.choice(["toggle", "set", "request", "request", "save", "save", "add", "delete", "odd"][: 9 if rng.random() < 0.7 else 6])
        named = [rng.choice(paths + [None]) for _ in range(rng.randrange(4))] if kind == "save" else None
        path = None if kind == "save" else rng.choice(paths)
        element = rng.choice(elements) if kind in ("save", "request") else None
        edits.append((path, seq * 7 - 50, kind, element, rng.choice(["global", "LOCAL", "Unassociated", "region", None]), named))
    rng.shuffle(edits)
    return edits


@pytest.mark.parametrize("seed", range(3))
def test_against_one_at_a_time(spark, monkeypatch, seed):
    monkeypatch.setattr(edit_log, "NEXT_ROWS", 20)
    rng = random.Random(seed)
    paths, elements = [f"/s{k}" for k in range(12)], ["e1", "e2", "e3"]
    sources = [(p, rng.choice([*TYPES, "region", None]), rng.choice([None, "", *elements, "e9"]), k, p.upper()) for k, p in enumerate(paths[:9])]
    # Half of all edits are of one source.
    edits = log(rng, 150, paths + ["/s1"] * len(paths), elements)
    frame = spark.createDataFrame(edits, edit_log.EDITS).withColumn("cases", F.lit(1)).repartition(3)
    after = edit_log.apply_edits(spark.createDataFrame(sources, SOURCES), frame)
    assert after.columns == ["path", "association_type", "associated_element_id", "seq", "name"]
    rows = after.collect()
    wanted = one_at_a_time(sources, edits)
    assert {r.path: [r.association_type, r.associated_element_id] for r in rows} == wanted and len(rows) == len(wanted)


def test_a_toggle_between_two_saves(spark):
    sources = spark.createDataFrame([("/a", "LOCAL", None, 0, "a"), ("/b", "GLOBAL", "x", 1, "b")], SOURCES)
    edits = [(None, 1, "save", "x", None, ["/a"]), ("/a", 2, "toggle", None, None, None), (None, 3, "save", "x", None, ["/a", "/b"])]
    expected = {1: {"/a": ("LOCAL", "x"), "/b": ("GLOBAL", None)}, 2: {"/a": ("GLOBAL", None), "/b": ("GLOBAL", None)}, 3: {"/a": ("LOCAL", "x"), "/b": ("LOCAL", "x")}}
    for upto, wanted in expected.items():
        rows = edit_log.apply_edits(sources, spark.createDataFrame(edits[:upto], edit_log.EDITS)).collect()
        assert {r.path: (r.association_type, r.associated_element_id) for r in rows} == wanted


def test_nothing_to_edit(spark):
    sources = spark.createDataFrame([("/a", "LOCAL", "x", 0, "a")], SOURCES)
    none = spark.createDataFrame([], edit_log.EDITS)
    assert [tuple(r) for r in edit_log.apply_edits(sources, none).collect()] == [("/a", "LOCAL", "x", 0, "a")]
    assert edit_log.apply_edits(sources.limit(0), none).count() == 0


def test_tables_of_runs_follow_each_other():
    """A run cut anywhere does the same as the whole run."""
    rng = random.Random(8)
    kinds = ["toggle", "set", "request", "put", "drop", "add", "delete"]
    for _ in range(200):
        edits = [(rng.choice(kinds), rng.choice(["x", "y", None]), rng.choice(TYPES + ("odd",))) for _ in range(rng.randrange(1, 12))]
        start = (True, rng.choice(TYPES), rng.choice([None, "x", "y", "z", ""])) if rng.random() < 0.8 else (False, None, None)
        wanted = start
        for edit in edits:
            wanted = edit_log.step(wanted, *edit)
        cut = rng.randrange(len(edits) + 1)
        state = start
        for part in (edits[:cut], edits[cut:]):
            run = edit_log.Run()
            for edit in part:
                run.add(*edit)
            there, association, element = state
            table = dict(run.table())
            key = "" if not there else edit_log._case(association, element)
            found = table.get(key) or table[f"{association}*"]
            state = (found["there"], found["association"], element if found["stays"] else found["element"])
        assert state == wanted
