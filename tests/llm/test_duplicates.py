"""Near-dedup, substring dedup, decontamination against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from kinefuse.llm import decontamination, near_duplicates, substrings
from kinefuse.llm.components import components

from .conftest import DOCS, ROWS, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    size = min(size, len(words))
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else frozenset()


def brute_components(pairs, size, percent):
    sets = [shingles(t, size) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(pairs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if find(j) == find(k) and pairs[j][0] is not None]
        first = i if not sets[k] else min(ids, default=None)
        out.append((i, len(sets[k]), first, i == first))
    return sorted(map(str, out))


def edited(rng, words, share):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in words)


def test_near_duplicates(spark, docs):
    for size, percent in ((3, 85), (5, 80)):
        found = near_duplicates.near_duplicates(docs, size, percent).collect()
        assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in found) == brute_components(ROWS, size, percent)


def test_near_duplicates_of_edited_copies(spark):
    """Groups around the threshold, where a list's lead is linked with a part of the list only."""
    rng = random.Random(4)
    pairs = []
    for group in range(4):
        words = [f"g{group}w{rng.randrange(400)}" for _ in range(150)]
        pairs += [(len(pairs) + k, edited(rng, words, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05]))) for k in range(40)]
    docs = spark.createDataFrame(rows(pairs), DOCS)
    found = near_duplicates.near_duplicates(docs, 3, 85).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in found) == brute_components(pairs, 3, 85)


def test_lists_of_a_templated_source(spark, monkeypatch):
    """A third of the classes from one template, in many components: no group holds a list, and the links are those of all pairs."""
    for name, size in (("OUTSIDERS", 8), ("MEMBERS", 16), ("PART_NODES", 16), ("CHUNK_NODES", 16), ("BLOCK_SHINGLES", 2000)):
        monkeypatch.setattr(near_duplicates, name, size)
    made, blocked = [], near_duplicates._blocked
    monkeypatch.setattr(near_duplicates, "_blocked", lambda *x: made.append(blocked(*x)) or made[-1])
    frame = [f"frame{k}" for k in range(60)]
    pairs = [(k, " ".join(frame + [f"own{k % 60}x{j}" for j in range(22)] + [f"z{k}"])) for k in range(120)]
    pairs += [(200 + k, " ".join(f"other{k}x{j}" for j in range(40))) for k in range(240)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows(pairs), DOCS), 3, 85).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in found) == brute_components(pairs, 3, 85)
    ((outsiders, members),) = made
    by = ("key", "block", "against")
    assert members.select("key", "node").distinct().groupBy("key").count().agg({"count": "max"}).first()[0] > 64
    assert max(x.groupBy(*by).count().agg({"count": "max"}).first()[0] for x in (outsiders, members)) <= 48


def test_first_of_each_keeps_all_columns(spark, docs, none):
    kept = near_duplicates.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    # The texts of 8 and the first 9 share a passage of 60 words and are near copies at 0.8.
    assert ids == [1, 2, 3, 4, 5, 7, 8, 9, 10, 12, 14, 15, 16]
    assert near_duplicates.near_duplicates(none).count() == 0


def test_one_of_each_group_without_usual_ids(spark):
    """Near copies without doc_id, or under one doc_id, are still one group."""
    near = lambda k, n: " ".join([*(f"g{k}w{i}" for i in range(100)), f"end{n}"])
    pairs = [(None, near(0, n)) for n in range(3)] + [(7, near(1, 0)), (7, near(1, 1)), (9, near(1, 2))] + [(None, near(2, 0)), (3, near(2, 1))] + [(None, ""), (None, None), (5, near(1, 0)[:20])] + [(7, near(1, 0))] * 3
    kept = near_duplicates.first_of_each(spark.createDataFrame(rows(pairs), DOCS)).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept) == [(0, ""), (0, ""), (0, "g0w"), (3, "g2w"), (5, "g1w"), (7, "g1w")]


def test_exact_postings_find_every_link(spark):
    """At a low threshold few coordinates agree; posting by the rarest shingles misses nothing."""
    rng = random.Random(12)
    words = [f"v{k}" for k in range(25)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 14))) for _ in range(150)]
    texts += [" ".join(t.split()[: rng.randrange(1, 12)] + ["v1"]) for t in texts[:60]]
    frame = spark.createDataFrame(rows(list(enumerate(texts))), DOCS)
    found = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(frame, 2, 40, exact=True).collect()}
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} or {tuple(w)} for w in (t.split() for t in texts)]
    comp = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 40 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == (last := locals().get("last")):
            break
        last = list(comp)
    assert found == dict(enumerate(comp))


def test_matches_follow_the_threshold():
    import math

    for percent in (95, 85, 80, 60):
        least = near_duplicates.matches(percent)
        missed = sum(math.comb(48, k) * (percent / 100) ** k * (1 - percent / 100) ** (48 - k) for k in range(least))
        assert missed <= near_duplicates.MISSED


def test_components(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)]
    found = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41))
    assert all(found[a] == found[b] for a, b in chain if a != b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_kept(pairs, window):
    texts = [WORD.findall(t or "") for _, t in pairs]
    seen = {}
    for words in texts:
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            seen[run] = seen.get(run, 0) + 1
    out = []
    for (i, _), words in zip(pairs, texts, strict=True):
        covered = set()
        for k in range(len(words) - window + 1):
            if seen[tuple(words[k : k + window])] > 1:
                covered |= set(range(k, k + window))
        out.append((i, len(words), len(covered), " ".join(w for k, w in enumerate(words) if k not in covered)))
    return sorted(map(str, out))


def test_repeats(spark, docs, none):
    found = substrings.remove_repeats(docs).collect()
    assert sorted(str((r._row.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in found) == brute_kept(ROWS, 35)
    assert substrings.remove_repeats(none).count() == 0


def test_many_equal_rows(spark):
    """Equal rows share one list of places, each place once."""
    text = " ".join(f"w{k}" for k in range(60))
    frame = spark.createDataFrame(rows([(1, text)] * 3000 + [(2, text + " more")] + [(3, "short")] * 500), DOCS).repartition(5)
    texts, places = substrings.repeated_places(frame)
    found = places.collect()
    assert sorted(len(r.places) for r in found) == [26, 26] and all(len(set(r.places)) == 26 for r in found)
    assert texts.count() == 3501
    kept = substrings.remove_repeats(frame).groupBy("_row.doc_id", "n_removed", "kept_text").count().collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text, r["count"]) for r in kept) == [(1, 60, "", 3000), (2, 60, "more", 1), (3, 0, "short", 500)]


def test_windows_of_a_group():
    """Both sides of the trees against windows as tuples."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        window, reach = 6, 4
        back = rng.integers(0, reach + 1, 30)
        size = window + rng.integers(0, back + 1)
        words = rng.integers(0, 2, size.sum()).astype(np.int64)
        begin = np.cumsum(size) - size
        found = substrings.repeated_windows(words, size, back, window, reach)
        seen = {}
        for i, (a, n, b) in enumerate(zip(begin, size, back)):
            for k in range(n - window + 1):
                seen.setdefault((int(b - k), *words[a + k : a + k + window].tolist()), []).append((i, k))
        wanted = np.zeros_like(found)
        for places in seen.values():
            if len(places) > 1:
                for i, k in places:
                    wanted[i, k] = True
        assert (found == wanted).all()


@pytest.mark.parametrize("frequent", [substrings.FREQUENT, 3])
def test_random_repeats(spark, monkeypatch, frequent):
    """Few words, so that runs repeat within and across texts at all offsets."""
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    rng = random.Random(8)
    pairs = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for k in range(60)]
    pairs += [(100 + k, f"{k} " + "same " * rng.randrange(50)) for k in range(20)]
    docs = spark.createDataFrame(rows(pairs), DOCS)
    texts, places = substrings.repeated_places(docs, 12, 4)
    found = {(r._uid, r._tie): r.places for r in places.collect()}
    have = []
    for r in texts.collect():
        words = WORD.findall(r.text or "")
        covered = {k + j for k in found.get((r._uid, r._tie)) or () for j in range(12)}
        have.append((r._row.doc_id, len(words), len(covered), " ".join(w for k, w in enumerate(words) if k not in covered)))
    assert sorted(map(str, have)) == brute_kept(pairs, 12)


ITEMS = [
    (1, "A farmer named Miller sells 12 apples and 30 pears for 5 dollars each week at the market in town."),
    (2, "Which river flows through the old city and ends in the northern sea after many long bends?"),
    (3, None),
    (4, ""),
    (None, "an item without a number but with a few words in it"),
    (5, "short one"),
]


def test_decontamination(spark, docs, none):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = {
        1: "Intro. " + ITEMS[0][1] + " More words follow here.",
        2: "A farmer named Baker sells 99 apples and 7 pears for 41 dollars each week at the market in town.",
        3: ITEMS[1][1].upper(),
        4: "Which river flows through the old city? Nobody knows, and the text goes on without it.",
        5: "12 30 5 12 30 5 12 30 5 12 30 5 12 30 5",
        6: None,
        7: "clean words only, nothing to see in this text at all",
    }
    held = spark.createDataFrame(rows(list(texts.items())), DOCS)
    found = {r._row.doc_id: r["items"] for r in decontamination.marked(held, benchmark).collect()}
    assert found == {1: [1], 2: [1], 3: [2], 4: [], 5: [], 6: [], 7: []}
    kept = decontamination.clean(held, benchmark)
    assert kept.columns == held.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    assert decontamination.clean(docs, benchmark).count() == len(ROWS)
    assert decontamination.marked(none, benchmark).count() == 0
    assert decontamination.clean(held, benchmark.limit(0)).count() == 7


def test_siblings_are_told_apart(spark):
    """Items that differ in one plain word: a text of one is not marked with the others; with other numbers in it, all fit."""
    ask = lambda colour, n: f"Pick the answer that fits the question best for case {colour} when {n} boats leave the quiet harbour in the early morning"
    colours = ["red", "blue", "green", "black", "white", "brown"]
    benchmark = spark.createDataFrame([(k, ask(c, 3)) for k, c in enumerate(colours)] + [(10, ask("red", 7))], "item_id long, text string")
    docs = spark.createDataFrame(rows([(k, f"Some words first. {ask(c, 3)}. And more words after.") for k, c in enumerate(colours)] + [(20, ask("blue", 3) + ". " + ask("white", 3))]), DOCS)
    found = {r._row.doc_id: r["items"] for r in decontamination.marked(docs, benchmark).collect()}
    assert found == {0: [0, 10], 1: [1], 2: [2], 3: [3], 4: [4], 5: [5], 20: [1, 4]}


def test_slots_must_agree(spark):
    """The same template with a value that stands for two others is no copy."""
    item = "Of 10 red boxes 10 were sold and of the rest 10 went back to the 10 shops they came from."
    agree, differ = item.replace("10", "25"), "Of 1 red boxes 2 were sold and of the rest 3 went back to the 4 shops they came from."
    docs = spark.createDataFrame(rows([(1, agree), (2, differ)]), DOCS)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r._row.doc_id: r["items"] for r in decontamination.marked(docs, benchmark).collect()} == {1: [1], 2: []}


def held_items(spark, items, texts):
    docs = spark.createDataFrame(rows(list(texts.items())), DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {r._row.doc_id: r["items"] for r in decontamination.marked(docs, benchmark).collect()}


def test_number_heavy_and_short_items(spark):
    items = [(1, "What comes next 2 4 8 16 32 64 128"), (2, "name the planet"), (3, "7 kg")]
    texts = {
        1: "Copied here: What comes next 2 4 8 16 32 64 128 and then on.",
        2: "What comes next 3 9 27 81 243 729 2187",
        3: "Long before anybody could Name the Planet, it was seen by sailors.",
        4: "A bag of 7 kg was left at the door of the shop that night.",
        5: "A bag of 8 kg was left at the door of the shop that night.",
        6: "8 kg",
    }
    assert held_items(spark, items, texts) == {1: [1], 2: [], 3: [2], 4: [3], 5: [], 6: [3]}


def test_items_with_other_values(spark):
    items = [
        (1, "There is a small market held every morning in town. Anna has 5 apples and gives two of them to her brother before lunch."),
        (2, "The distance between Paris and the harbour is 300 km and a train needs three hours for the whole way along the river coast."),
        (3, " ".join(f"term{k}" for k in range(40))),
        (4, " ".join(f"part{k}" for k in range(20))),
    ]
    texts = {
        1: "There is a small market held every morning in town. Ben has 7 apples and gives four of them to her brother before lunch.",
        2: "The distance between New York City and the harbour is 250 and a train needs 2 hours for the whole way along the river coast.",
        3: "Before it " + " ".join(f"term{k}" for k in range(26)) + " comes something else",
        4: " ".join("other" if k == 9 else f"part{k}" for k in range(20)),
        5: "Before it " + " ".join(f"term{k}" for k in range(16)) + " comes something else",
    }
    assert held_items(spark, items, texts) == {1: [1], 2: [2], 3: [3], 4: [4], 5: []}
