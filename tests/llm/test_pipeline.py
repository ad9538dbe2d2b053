"""The pipeline's stages, each against brute force on its own input, with nulls, repeated rows, clashing names and nothing at all."""

import random
import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from kinefuse.llm import rule_ensemble
from kinefuse.llm.tokens import default_tokenizer
from kinefuse.storage import new_path

from .conftest import DOCS, PASSAGE, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEMS = [(1, "Which old stone bridge crosses the slow green river below the northern mill near the village?"), (2, None), (None, "x y z")]


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)) for _ in range(n)) + "."
    good = [prose(rng.randrange(6, 20)) for _ in range(120)]
    bad = [" ".join("BUY!! NOW$$$ ###" for _ in range(rng.randrange(20, 60))) for _ in range(40)]
    near = [f"{t} ending {k}" for k, t in enumerate(good[:8])]
    shared = [f"{prose(4)} {PASSAGE} {prose(3)}" for _ in range(4)]
    leaked = [f"{prose(5)} {ITEMS[0][1]} {prose(4)}" for _ in range(3)]
    texts = [*good, *bad, *near, *shared, *leaked]
    pairs = list(enumerate(texts)) + [(0, texts[0]), (3, texts[3]), (None, good[9] + " once more"), (None, good[9] + " twice more"), (500, None), (501, ""), (None, None), (None, None)]
    labels = [(k, int(t not in bad), 0) for k, t in enumerate(texts)] + [(None, 1, 0), (500, 0, 0)]
    return pairs, labels


def folder(spark, docs, labels, items):
    path = new_path(spark, "pipeline-tables")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stages(spark, path):
    """Input and output of each stage."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = new_path(spark, name)
        stage(spark, docs, path).write.parquet(out)
        after = spark.read.parquet(out)
        if name != "pack":
            assert after.columns == docs.columns
        yield name, docs, after
        docs = after


def listed(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stages_against_brute_force(spark):
    pairs, labels = corpus()
    path = folder(spark, spark.createDataFrame(rows(pairs), DOCS), labels, ITEMS)
    done = {}
    for name, before, after in stages(spark, path):
        done[name] = (listed(before), listed(after) if name != "pack" else after.collect())
        if name == "quality_classifier":
            model = rule_ensemble.train(before, spark.read.parquet(f"{path}/labels.parquet"))
            table = rule_ensemble.with_statistics(before).select("_row.doc_id", "_row.text", *rule_ensemble.NAMES).collect()
            values = np.array([r[2:] for r in table], float)
            total = model.intercept + sum(w * np.logical_and.reduce([c.holds(values) for c in rule]) for rule, w in model.rules)
            kept = sorted(((r.doc_id, r.text) for r, t in zip(table, total, strict=True) if 1 / (1 + np.exp(-t)) >= 0.3), key=str)
            assert done[name][1] == kept and len(kept) < len(pairs) - 30

    before, after = done["near_dedup"]
    sets = [shingles(t) for _, t in before]
    group = list(range(len(before)))
    for _ in range(3):
        for a in range(len(before)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    groups = {}
    for row, g, s in zip(before, group, sets, strict=True):
        groups.setdefault(g if s else row, []).append(row)
    assert len(after) == len(groups)
    for members in groups.values():
        ids = [i for i, _ in members]
        kept = [r for r in after if r in members]
        assert len(kept) == 1 and kept[0][0] == min((i for i in ids if i is not None), default=None)

    before, after = done["substring_dedup"]
    seen = {}
    for _, text in before:
        words = WORD.findall(text or "")
        for k in range(len(words) - 34):
            run = tuple(words[k : k + 35])
            seen[run] = seen.get(run, 0) + 1
    wanted = []
    for i, text in before:
        words = WORD.findall(text or "")
        gone = {k + j for k in range(len(words) - 34) if seen[tuple(words[k : k + 35])] > 1 for j in range(35)}
        wanted.append((i, " ".join(w for k, w in enumerate(words) if k not in gone) if gone else text))
    assert after == sorted(wanted, key=str) and sum("shared7" in (t or "") for _, t in after) == 0

    before, after = done["decontaminate"]
    assert after == [r for r in before if ITEMS[0][1] not in (r[1] or "")] and len(after) < len(before)

    before, pieces = done["pack"]
    plain = Tokenizer.from_file(default_tokenizer())
    wanted = sorted(str((i, plain.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in before)
    found, stream = [], sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    for p in stream:
        if p.start == 0:
            found.append((p.doc_id, []))
        found[-1][1].extend(np.frombuffer(p.ids, "<u4").tolist())
    assert sorted(map(str, found)) == wanted
    places = [p.sequence_id * 1024 + p.offset for p in stream]
    assert places == np.cumsum([0, *(p.length for p in stream)])[:-1].tolist()


def shingles(text, size=5):
    words = WORD.findall((text or "").lower())
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def test_nothing(spark, none):
    path = folder(spark, none, [], [])
    counts = [(name, after.count()) for name, _, after in stages(spark, path)]
    assert counts == [(name, 0) for name, _ in corpus_pipeline.STAGES]


def test_run_on_documents_of_other_types(spark):
    """Narrow ids and columns that are named like those of the operators; a run gives what its stages give."""
    schema = T.StructType([T.StructField("doc_id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("token", T.StringType()), T.StructField("node", T.IntegerType()), T.StructField("items", T.StringType()), T.StructField("score", T.DoubleType())])
    pairs, labels = corpus()
    docs = spark.createDataFrame([(i, t, "a", 1, "b", 0.5) for i, t in pairs[:60]], schema)
    path = folder(spark, docs, labels, ITEMS)
    for name, before, after in stages(spark, path):
        assert after.count() > 0 and (name == "pack" or after.schema["doc_id"].dataType == before.schema["doc_id"].dataType)
    lengths = lambda frame: sorted(map(str, frame.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()))
    assert lengths(corpus_pipeline.run(spark, path)) == lengths(after)
