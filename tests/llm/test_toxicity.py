"""The toxicity grammar against its transducers run one by one, and the classifier on texts it has not seen."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinefuse.llm import toxicity as tox

from .conftest import DOCS, ROWS, rows

PARTS = (tox._INSULT, tox._TARGET, tox._THREAT, tox._NEGATION, tox._REPORT)


def plain_clauses(text, lexicon):
    """Matched clauses of a text: each transducer walks each clause for itself."""
    text = re.sub(r"[.!?;\n]+", " . ", re.sub("['’]", "", (text or "").lower()))
    words = re.sub(r"[^\w.]+|_", " ", text).split()
    found, clause, place = [], [], 0
    for word in [*words, "."]:
        if word != ".":
            cls, weight = (x[0] for x in lexicon.read([word]))
            if cls:
                clause.append((place, cls, weight))
            place += 1
            continue
        total, accepted = sum(w for _, _, w in clause), False
        for part in PARTS:
            state, before = 0, None
            for at, cls, _ in clause:
                if before is not None and at - before > tox.NEAR:
                    state, w = part.moves.get((state, tox.FAR), (state, 0.0))
                state, w = part.moves.get((state, cls), (state, 0.0))
                total, before = total + w, at
            accepted |= state in part.accepting
        if accepted and total > 0:
            found.append((clause[0][0], clause[-1][0], round(total, 9)))
        clause = []
    return found


def test_machine_against_its_parts():
    rng = random.Random(3)
    some = ["you", "idiot", "not", "said", "kill", "him", "a", "the", "scum", "never", ".", "!", "\n", "don't", "IDIOTS", "x_y", "Ärger", ",", "called"]
    texts = ["", None, " . ", "you are not an idiot. You idiot!", "He said: you are scum", "I will kill you", "kill time"]
    texts += [" ".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(300)] + [" ".join(["idiot"] * 5000)]
    lexicon = tox.Lexicon()
    text, first, last, scores, n_words = tox.clauses(pa.array(texts), lexicon, tox.GRAMMAR)
    for k, wanted in enumerate(texts):
        at = text == k
        assert list(zip(first[at].tolist(), last[at].tolist(), scores[at].round(9).tolist())) == plain_clauses(wanted, lexicon), wanted
    score = lambda t: sum(s for _, _, s in plain_clauses(t, lexicon))
    assert score("you idiot") > score("an idiot") > score("people said what an idiot") > 0
    assert score("not an idiot") < score("an idiot") and score("i will kill you") > 0 == score("kill the lights")
    assert score("not one of the many people here is an idiot") == score("an idiot")


def corpus(rng, count, base=0):
    """Texts of made-up words; one in six is toxic and holds fixed insults or words of a made-up stem."""
    syllables = ["ra", "to", "mi", "len", "sha", "ou", "the", "on", "er", "ti", "el", "po"]
    out, marks = [], {}
    for k in range(count):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(10, 200))]
        words = [w for w in words if not w.startswith("zaqu")]
        toxic = rng.random() < 1 / 6
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum"]) if k % 2 else "zaqu" + rng.choice(syllables))
        out.append((base + k, ". ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))))
        marks[base + k] = int(toxic)
    return out, marks


def test_held_out_texts(spark):
    texts, marks = corpus(random.Random(7), 900)
    texts += [(5000, texts[0][1]), (5001, None), (5002, "")]
    frame = spark.createDataFrame(rows(texts), DOCS)
    labels = spark.createDataFrame([(i, t, 1) for i, t in marks.items()] + [(None, 1, 1), (3, None, 1), (99_999, 1, 1), (4, marks[4], 0)], "doc_id long, toxic int, n int")
    model = tox.train(frame, labels)
    assert any(s.startswith("zaqu") for s in model.lexicon.stems)
    found = {r.doc_id: r for r in tox.scored(frame, model).select("_row.doc_id", "text", "score", "clauses").collect()}
    assert len(found) == len(texts) and all(0 <= r.score <= 1 for r in found.values())
    unseen = [i for i in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(found[i].score >= tox.LEAST_SCORE) == bool(marks[i]) for i in unseen]
    assert np.mean(right) > 0.98 and found[5002].score == found[5001].score < 0.1
    assert found[5000].score == found[0].score
    # Labels of rows that are held out, and doc_ids, change nothing.
    other = labels.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tox.train(frame, other) == model


def test_edges(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.train(docs, empty) == tox.Model() == tox.train(none, empty)
    one_class = spark.createDataFrame([(i, 0) for i in range(10)], "doc_id long, toxic int")
    assert tox.train(docs, one_class) == tox.Model()
    out = tox.scored(docs, tox.Model())
    assert out.count() == len(ROWS) and tox.scored(none, tox.Model()).count() == 0
    assert out.select("_row.*").columns == [c for c in docs.columns if c != "text"]
