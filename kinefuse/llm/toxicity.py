"""Toxicity by a grammar of weighted finite-state transducers.

A lexical transducer reads the words of a clause and writes classes: insult (with a weight), threat,
target, negation, reported speech; other words write nothing. Five small transducers read the classes:

- insult: a clause with an insult is matched;
- target: a person named before or after the insult adds to it;
- threat: a threat against a person is matched;
- negation: shortly before an insult or a threat it takes from it;
- reported speech: what others are said to have said counts less.

They are composed into one machine, whose states are their states' combinations and whose moves add
their weights. A clause's score is the weight of its path, if a state of acceptance is reached, and a
text's score is logistic in its clauses' scores. Isolated words score nothing but through their clause.

The insults are a fixed list and stems learned from labelled texts: a stem (first letters of words) counts if
far more toxic than clean texts hold it. The logistic weights are fitted on labelled texts that taught no
stem. Fitting takes about SAMPLE_ROWS labelled rows, chosen by hash; counts and four numbers a text come to the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.llm.queries import llm_query, table
from kinefuse.llm.shipping import ship
from kinefuse.llm.words import coded_words, runs
from kinefuse.storage import write_and_read

#: Labelled rows that a model is fitted on, as expected by the hash; and stems that it keeps at most.
SAMPLE_ROWS, STEMS = 40_000, 20_000
#: Letters of stems; toxic texts that hold one at least; least likelihood ratio (some 1 in 30,000 by chance) and log odds.
SHORTEST, LONGEST, LEAST_TEXTS, LEAST_RATIO, LEAST_ODDS = 3, 24, 4, 17.0, 2.0
#: Part of the texts that the logistic weights are fitted on: one in so many.
PARTS = 3
#: Texts that a task takes at once; a stem takes some ten times its letters.
RUN_BYTES = 2_000_000
LEAST_SCORE = 0.7
FOLDS, HELD = 3, 1
#: Words between a negation and what it denies at most.
NEAR = 4

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, FAR = range(7)

# Words of the classes.
INSULTS = "idiot moron stupid scum trash loser clown worthless pathetic disgusting imbecile bastard bitch asshole cretin vermin parasite filth garbage retard coward pig dumb ugly".split()
THREATS = "kill hurt beat destroy burn shoot stab strangle murder crush smash punish drown hang".split()
TARGETS = "you your yours youre yourself he him his she her they them their hes shes theyre".split()
NEGATIONS = "not never no nobody dont doesnt didnt isnt arent wasnt werent wont cannot cant without hardly".split()
REPORTS = "said says say called calls told wrote writes claimed claims quoted quotes reported reportedly alleged allegedly according".split()

#: Weights of the grammar, in log odds as those of insults.
SEED, TARGETED, THREATENED, DENIED, REPORTED, MOST = 2.5, 1.0, 3.0, -2.0, -1.0, 6.0


@dataclass(frozen=True)
class Transducer:
    """moves: (state, class) to (state, weight); without one it stays where it is. State 0 is the start."""

    states: int
    moves: dict[tuple[int, int], tuple[int, float]]
    accepting: frozenset[int] = frozenset()


_INSULT = Transducer(2, {(0, INSULT): (1, 0.0)}, frozenset({1}))
_TARGET = Transducer(4, {(0, TARGET): (1, 0.0), (1, INSULT): (3, TARGETED), (0, INSULT): (2, 0.0), (2, TARGET): (3, TARGETED)})
_THREAT = Transducer(4, {(0, TARGET): (1, 0.0), (0, THREAT): (2, 0.0), (1, THREAT): (3, THREATENED), (2, TARGET): (3, THREATENED)}, frozenset({3}))
_NEGATION = Transducer(2, {(0, NEGATION): (1, 0.0), (1, FAR): (0, 0.0), (1, INSULT): (0, DENIED), (1, THREAT): (0, DENIED)})
_REPORT = Transducer(2, {(0, REPORT): (1, 0.0), (1, INSULT): (1, REPORTED), (1, THREAT): (1, REPORTED)})


@dataclass(frozen=True)
class Machine:
    """A composed transducer as tables by state and class."""

    moves: np.ndarray
    weights: np.ndarray
    accepting: np.ndarray


def composed(*parts: Transducer) -> Machine:
    """All parts reading the same classes at once: states are their combinations, weights add up, any part may accept."""
    states = list(itertools.product(*(range(p.states) for p in parts)))
    number = {state: k for k, state in enumerate(states)}
    moves, weights = np.zeros((len(states), FAR + 1), np.int64), np.zeros((len(states), FAR + 1))
    for state, k in number.items():
        for read in range(FAR + 1):
            steps = [p.moves.get((s, read), (s, 0.0)) for p, s in zip(parts, state, strict=True)]
            moves[k, read] = number[tuple(s for s, _ in steps)]
            weights[k, read] = sum(w for _, w in steps)
    return Machine(moves, weights, np.array([any(s in p.accepting for p, s in zip(parts, state, strict=True)) for state in states]))


GRAMMAR = composed(_INSULT, _TARGET, _THREAT, _NEGATION, _REPORT)


@dataclass(frozen=True)
class Lexicon:
    """The lexical transducer: stems of insults with their weights, and the words of the other classes."""

    stems: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, SEED))

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each word; of the stems of a word the heaviest counts."""
        classes, weights = np.zeros(len(words), np.int64), np.zeros(len(words))
        others = {w: c for c, known in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in known}
        lengths = sorted({len(s) for s in self.stems})
        stems = self.stems
        for k, word in enumerate(words):
            if word in others:
                classes[k] = others[word]
                continue
            best = 0.0
            for n in lengths:
                if n > len(word):
                    break
                weight = stems.get(word[:n])
                if weight is not None and weight > best:
                    best = weight
            if best:
                classes[k], weights[k] = INSULT, best
        return classes, weights


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon = Lexicon()
    #: Logistic weights: constant, log of the sum of clause scores, the highest, log of their sum in a thousand words.
    weights: tuple[float, ...] = (-4.0, 1.0, 0.6, 0.5)


def normalised(texts: pa.Array) -> pa.Array:
    """Lower-case words with single spaces in between; ends of clauses are words of one stop."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    texts = pc.replace_substring_regex(texts, "['’]", "")
    texts = pc.replace_substring_regex(texts, r"[.!?;\n]+", " . ")
    return pc.replace_substring_regex(texts, r"[^\pL\pM\pN.]+", " ")


def clauses(texts: pa.Array, lexicon: Lexicon, machine: Machine) -> tuple[np.ndarray, ...]:
    """Of every matched clause its text, first and last word (counted without stops) and score; and the number of words of each text."""
    codes, names, begins = coded_words(normalised(texts))
    names = names.to_pylist()
    classes, weights = lexicon.read(names)
    stop = np.array([n == "." for n in names], bool)[codes] if len(names) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    word = np.cumsum(~stop) - 1
    first_word = np.concatenate(([0], np.cumsum(~stop)))[begins]
    clause = np.cumsum(stop) + owner  # a new text is a new clause
    events = np.flatnonzero(classes[codes] != OTHER) if len(names) else np.zeros(0, np.int64)
    read, of = classes[codes[events]], clause[events]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))[: len(of)]
    count = np.diff(np.append(begin, len(of)))
    far = np.append(False, np.diff(word[events]) > NEAR)
    # All clauses take their first step, then their second; the longest ones go first.
    order = np.argsort(-count, kind="stable")
    start, count = begin[order], count[order]
    state, total = np.zeros(len(start), np.int64), np.zeros(len(start))
    for step in range(int(count[0]) if len(count) else 0):
        active = int(np.searchsorted(-count, -step, "left"))
        at, now = start[:active] + step, state[:active]
        if step:
            now = np.where(far[at], machine.moves[now, FAR], now)
        total[:active] += machine.weights[now, read[at]] + weights[codes[events[at]]]
        state[:active] = machine.moves[now, read[at]]
    matched = np.flatnonzero(machine.accepting[state] & (total > 0)) if len(state) else np.zeros(0, np.int64)
    matched = matched[np.argsort(start[matched], kind="stable")]
    text = owner[events[start[matched]]] if len(matched) else np.zeros(0, np.int64)
    first = word[events[start[matched]]] - first_word[text]
    last = word[events[start[matched] + count[matched] - 1]] - first_word[text]
    return text, first, last, total[matched], np.diff(first_word)


def features(text: np.ndarray, scores: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The logistic model's inputs for each text, from its matched clauses."""
    total = np.bincount(text, scores, len(n_words))
    highest = np.zeros(len(n_words))
    np.maximum.at(highest, text, scores)
    return np.column_stack([np.ones(len(n_words)), np.log1p(total), np.minimum(highest, 2 * MOST), np.log1p(1000 * total / np.maximum(n_words, 1))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of a ridge logistic regression, by Newton's method."""
    weights = np.zeros(rows.shape[1])
    keep = np.diag([1e-6, *[ridge] * (rows.shape[1] - 1)])
    for _ in range(40):
        p = _sigmoid(rows @ weights)
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p) + 1e-9)[:, None]) + keep, rows.T @ (p - labels) + keep @ weights)
        weights = weights - step / max(1.0, np.abs(step).max() / 4)
    return tuple(weights.tolist())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def _chosen(column: str, rows: DataFrame, wanted: int) -> DataFrame:
    """About `wanted` rows by a hash of a column, all if there are no more."""
    count = rows.count()
    return rows if count <= wanted else rows.where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int((1 << 30) * wanted / count))


def taught(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """text, toxic, part of the labelled texts that a model learns from. Equal texts count once; of two labels the toxic one holds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    # About sample_rows ids, whatever the table's size.
    known = F.broadcast(_chosen("_id", known, sample_rows))
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id").cast("long") == F.col("_id"))
    key = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2")]
    rows = rows.groupBy(*key).agg(F.max("_toxic").alias("toxic"), F.first("text").alias("text"))
    rows = write_and_read(rows, "labelled-texts")
    return _chosen("h", rows, sample_rows).select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod("h2", F.lit(PARTS)).cast("int").alias("part"))


COUNTED = "stem string, toxic0 long, clean0 long, toxic1 long, clean1 long"


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean texts that hold each stem, those of part 0 apart."""
    for rows in runs(batches, run_bytes=RUN_BYTES):
        codes, names, begins = coded_words(normalised(rows.column("text")))
        if not len(names):
            continue
        owner = np.repeat(np.arange(rows.num_rows), np.diff(begins))
        pairs = np.unique(owner * len(names) + codes)
        owner, codes = np.divmod(pairs, len(names))
        stems: dict[str, int] = {}
        of_word, sizes = [], np.zeros(len(names), np.int64)
        for k, word in enumerate(names.to_pylist()):
            own = [stems.setdefault(word[:n], len(stems)) for n in range(SHORTEST, min(len(word), LONGEST) + 1)]
            of_word += own
            sizes[k] = len(own)
        at = np.cumsum(sizes) - sizes
        taken = sizes[codes]
        flat = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken) + np.repeat(at[codes], taken)
        held = np.unique(np.repeat(owner, taken) * max(1, len(stems)) + np.array(of_word, np.int64)[flat])
        owner, stem = np.divmod(held, max(1, len(stems)))
        toxic, other = rows.column("toxic").to_numpy()[owner] > 0, rows.column("part").to_numpy()[owner] > 0
        counts = [np.bincount(stem[(toxic == t) & (other == o)], minlength=len(stems)) for o in (False, True) for t in (True, False)]
        yield pa.RecordBatch.from_arrays([pa.array(list(stems), pa.string()), *map(pa.array, counts)], ["stem", "toxic0", "clean0", "toxic1", "clean1"])


def learned(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """Stems that mark toxic texts, with their log odds, beside the fixed ones.

    counts: stem, toxic and clean texts that hold it; toxic, clean: all texts. A stem gives way to one a letter
    longer that nearly as many toxic texts hold, so a word is learned whole. A fixed insult that clean texts hold as often loses its weight.
    """
    known: dict[str, tuple[int, float]] = {}
    fixed = dict.fromkeys(INSULTS, SEED)
    for stem, t, n in counts:
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))
        expected = (t + n) * toxic / max(1, toxic + clean)
        ratio = 2 * sum(o * np.log(o / e) for o, e in ((t, expected), (n, t + n - expected)) if o)
        if stem in fixed and t + n >= LEAST_TEXTS:
            fixed[stem] = float(np.clip(odds, 0, SEED))
        if t >= LEAST_TEXTS and ratio >= LEAST_RATIO and odds >= LEAST_ODDS:
            known[stem] = (t, float(min(odds, MOST)))
    longer: dict[str, int] = {}
    for stem, (t, _) in known.items():
        longer[stem[:-1]] = max(longer.get(stem[:-1], 0), t)
    stems = {s: w for s, (t, w) in known.items() if longer.get(s, 0) < 0.9 * t}
    return Lexicon({s: w for s, w in fixed.items() if w > 0} | stems)


def _featured(lexicon: Lexicon):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, run_bytes=RUN_BYTES):
            text, _, _, scores, n_words = clauses(rows.column("text"), lexicon, GRAMMAR)
            found = features(text, scores, n_words)
            yield pa.RecordBatch.from_arrays([rows.column("toxic"), *(pa.array(found[:, k]) for k in range(1, 4))], ["toxic", "total", "highest", "dense"])

    return emit


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled texts (labels: doc_id, toxic) that are not held out.

    Null ids, null labels and labels without a document teach nothing. Without texts of both labels the
    fixed words and weights are the model.
    """
    ship(docs.sparkSession)
    rows = write_and_read(taught(docs, labels, sample_rows), "taught")
    sizes = {(r.toxic, r.part > 0): r.n for r in rows.groupBy("toxic", "part").agg(F.count("*").alias("n")).groupBy("toxic", (F.col("part") > 0).cast("int").alias("part")).agg(F.sum("n").alias("n")).collect()}
    size = lambda label, *parts: sum(sizes.get((label, p), 0) for p in parts)
    if not size(1, False, True) or not size(0, False, True):
        return Model()
    counts = rows.mapInArrow(_stem_counts, COUNTED).groupBy("stem").agg(*(F.sum(n).alias(n) for n in ("toxic0", "clean0", "toxic1", "clean1")))
    toxic, clean = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    telling = (toxic >= LEAST_TEXTS) & ((toxic + 0.5) / (size(1, False, True) + 1) >= 4 * (clean + 0.5) / (size(0, False, True) + 1))
    kept = counts.where(telling | F.col("stem").isin(INSULTS)).orderBy(F.col("stem").isin(INSULTS).desc(), toxic.desc(), "stem").limit(STEMS).collect()
    whole = learned([(r.stem, r.toxic0 + r.toxic1, r.clean0 + r.clean1) for r in kept], size(1, False, True), size(0, False, True))
    if not size(1, False) or not size(0, False):
        return Model(whole)
    apart = learned([(r.stem, r.toxic1, r.clean1) for r in kept], size(1, True), size(0, True))
    found = np.array([tuple(r) for r in rows.where("part = 0").select("text", "toxic").mapInArrow(_featured(apart), "toxic int, total double, highest double, dense double").collect()], float)
    found = found[np.lexsort(found.T)]
    return Model(whole, logistic(np.column_stack([np.ones(len(found)), found[:, 1:]]), found[:, 0]))


CLAUSES = "array<struct<first_word: int, last_word: int, score: double>>"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """_row (struct: the columns of docs but the text), text, score (0 to 1), clauses (words from first to last that carry the match, and its score).

    Every row is scored by its own text alone. Null and empty texts have no clause and the score of none.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*(docs[n] for n in docs.columns if n != "text")).alias("_row"), docs["text"])
    weights = np.array(model.weights)
    lexicon = model.lexicon

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, run_bytes=RUN_BYTES):
            text, first, last, scores, n_words = clauses(part.column("text"), lexicon, GRAMMAR)
            score = _sigmoid(features(text, scores, n_words) @ weights)
            at = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(scores)], ["first_word", "last_word", "score"])
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("text"), pa.array(score), pa.ListArray.from_arrays(pa.array(at), items)], ["_row", "text", "score", "clauses"])

    return rows.mapInArrow(emit, f"_row {dict(rows.dtypes)['_row']}, text string, score double, clauses {CLAUSES}")


@llm_query()
def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A score for every document."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    rows = scored(docs, train(docs, labels))
    return rows.select("_row.doc_id", held_out(F.col("_row.doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"), F.size("clauses").cast("long").alias("n_clauses"))
