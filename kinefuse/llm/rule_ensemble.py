"""A quality classifier as a sparse ensemble of rules (Friedman and Popescu, 2008).

Statistics of each text are built-in expressions. Shallow trees are boosted on labelled texts; every
path from a root is a rule, a conjunction of thresholds on statistics. A logistic regression with an
L1 penalty keeps few of the rules, and what is left becomes one Spark column: a sum of weights under
CASE conditions. Scoring is one pass without Python, shuffle or state.

Fitting takes at most SAMPLE_ROWS labelled rows, a fixed choice by hash; their statistics, not their
texts, come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.llm.quality_rules import full_lines, repeated_lines, words_of
from kinefuse.llm.queries import llm_query, table

#: Labelled rows that a model is fitted on at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, CUTS, LEAST_LEAF = 24, 3, 24, 10
RATE = 0.3
#: L1 penalty per row.
PENALTY = 4e-4
STEPS = 400
#: Texts with a score below this are rejected.
LEAST_SCORE = 0.3
FOLDS = 5


def statistics(text: Column) -> dict[str, Column]:
    """Statistics that do not depend on a language. Counts are relative to words or characters; an empty text has zeros."""
    filled = F.coalesce(text, F.lit(""))
    words = F.col("_words")
    count = lambda pattern: F.regexp_count(filled, F.lit(pattern)).cast("double")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_chars = F.greatest(F.length(filled), F.lit(1)).cast("double")
    n_lines = F.greatest(full_lines(text), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(F.array_join(words, "")) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "words_per_line": F.size(words) / n_lines,
        "repeated_lines": repeated_lines(text) / n_lines,
        "symbols": count(r"[#*$%&|<>@{}\[\]\\/_=+~^]") / n_words,
        "exclaimed": count(r"[!?]") / n_words,
        "stops": count(r"[.,;:]") / n_words,
        "digits": count(r"\d") / n_chars,
        "capitals": count(r"\p{Lu}") / n_chars,
        "spaces": count(r"[\x20\x09-\x0D]") / n_chars,
    }


NAMES = ("log_words", "word_length", "distinct_words", "words_per_line", "repeated_lines", "symbols", "exclaimed", "stops", "digits", "capitals", "spaces")


def with_statistics(docs: DataFrame) -> DataFrame:
    """_row (all columns of docs) and the statistics of its text."""
    rows = docs.select(F.struct("*").alias("_row"), words_of(docs["text"]).alias("_words"))
    return rows.select("_row", *(column.alias(name) for name, column in statistics(F.col("_row.text")).items()))


@dataclass(frozen=True)
class Condition:
    feature: int
    cut: float
    above: bool

    def holds(self, values: np.ndarray) -> np.ndarray:
        column = values[:, self.feature]
        return column > self.cut if self.above else column <= self.cut

    def column(self) -> Column:
        value = F.col(NAMES[self.feature])
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


@dataclass(frozen=True)
class Model:
    """A logistic sum of weighted rules."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        """The model as an expression on the statistics' columns."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            all_hold = conditions[0].column()
            for other in conditions[1:]:
                all_hold = all_hold & other.column()
            total = total + F.when(all_hold, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(values, cuts, codes, residual, hessian) -> list[tuple[tuple[Condition, ...], np.ndarray, float]]:
    """Nodes below the root of a tree grown greedily on Newton gain: path, rows, value."""
    found, level = [], [((), np.arange(len(values)))]
    for _ in range(DEPTH):
        grown = []
        for path, rows in level:
            best = (1e-6, None, None)
            for feature in range(values.shape[1]):
                size = len(cuts[feature]) + 1
                if size < 2:
                    continue
                g = np.bincount(codes[rows, feature], residual[rows], size).cumsum()
                h = np.bincount(codes[rows, feature], hessian[rows], size).cumsum()
                n = np.bincount(codes[rows, feature], minlength=size).cumsum()
                left, right = n[:-1] >= LEAST_LEAF, n[-1] - n[:-1] >= LEAST_LEAF
                gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
                gain = np.where(left & right, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], feature, k)
            if best[1] is None:
                continue
            _, feature, k = best
            below = codes[rows, feature] <= k
            for above, part in ((False, rows[below]), (True, rows[~below])):
                node = (*path, Condition(feature, float(cuts[feature][k]), above))
                found.append((node, part, residual[part].sum() / (hessian[part].sum() + 1)))
                grown.append((node, part))
        level = grown
    return found


def boosted_rules(values: np.ndarray, labels: np.ndarray) -> list[tuple[Condition, ...]]:
    """Distinct paths of boosted trees."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 2)[1:-1])) for column in values.T]
    codes = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, values.T, strict=True)], axis=1)
    margin, rules = np.zeros(len(labels)), {}
    for _ in range(TREES):
        p = _sigmoid(margin)
        nodes = _tree(values, cuts, codes, labels - p, p * (1 - p))
        inner = {path[:-1] for path, _, _ in nodes}
        for path, rows, value in nodes:
            rules.setdefault(tuple(sorted(path, key=lambda c: (c.feature, c.cut, c.above))))
            if path not in inner:
                margin[rows] += RATE * value
    return list(rules)


def lasso(design: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal gradient."""
    rows = np.column_stack([np.ones(len(labels)), design])
    step = 4 / max(np.linalg.eigvalsh(rows.T @ rows / len(labels))[-1], 1e-9)
    weights = np.zeros(rows.shape[1])
    ahead, t = weights.copy(), 1.0
    for _ in range(STEPS):
        moved = ahead - step * (rows.T @ (_sigmoid(rows @ ahead) - labels)) / len(labels)
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * PENALTY, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, weights, t = moved + (t - 1) / t_next * (moved - weights), moved, t_next
    return float(weights[0]), weights[1:]


def fit(values: np.ndarray, labels: np.ndarray) -> Model:
    """With no rows, every score is one half; with one class, its smoothed share."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    if len(np.unique(labels)) < 2:
        return Model(float(np.log(share / (1 - share))), ())
    rules = boosted_rules(values, labels)
    if not rules:
        return Model(float(np.log(share / (1 - share))), ())
    design = np.stack([np.logical_and.reduce([c.holds(values) for c in path]) for path in rules], axis=1).astype(float)
    intercept, weights = lasso(design, labels)
    return Model(intercept, tuple((path, float(w)) for path, w in zip(rules, weights, strict=True) if w != 0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most sample_rows labelled rows that are not held out. Rows with equal doc_id, text and label count once; a doc_id with two labels teaches both.

    The chosen ids are broadcast: there are no more of them than sample_rows. Null ids and null labels teach nothing.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    chosen = known.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality")).orderBy(F.xxhash64("_id"), "_id", "_quality").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = with_statistics(rows).select(
        "_row.doc_id", F.col("_row._quality").cast("double").alias("_quality"), F.xxhash64("_row.text").alias("_h1"), F.xxhash64(F.lit(1), "_row.text").alias("_h2"), *NAMES
    )
    # From here on rows are numbers: two hashes stand for a text.
    rows = rows.groupBy("doc_id", "_quality", "_h1", "_h2").agg(*(F.min(n).alias(n) for n in NAMES))
    taught = rows.orderBy("_h1", "_h2", "doc_id", "_quality").limit(sample_rows).select("doc_id", "_quality", *NAMES)
    found = np.array([tuple(row) for row in taught.collect()], float).reshape(-1, len(NAMES) + 2)
    found = found[np.lexsort(found.T[::-1])]
    return fit(found[:, 2:], (found[:, 1] > 0.5).astype(float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """_row (all columns of docs) and score. Null and empty texts are scored by their zero statistics."""
    return with_statistics(docs).select("_row", model.score().alias("score"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, in all their columns, that a model fitted on the labels scores LEAST_SCORE or more."""
    return scored(docs, train(docs, labels)).where(F.col("score") >= LEAST_SCORE).select("_row.*")


@llm_query()
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """A score for every document."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    rows = scored(docs, train(docs, labels))
    return rows.select("_row.doc_id", held_out(F.col("_row.doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
