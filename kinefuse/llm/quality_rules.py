"""Quality rules as a short-circuit cascade.

A rule is a condition on a text under which it is rejected. A text is rejected if any rule rejects
it, so the order does not change the verdict, only its cost. Each rule is timed on a sample, which also
shows how much it rejects; rules with the most rejections per second go first, and a text that one
rule rejects is not put to the later ones. Everything is built-in expressions.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.llm.queries import llm_query, table
from kinefuse.storage import write_and_read

#: Rows that costs and rejections are estimated on, as expected by the hash; and times that each rule is timed.
SAMPLE_ROWS, TIMES = 2000, 3
REPEAT_WORDS = 8

_SPACE = r"[\x20\x09-\x0D]+"
_NOT_SPACE = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimates:
    """Seconds of each rule by name, and rows of the sample by the set of rules that reject them."""

    rules: tuple[Rule, ...]
    seconds: dict[str, float]
    rejected: dict[frozenset[str], int]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE, -1), "")


def repeated_words(words: Column, size: int = REPEAT_WORDS) -> Column:
    """Words in runs of `size` words that the text holds twice or more; runs are told apart by 64-bit hashes."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - x, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def found(runs: Column) -> Column:
        placed = F.sort_array(F.transform(runs, lambda x, i: F.struct(x.alias("run"), i.alias("at"))))

        def twice(rows: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(rows, k)["run"] == x["run"], F.lit(False))
            kept = F.filter(rows, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return let(F.sort_array(F.transform(kept, lambda x: x["at"])), covered)

        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), 0).otherwise(let(placed, twice))

    def of_hashes(hashes: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(hashes) - (size - 1)), lambda at: F.xxhash64(F.slice(hashes, at, size)))
        return F.when(F.size(hashes) < size, 0).otherwise(let(runs, found))

    return let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(_NOT_SPACE))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def full_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(_NOT_SPACE))).cast("long")


def statistics(text: Column) -> dict[str, Column]:
    """What the rules look at, each as an expression on the text; a null text counts as empty."""
    words = words_of(text)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": full_lines(text),
        "n_dup_lines": repeated_lines(text),
        "n_repeat_words": repeated_words(words),
    }


def default_rules(stat: dict[str, Column]) -> list[Rule]:
    """Rules in whole numbers, so that every engine draws the same line."""
    return [
        Rule("few_words", stat["n_words"] < 20),
        Rule("repeated_runs", 100 * stat["n_repeat_words"] > 30 * stat["n_words"]),
        Rule("word_length", (stat["word_chars"] < 2 * stat["n_words"]) | (stat["word_chars"] > 12 * stat["n_words"])),
        Rule("symbols", 10 * stat["n_symbols"] > stat["n_words"]),
        Rule("repeated_lines", 100 * stat["n_dup_lines"] > 50 * stat["n_lines"]),
    ]


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> Estimates:
    """Costs and rejections on about sample_rows rows from all over the table. An empty table rejects nothing."""
    count = docs.count()
    rows = docs if count <= sample_rows else docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < int((1 << 30) * sample_rows / count))
    sample = write_and_read(rows, "rule-sample")
    verdict = {rule.name: F.coalesce(rule.rejects, F.lit(False)) for rule in rules}

    def seconds(column: Column) -> float:
        taken = []
        for _ in range(TIMES + 1):
            start = time.perf_counter()
            sample.select(F.sum(column.cast("int"))).collect()
            taken.append(time.perf_counter() - start)
        # The first run also compiles.
        return min(taken[1:])

    empty = seconds(F.length("text") >= 0)
    costs = {name: max(seconds(column) - empty, 1e-4) for name, column in verdict.items()}
    # One row for each set of rules, no more than there are such sets.
    names = F.array_compact(F.array(*(F.when(column, F.lit(name)) for name, column in verdict.items())))
    sets = sample.select(names.alias("names")).groupBy("names").agg(F.count("*").alias("n")).collect()
    return Estimates(tuple(rules), costs, {frozenset(row.names): row.n for row in sets})


def ordered(estimates: Estimates) -> list[Rule]:
    """Rules by rejections per second, each among the rows that those before it leave."""
    left, out, rest = dict(estimates.rejected), [], list(estimates.rules)
    while rest:
        worth = lambda rule: sum(n for names, n in left.items() if rule.name in names) / estimates.seconds[rule.name]  # noqa: B023, E731
        best = max(rest, key=lambda rule: (worth(rule), -estimates.seconds[rule.name]))  # noqa: B023
        out.append(best)
        rest.remove(best)
        left = {names: n for names, n in left.items() if best.name not in names}
    return out


def rejected_by(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects a row, null if none does. Later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def passed(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no default rule rejects, in all their columns. Null and empty texts have too few words."""
    rules = default_rules(statistics(F.col("text")))
    return docs.where(rejected_by(ordered(estimate(docs.select("text"), rules, sample_rows))).isNull())


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS p, words FROM w WHERE len(words) >= 8),
h AS (SELECT doc_id, p, list_slice(words, p, p + 7) AS run FROM g),
r AS (SELECT doc_id, p FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM r, range(0, 8) AS o(k) GROUP BY doc_id),
s AS (
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
        OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM s
"""


@llm_query(ORACLE)
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every document. The cascade runs over the statistics, which the result shows anyway."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    order = [x.name for x in ordered(estimate(docs, default_rules(statistics(F.col("text")))))]
    words = docs.select("doc_id", "text", words_of(F.col("text")).alias("_words"))
    own = statistics(F.col("text")) | {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
    }
    rows = words.select("doc_id", *(column.alias(name) for name, column in own.items()))
    rules = {rule.name: rule for rule in default_rules({name: F.col(name) for name in own})}
    base = rules["few_words"].rejects | rules["repeated_runs"].rejects
    verdict = rejected_by([rules[name] for name in order])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), verdict.isNull().alias("kept"))
