"""A corpus from raw documents to packed training sequences.

Each stage takes all rows that the one before kept, as a table of its own, so a lost executor costs
the tasks it ran and not the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.llm import decontamination, near_duplicates, packing, rule_ensemble, substrings
from kinefuse.llm.queries import table
from kinefuse.storage import write_and_read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule ensemble, fitted on the labels of these documents, accepts."""
    return rule_ensemble.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles at a similarity of 0.8: the one with the least doc_id."""
    return near_duplicates.first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages. Texts without any stay as they are; n_chars follows the text."""
    rows = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    fields = rows.select("_row", text.alias("_text"))
    columns = {name: F.col("_text") if name == "text" else F.col("_row")[name] for name in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return fields.select(*(column.alias(name) for name, column in columns.items()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: No SQL expresses the fitted classifier, the tokenizer or the templates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
