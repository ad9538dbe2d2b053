"""The queries of this subpackage and the SQL that checks them, by name; each operator's module registers its own."""

from __future__ import annotations

import importlib

from kinefuse.workloads.registry import Query

LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}

MODULES = ("packing", "token_files", "substrings", "near_duplicates", "quality_rules", "chat_format", "warc", "rule_ensemble", "html_text", "decontamination", "prefix_trie", "whitening", "toxicity")


def llm_query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows if there is one."""

    def register(function: Query) -> Query:
        LLM_QUERIES[function.__name__] = function
        if sql is not None:
            LLM_ORACLES[function.__name__] = sql
        return function

    return register


def table(spark, folder: str, name: str):
    """A whole table of the given folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"kinefuse.llm.{module}")
    pipeline = importlib.import_module("corpus_pipeline")
    LLM_QUERIES["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL:
        LLM_ORACLES["pipeline"] = pipeline.ORACLE_SQL
    return LLM_QUERIES, LLM_ORACLES
