"""Sections, metadata tables and the delivered dataset as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kinefuse.operators.export import section_rows, sort_by_time
from kinefuse.operators.network import named_elements
from kinefuse.sinks.replace import replace_table


def write_sections(kinematics: DataFrame, path: str, mode: str = "append") -> None:
    """Append kinematic rows to their sections.

    Rebalancing gathers the rows of a section for few files, and splits a section that is large.
    """
    rows = section_rows(kinematics).hint("rebalance", "section")
    rows.write.mode(mode).partitionBy("section").parquet(path)


def write_metadata(nodes: DataFrame, edges: DataFrame, associations: DataFrame, folder: str) -> None:
    """Replace the node names, edge names and association tables, each by one that is complete."""
    tables = {
        "node_metadata": named_elements(nodes),
        "edge_metadata": named_elements(edges),
        "data_associations": associations,
    }
    for name, table in tables.items():
        replace_table(table, f"{folder}/{name}")


def write_unified(unified: DataFrame, path: str) -> bool:
    """Replace the dataset by one sorted by time. Without rows nothing is written and False is returned."""
    if unified.isEmpty():
        return False
    replace_table(sort_by_time(unified), path, compression="snappy")
    return True
