"""Two numbers that tell the rows of a table of documents apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """_uid and _tie, longs: equal for rows of equal doc_id and text, which share all results.

    Texts of one doc_id differ in a 64-bit hash, texts without one in two.
    """
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text)).alias("_uid"), F.xxhash64(F.lit(1), text).alias("_tie")
