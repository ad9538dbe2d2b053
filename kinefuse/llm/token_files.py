"""Token ids in ORC files.

Documents are dealt out by ranges of doc_id and sorted, so every file, stripe and row group covers a
narrow range of ids. ORC writes the id lists with its integer run-length encoding, keeps minimum and
maximum of doc_id for each row group, and a Bloom filter of it. Readers take stripes in parallel, and
a search for some documents skips the row groups that cannot hold them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinefuse.llm.queries import llm_query, table
from kinefuse.llm.shipping import ship
from kinefuse.llm.tokens import default_tokenizer, encoded_runs, task_number
from kinefuse.storage import new_path

SCHEMA = "doc_id long, n_tokens long, part long, place long, ids array<int>"
OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the ids of every document, with the end id, in ascending doc_id order.

    A null text counts as empty. Null ids come first; rows with one doc_id follow each other by a hash of
    their texts, so a doc_id that very many rows share spreads over files as well. Only texts are dealt out (not ids), so the tokenizer runs once and after the shuffle.
    """
    vocabulary = tokenizer or default_tokenizer()
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = task_number(), 0
        for rows, ids, begins in encoded_runs(batches, vocabulary):
            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(begins)), pa.array(np.full(rows.num_rows, part)), pa.array(place + begins[:-1]), lists],
                ["doc_id", "n_tokens", "part", "place", "ids"],
            )
            place += int(begins[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(encode, SCHEMA).write.options(**OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """Rows of the files: doc_id, n_tokens, part and place (ids before it in its file's range), ids.

    `wanted`, a condition on doc_id, is pushed down to the files' indexes and Bloom filters.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if wanted is None else rows.where(wanted)


def with_start(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before. all_rows: the whole files, from which only n_tokens by part are read.

    The sums are one row per part, no more than the list of partitions, and are broadcast.
    """
    totals = all_rows.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("_before") + F.col("place")).drop("_before", "place", "part")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        begins = lists.offsets.to_numpy().astype(np.int64)
        values = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
        crcs = [zlib.crc32(values[a * 4 : b * 4]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        columns = {n: batch.column(n) for n in ("doc_id", "part", "place")}
        yield pa.RecordBatch.from_pydict(columns | {"n_tokens": pa.array(np.diff(begins)), "ids_crc32": pa.array(crcs, pa.int64())})


@llm_query()
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Writes all documents to token files and gives what is read back from them."""
    path = new_path(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), path)
    rows = read_token_files(spark, path)
    read = rows.mapInArrow(_digest, "doc_id long, part long, place long, n_tokens long, ids_crc32 long")
    return with_start(read, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
