"""Packing by concatenating and cutting.

All documents, each as its token ids and the end id, stand one after the other; the stream is cut
into windows of a fixed length, and a document that crosses a cut becomes several pieces.

Pass one encodes every document where it lies and stores the ids with its place in its partition.
The totals of the partitions, one row each, are then summed up in order, which turns places in
partitions into places in the stream. Pass two cuts: a piece is known from its document's place
alone, so nothing is shuffled and no task sees more than its own documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinefuse.llm.queries import llm_query, table
from kinefuse.llm.shipping import ship
from kinefuse.llm.tokens import default_tokenizer, encoded_runs, task_number
from kinefuse.storage import write_and_read

WINDOW = 1024


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, tokens (binary: unsigned 32-bit little-endian ids with the end id), n, part, place (ids before it in its partition).

    A null text counts as empty and has the end id alone. Repeated rows and ids each count; other columns are left out.
    """
    path = tokenizer or default_tokenizer()
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = task_number(), 0
        for rows, ids, begins in encoded_runs(batches, path):
            counts = np.diff(begins)
            count = rows.num_rows
            if begins[-1] * 4 < 2**31:
                tokens = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer((begins * 4).astype("<i4")), pa.py_buffer(ids)])
            else:
                raise ValueError("a text of more than 500 million tokens")
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), tokens, pa.array(counts), pa.array(np.full(count, part)), pa.array(place + begins[:-1])],
                ["doc_id", "tokens", "n", "part", "place"],
            )
            place += int(begins[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, "doc_id long, tokens binary, n long, part long, place long")


def with_stream_start(encoded: DataFrame) -> DataFrame:
    """Adds stream_start: the ids of all partitions before this one plus the place in it.

    The running sum is over one row per partition; it is no larger than the list of partitions and is broadcast.
    """
    totals = encoded.groupBy("part").agg(F.sum("n").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    return encoded.join(F.broadcast(offsets), "part").withColumn("stream_start", F.col("_before") + F.col("place")).drop("_before")


def cut(encoded: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, doc_tokens, start, length, sequence_id, offset, ids) of documents placed in the stream.

    Sequence k holds the ids k * window to (k + 1) * window - 1 of the stream; only the last one can be
    shorter. A document that crosses a boundary gets one piece on either side of it.
    """
    n, at = F.col("n"), F.col("stream_start")

    def piece(sequence):
        first = F.greatest(sequence * window - at, F.lit(0))
        stop = F.least((sequence + 1) * window - at, n)
        return F.struct(
            first.alias("start"),
            (stop - first).alias("length"),
            sequence.alias("sequence_id"),
            (at + first - sequence * window).alias("offset"),
            F.substring("tokens", (first * 4 + 1).cast("int"), ((stop - first) * 4).cast("int")).alias("ids"),
        )

    windows = F.sequence(F.floor(at / window), F.floor((at + n - 1) / window))
    rows = encoded.select("doc_id", n.alias("doc_tokens"), F.transform(windows, piece).alias("_pieces"))
    return rows.select("doc_id", "doc_tokens", F.explode("_pieces").alias("_piece")).select("doc_id", "doc_tokens", "_piece.*")


def pack_documents(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents packed into sequences of `window` ids; see `cut` for the columns."""
    encoded = write_and_read(encode_documents(docs, tokenizer), "tokens")
    return cut(with_stream_start(encoded), window)


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its ids, and its pieces as boundary records in order. A group has at most a window of ids."""
    record = F.struct("offset", "doc_id", "start", "length", "doc_tokens", "ids")
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(record)).alias("_pieces"))
    return rows.select(
        "sequence_id",
        F.aggregate("_pieces", F.lit(b""), lambda all_ids, x: F.concat(all_ids, x["ids"])).alias("ids"),
        F.transform("_pieces", lambda x: x.dropFields("ids")).alias("pieces"),
    )


@llm_query()
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of all documents; the digests come from the packed ids themselves."""
    pieces = pack_documents(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
