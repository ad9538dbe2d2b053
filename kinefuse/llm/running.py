"""Running sums within keys, over rows that Spark deals out by ranges, so that no key has to fit a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefuse.llm.shipping import ship
from kinefuse.llm.tokens import task_number
from kinefuse.storage import write_and_read

_KINDS = {"sum": (np.add, np.subtract, F.sum), "xor": (np.bitwise_xor, np.bitwise_xor, F.bit_xor)}


def _local(key: str, columns: dict[str, str]):
    """Adds _part and, for each column, its running value over the earlier rows of the same key in this partition."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = task_number(), None, dict.fromkeys(columns, np.int64(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            new = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            goes_on = (begin == 0) & ~new[0]
            arrays, names = [], []
            for name, kind in columns.items():
                put, take, _ = _KINDS[kind]
                values = batch.column(name).to_numpy()
                total = put.accumulate(values)
                before = take(total, values)
                before = take(before, before[begin])
                before = np.where(goes_on, put(before, carried[name]), before)
                carried[name] = put(before[-1], values[-1])
                arrays.append(pa.array(before))
                names.append(f"before_{name}")
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), part)), *arrays], [*batch.schema.names, "_part", *names])

    return add


def with_running(rows: DataFrame, key: str, order: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds before_<name> to rows: for each of the columns (long, never null) the sum or xor over the rows of the same key that go before.

    key is a long and never null. Rows are dealt out by ranges of (key, order), so a key with very many
    rows spreads over partitions; what a partition lacks of a key that began in an earlier one is at most
    one row for each partition, and is broadcast. An empty table stays empty.
    """
    ship(rows.sparkSession)
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    added = [T.StructField("_part", T.LongType()), *(T.StructField(f"before_{n}", T.LongType()) for n in columns)]
    local = write_and_read(ranged.mapInArrow(_local(key, columns), T.StructType([*rows.schema.fields, *added])), "running")
    totals = local.groupBy(key, "_part").agg(*(_KINDS[kind][2](name).alias(name) for name, kind in columns.items()))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lacking = totals.select(key, "_part", *(_KINDS[kind][2](name).over(earlier).alias(f"_lacks_{name}") for name, kind in columns.items()))
    lacking = lacking.where(F.col(f"_lacks_{next(iter(columns))}").isNotNull())
    both = local.join(F.broadcast(lacking), [key, "_part"], "left")

    def whole(name: str, kind: str):
        lacks = F.coalesce(F.col(f"_lacks_{name}"), F.lit(0).cast("long"))
        own = F.col(f"before_{name}")
        return (own + lacks if kind == "sum" else own.bitwiseXOR(lacks)).alias(f"before_{name}")

    return both.select(*rows.columns, *(whole(name, kind) for name, kind in columns.items()))
