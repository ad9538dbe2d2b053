"""The trie of conversation prefixes, by range minima over sorted longest common prefixes.

A turn is two 64-bit hashes of its role, text and position. A node, that is a distinct sequence of
first turns, is the xor of its turns' hashes together with its depth. No trie is built:

1. Conversations are cut into segments of SEGMENT turns, so one of any length spreads over rows.
   A segment knows the node that it starts from.
2. Segments are dealt out by ranges of (start, turns, conv_id), sorted, and taken in blocks of BLOCK.
   A block holds the longest common prefix of each two neighbours in a sparse table. Every prefix that
   first shows up in a row is a candidate; all candidates of a block search their left and right ends
   at once, each for itself, by halving steps over range minima. Members between the ends are counted and
   summed by prefix sums, and the least id among them is a range minimum as well.
3. A node that several blocks hold is one partial row from each of them, put together by its key. A
   prefix that a third of all conversations share costs a row a block.

Sums over subtrees need no walk either. Each node belongs to its smallest member, and what belongs to a
conversation is the tail of its path. Thus a subtree's distinct turns are the tails of its members, of
the smallest one from the subtree's top on, and a second round over the blocks adds these tails up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.llm.queries import llm_query, table
from kinefuse.llm.running import with_running
from kinefuse.llm.shipping import ship
from kinefuse.storage import write_and_read

SEGMENT = 64
#: Segments that one sparse table holds; with SEGMENT turns each they take some 60 MB.
BLOCK = 16_384
#: Turns of a segment that the range partitioning looks at; it bounds the keys that Spark samples.
RANGE_TURNS = 8
#: Characters of a text that the sorting of tied turns looks at before its SHA-256.
TIE_CHARS = 256
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Children of one node that may meet in a task to learn their parent.
MANY = 65_536
NODE = ["depth", "k1", "k2"]


def _tie(text: Column) -> Column:
    return F.when(F.length(text) <= TIE_CHARS, text).otherwise(F.concat(F.substring(text, 1, TIE_CHARS), F.sha2(text, 256)))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (place in its conversation, from 0), r1, r2 (hashes of role and text), n_chars of every turn.

    Turns go by turn, null first; ties by role and text, and those that agree in their first TIE_CHARS
    characters by SHA-256. Repeated rows are turns of their own. Null roles and texts are empty. Rows without a conv_id belong
    to no conversation and are left out, as are other columns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _tie(role).alias("role"),
        _tie(text).alias("tie"),
        F.xxhash64(role, text).alias("r1"),
        F.xxhash64(F.lit(1), text, role).alias("r2"),
        F.length(text).cast("long").alias("n_chars"),
        F.lit(1).cast("long").alias("k"),
    )
    # Spark sorts nulls first.
    return with_running(rows, "conv_id", ["turn", "role", "tie"], {"k": "sum"}).select("conv_id", F.col("before_k").alias("k"), "r1", "r2", "n_chars")


def members_of(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_chars of every conversation, turnless ones too."""
    sums = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("n_chars").alias("n_chars"))
    none = F.lit(0).cast("long")
    return conv_ids.select("conv_id").join(sums, "conv_id", "left").select("conv_id", F.coalesce("n_turns", none).alias("n_turns"), F.coalesce("n_chars", none).alias("n_chars"))


def segments(turns: DataFrame, members: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, seg, p1, p2, chars_before (the node it starts from), x1, x2, chars (arrays, one entry a turn), ends (whether the conversation does)."""
    place = F.col("k")
    hashed = turns.select(
        "conv_id",
        F.expr(f"k div {segment}").alias("seg"),
        F.struct(place.alias("k"), F.xxhash64("r1", place).alias("x1"), F.xxhash64("r2", place, F.lit(2)).alias("x2"), F.col("n_chars").alias("chars")).alias("turn"),
    )
    rows = hashed.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    rows = write_and_read(rows.select("conv_id", "seg", *(F.col(f"turns.{n}").alias(n) for n in ("x1", "x2", "chars"))), "segments")
    zero = F.lit(0).cast("long")
    xor = lambda name: F.aggregate(name, zero, lambda done, x: done.bitwiseXOR(x)).alias(name)
    whole = members.select("conv_id", "n_turns")
    sums = rows.join(whole.where(F.col("n_turns") > segment), "conv_id", "left_semi").select(
        "conv_id", "seg", xor("x1"), xor("x2"), F.aggregate("chars", zero, lambda done, x: done + x).alias("chars")
    )
    starts = with_running(sums, "conv_id", ["seg"], {"x1": "xor", "x2": "xor", "chars": "sum"})
    starts = starts.where("seg > 0").select("conv_id", "seg", F.col("before_x1").alias("p1"), F.col("before_x2").alias("p2"), F.col("before_chars").alias("chars_before"))
    none = F.array().cast("array<bigint>")
    placed = whole.join(rows, "conv_id", "left").withColumn("seg", F.coalesce("seg", zero)).join(starts, ["conv_id", "seg"], "left")
    return placed.select(
        "conv_id",
        "seg",
        *(F.coalesce(n, zero).alias(n) for n in ("p1", "p2", "chars_before")),
        *(F.coalesce(n, none).alias(n) for n in ("x1", "x2", "chars")),
        (F.col("n_turns") <= (F.col("seg") + 1) * segment).alias("ends"),
    )


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Row j holds the least of the 2**j values from each place on."""
    rows, width = [values], 1
    while 2 * width <= len(values):
        rows.append(np.minimum(rows[-1][:-width], rows[-1][width:]))
        width *= 2
    return rows


def range_minimum(rows: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value from first to last, both included."""
    out = np.empty(len(first), rows[0].dtype)
    level = np.frexp((last - first + 1).astype(float))[1] - 1
    for j in np.unique(level):
        at = level == j
        out[at] = np.minimum(rows[j][first[at]], rows[j][last[at] - (1 << j) + 1])
    return out


def extents(lcp: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share `depth` turns with row `at`. lcp: sparse table of what each row shares with the one before."""
    count, left, right = len(lcp[0]), at.copy(), at.copy()
    for j in range(len(lcp) - 1, -1, -1):
        step = 1 << j
        inside = left - step >= 0
        left -= step * (inside & (lcp[j][np.where(inside, left - step + 1, 0)] >= depth))
        inside = right + step < count
        right += step * (inside & (lcp[j][np.where(inside, right + 1, 0)] >= depth))
    return left, right


class Block:
    """Sorted segments as padded matrices, and their candidate prefixes with the rows that share them."""

    def __init__(self, rows: pa.RecordBatch, segment: int):
        self.segment = segment
        number = lambda name: rows.column(name).to_numpy()
        self.conv, self.seg, p1, p2 = number("conv_id"), number("seg"), number("p1"), number("p2")
        lists = rows.column("x1")
        begins = lists.offsets.to_numpy().astype(np.int64)
        self.size = np.diff(begins)
        count, width = len(self.size), int(self.size.max(initial=0))
        filled = np.arange(width) < self.size[:, None]

        def matrix(name: str) -> np.ndarray:
            out = np.zeros((count, width), np.int64)
            column = rows.column(name)
            out[filled] = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
            return out

        x1, x2, chars = matrix("x1"), matrix("x2"), matrix("chars")
        lcp = np.full(count, -1)
        if count > 1:
            same = (x1[1:] == x1[:-1]) & (x2[1:] == x2[:-1]) & filled[1:] & filled[:-1]
            shared = np.logical_and.accumulate(same, axis=1).sum(axis=1) if width else np.zeros(count - 1, int)
            lcp[1:] = np.where((self.seg[1:] == self.seg[:-1]) & (p1[1:] == p1[:-1]) & (p2[1:] == p2[:-1]), shared, -1)
        # Node, and characters up to it, at every depth of every segment.
        self.k1, self.k2, self.chars = (np.empty((count, width + 1), np.int64) for _ in range(3))
        self.k1[:, 0], self.k2[:, 0], self.chars[:, 0] = p1, p2, number("chars_before")
        for d in range(width):
            self.k1[:, d + 1], self.k2[:, d + 1], self.chars[:, d + 1] = self.k1[:, d] ^ x1[:, d], self.k2[:, d] ^ x2[:, d], self.chars[:, d] + chars[:, d]
        # The node that a later segment starts from is the last one of the segment before.
        least = np.maximum(lcp + 1, (self.seg > 0).astype(int))
        new = np.maximum(self.size - least + 1, 0)
        self.at = np.repeat(np.arange(count), new)
        self.depth = np.arange(len(self.at)) - np.repeat(np.cumsum(new) - new, new) + least[self.at]
        self.first, self.last = extents(sparse_table(lcp), self.at, self.depth)
        self.order = np.argsort(self.conv, kind="stable")
        rank = np.empty(count, np.int64)
        rank[self.order] = np.arange(count)
        self.least = self.order[range_minimum(sparse_table(rank), self.first, self.last)] if count else self.at

    def key(self, at: np.ndarray, depth: np.ndarray) -> dict[str, np.ndarray]:
        return {"depth": self.seg[at] * self.segment + depth, "k1": self.k1[at, depth], "k2": self.k2[at, depth]}

    def members(self) -> np.ndarray:
        return self.last - self.first + 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of the rows over the members of each candidate."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.last + 1] - total[self.first]


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of `size`, whatever the sizes of the batches."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


PARTS = "depth long, k1 long, k2 long, conv_id long, u1 long, u2 long, chars long, chars_before long, ids string"


def _found(segment: int, size: int):
    """A row for each node of a block (its smallest member here, its parent's key), and one with the ids that end in a node, in order."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, size):
            block = Block(rows, segment)
            at, depth = block.at, block.depth
            above = np.maximum(depth - 1, 0)
            before = block.chars[at, above]
            found = block.key(at, depth) | {"conv_id": block.conv[block.least], "u1": block.k1[at, above], "u2": block.k2[at, above]}
            found |= {"chars": block.chars[at, depth] - before, "chars_before": before}
            arrays = {name: pa.array(values) for name, values in found.items()} | {"ids": pa.nulls(len(at), pa.string())}
            yield pa.RecordBatch.from_pydict(arrays)
            ended = np.flatnonzero(rows.column("ends").to_numpy(zero_copy_only=False))
            if not len(ended):
                continue
            key = block.key(ended, block.size[ended])
            begin = np.ones(len(ended), bool)
            begin[1:] = np.any([x[1:] != x[:-1] for x in key.values()], axis=0)
            start = np.flatnonzero(begin)
            conv = block.conv[ended]
            ids = [",".join(map(str, run.tolist())) for run in np.split(conv, start[1:])]
            zeros = pa.array(np.zeros(len(start), np.int64))
            arrays = {name: pa.array(values[start]) for name, values in key.items()} | {"conv_id": pa.array(conv[start])}
            arrays |= {name: zeros for name in ("u1", "u2", "chars", "chars_before")} | {"ids": pa.array(ids, pa.string())}
            yield pa.RecordBatch.from_pydict(arrays)

    return emit


SUMS = "depth long, k1 long, k2 long, conv_id long, foreign long, n_convs long, chars long, own long, leaves long"


def _summed(segment: int, size: int):
    """For each node of a block: members, their characters, their tails and childless tails, and what of the smallest member's path is not its tail."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, size):
            block = Block(rows, segment)
            chars, own, leaf = (rows.column(n).to_numpy() for n in ("n_chars", "own", "leaf"))
            found = block.key(block.at, block.depth)
            found |= {"conv_id": block.conv[block.least], "foreign": (chars - own)[block.least], "n_convs": block.members()}
            found |= {"chars": block.sums(chars), "own": block.sums(own), "leaves": block.sums(leaf)}
            yield pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in found.items()})

    return emit


def _dealt(rows: DataFrame) -> DataFrame:
    """Segments in sorted ranges. Equal segments go by conv_id, so copies of one conversation spread as well."""
    ranged = rows.repartitionByRange("seg", "p1", "p2", F.slice("x1", 1, RANGE_TURNS), "conv_id")
    return ranged.sortWithinPartitions("seg", "p1", "p2", "x1", "x2", "conv_id")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, read as a stream of runs in order."""
    key, digest = None, None
    for batch in batches:
        done = []
        for depth, k1, k2, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids")), strict=True):
            if key != (depth, k1, k2):
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (depth, k1, k2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _digested(done)
    if key is not None:
        yield _digested([(*key, digest.hexdigest())])


def _digested(done: list[tuple]) -> pa.RecordBatch:
    names = [*NODE, "ends_sha256"]
    columns = list(zip(*done, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id. Parents of more than MANY children, which are fewer than a MANYth of the nodes, are broadcast; the others meet their children by key."""
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    above = ["depth", "u1", "u2"]
    popular = F.broadcast(parents.where(F.col("n_children") > MANY).drop("n_children"))
    others = nodes.join(popular, above, "left_anti").join(parents.where(F.col("n_children") <= MANY).drop("n_children"), above, "left")
    return others.unionByName(nodes.join(popular, above))


def prefix_trie(turns: DataFrame, conv_ids: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, k, r1, r2, n_chars as `numbered_turns` gives them, k without gaps. conv_ids: every
    conversation once, those without turns as well; without any there is no node, not even the root.
    saved_tokens: over the subtree, n_convs - 1 times the characters of each node's last text. ends_sha256
    is of the ascending ids, joined by commas, of the conversations that end in the node. The ids of one node
    pass one task as a stream, as SHA-256 has to; nothing else meets by node but partial rows.
    """
    ship(turns.sparkSession)
    members = write_and_read(members_of(turns, conv_ids), "members")
    rows = write_and_read(segments(turns, members, segment), "trie-segments")
    parts = write_and_read(_dealt(rows).mapInArrow(_found(segment, block), PARTS), "trie-parts")
    nodes = parts.where("ids IS NULL").groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), *(F.min(n).alias(n) for n in ("u1", "u2", "chars", "chars_before")))
    nodes = write_and_read(nodes, "trie-nodes")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = write_and_read(nodes.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")
    tails = nodes.groupBy("conv_id").agg(F.sum("chars").alias("own"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    zero = F.lit(0).cast("long")
    weighed = members.join(tails, "conv_id", "left").select("conv_id", "n_chars", F.coalesce("own", zero).alias("own"), F.coalesce("leaf", zero).alias("leaf"))
    least = F.min(F.struct("conv_id", "foreign"))["foreign"].alias("foreign")
    sums = _dealt(rows.join(weighed, "conv_id")).mapInArrow(_summed(segment, block), SUMS).groupBy(*NODE).agg(least, *(F.sum(n).alias(f"_{n}") for n in ("n_convs", "chars", "own", "leaves")))
    ends = parts.where("ids IS NOT NULL").select(*NODE, "conv_id", "ids")
    digests = ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")
    # The top of a subtree and all below it: characters of the members from there on, less those of the distinct turns.
    distinct = F.col("_own") + F.col("foreign") - F.col("chars_before")
    saved = F.col("_chars") - F.col("_n_convs") * F.col("chars_before") - distinct
    placed = _with_parents(nodes).join(sums, NODE).join(digests, NODE, "left")
    return placed.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.col("_n_convs").alias("n_convs"),
        "n_children",
        F.col("_leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


#: Conversations of one group share the first turns of its first one, fewer than SHARED of them.
GROUP, SHARED = 100, 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and every conv_id.

    The first h turns of conversation c - c % GROUP go before what c has after its own first h turns; h is crc32(c) % SHARED.
    A group has at most GROUP conversations and SHARED - 1 shared turns, so the join by group is bounded.
    """
    conv = F.col("conv_id")
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    counts = write_and_read(counts.select("conv_id", "n", (conv - conv % GROUP).alias("base"), (F.crc32(conv.cast("string")) % SHARED).alias("h")), "conversations")
    bases = counts.where(conv % GROUP == 0).select(conv.alias("base"), F.col("n").alias("base_n"))
    plan = counts.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))).alias("taken"))
    heads = turns.where((conv % GROUP == 0) & (F.col("k") < SHARED - 1)).select(conv.alias("base"), "k", "r1", "r2", "n_chars")
    shared = plan.join(heads, "base").where("k < h").select("conv_id", "k", "r1", "r2", "n_chars")
    own = turns.join(plan, "conv_id").where("k >= h").select("conv_id", (F.col("k") - F.col("h") + F.col("taken")).alias("k"), "r1", "r2", "n_chars")
    return write_and_read(shared.unionByName(own), "rebuilt"), counts.select("conv_id")


_CRC = """xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: CAST(ord({0}[i]) AS UBIGINT)), lambda crc, b:
    list_reduce([CAST(0 AS UBIGINT) for _ in range(8)], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, xor(crc, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"""

ORACLE = f"""
WITH t AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
        {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
    FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT c, list(said ORDER BY k) AS turns, CAST(c AS VARCHAR) AS name FROM t GROUP BY c),
h AS (SELECT c, turns, c - c % {GROUP} AS base, CAST({_CRC.format("name")} % {SHARED} AS BIGINT) AS h FROM o),
r AS (
    SELECT h.c, list_concat(coalesce(b.turns[:h.h], []), coalesce(h.turns[h.h + 1:], [])) AS turns
    FROM h LEFT JOIN o b ON b.c = h.base
), p AS (SELECT c, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
n AS (
    SELECT depth, turns[:depth] AS path, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = depth), '')) AS ends_sha256
    FROM p GROUP BY ALL
), k AS (SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
a AS (
    SELECT up AS depth, path[:up] AS path, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves,
        sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END) AS saved_tokens
    FROM (SELECT n.*, k.n_children, unnest(range(n.depth + 1)) AS up FROM n LEFT JOIN k ON k.depth = n.depth AND k.path = n.path) GROUP BY ALL
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
    CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN a ON a.depth = n.depth AND a.path = n.path LEFT JOIN k ON k.depth = n.depth AND k.path = n.path
    LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[:n.depth - 1]
"""


@llm_query(ORACLE)
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    turns = numbered_turns(table(spark, folder, "conversations"))
    return prefix_trie(*rebuilt(turns))
