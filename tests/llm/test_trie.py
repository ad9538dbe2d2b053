"""The trie of conversation prefixes against a trie in plain Python."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from kinefuse.llm import prefix_trie as trie
from kinefuse.llm.running import with_running

SCHEMA = "conv_id long, turn long, role string, text string, k long, depth string, n_chars string, base int"


def brute(rows, group=100, shared=6):
    """All nodes of the rebuilt conversations, as tuples."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: (y[0], y[1], y[2].encode(), y[3].encode()))] for c, x in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (c % group if c >= 0 else -(-c % group))
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    found = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == node)
        parent = min(members[node[:-1]]) if node else None
        children = sum(len(x) == len(node) + 1 for x in below)
        found.append((min(convs), len(node), parent, len(convs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, found))


def nodes(spark, rows, **sizes):
    # Columns whose names the operator uses inside must not matter.
    frame = spark.createDataFrame([(*r, 5, "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    out = trie.prefix_trie(*trie.rebuilt(trie.numbered_turns(frame)), **sizes)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(str(tuple(r)) for r in out.collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40), 100, 101, 102, 205, 206, 300, -1, -7, -100, -103]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "äöü😀"])) for t in range(rng.randrange(1, 9))]
    rows += [(7, None, "user", "first"), (7, None, None, None), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (8, 0, "assistant", "tie")]
    rows += [(None, 0, "user", "no conversation"), (12, 0, None, "x" * 300 + "a"), (13, 0, None, "x" * 300 + "b")]
    # Copies of one long conversation, and one that leaves it late.
    rows += [(c, t, "user", f"turn {t}") for c in (401, 402, 403, 404) for t in range(70 if c < 404 else 69)] + [(404, 69, "user", "another end")]
    wanted = brute(rows)
    assert nodes(spark, rows) == wanted
    # Segments and blocks of a few rows: nodes reach over layers and blocks.
    assert nodes(spark, rows, segment=3, block=4) == wanted


def test_small(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "a", "b")]) == []
    # Its only turns are replaced by those of a conversation that is not there: a turnless conversation.
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, 0, "user", "gone")]
    assert nodes(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_extents():
    rng = np.random.default_rng(3)
    lcp = rng.integers(-1, 5, 50)
    lcp[0] = -1
    at, depth = np.divmod(np.arange(250), 5)
    first, last = trie.extents(trie.sparse_table(lcp), at, depth)
    for i, d, a, b in zip(at, depth, first, last):
        assert all(lcp[a + 1 : b + 1] >= d) and lcp[a] < d and (b == 49 or lcp[b + 1] < d) and a <= i <= b


def test_running_over_partitions(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.6 else rng.randrange(8), k, rng.randrange(1 << 40)) for k in range(500)]
    frame = spark.createDataFrame(rows, "g long, k long, v long").withColumn("w", F.col("v"))
    found = {r.k: (r.before_v, r.before_w) for r in with_running(frame, "g", ["k"], {"v": "sum", "w": "xor"}).collect()}
    for g, k, _ in rows:
        before = [v for h, j, v in rows if h == g and j < k]
        assert found[k] == (sum(before), np.bitwise_xor.reduce(np.array(before, np.int64)) if before else 0)
