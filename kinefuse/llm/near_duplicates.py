"""MinHash near-dedup by an inverted join over signature coordinates.

Texts with equal shingle sets form one class, which takes part once. Each class has a signature of
COORDINATES minima. A pair at or above the similarity wanted agrees in at least `matches(percent)` of
them, but for a chance of MISSED or less at the threshold itself. With `exact`, classes are posted under
their rarest shingles instead, as many as any pair that similar must share one of, and no pair is missed.

Merging by prefix and skip: a class is posted under a coordinate-value pair only if another class
has it too, and with `shared` of these it needs posting under the `shared - matches + 1` rarest alone, as
two classes that agree in `matches` coordinates must meet in one of those. The frequent values, the long
posting lists, are skipped; whether candidates agree in them is read from their signatures.

Posting lists are never expanded into all pairs. Of the candidates, shingles that no other candidate
has bound each similarity from above, which drops most that are too far off. Then each list links
its members to one lead; the links confirmed on full sets give first components. Only members of a
list that are outside its main component are paired with the list's other members, and the confirmed
links of both rounds give the components. A pair within one component needs no test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.llm.components import components
from kinefuse.llm.queries import llm_query, table
from kinefuse.llm.rows import row_key
from kinefuse.llm.shipping import ship
from kinefuse.llm.words import M1, M2, M3, hashed_words, mix, runs
from kinefuse.storage import write_and_read

COORDINATES = 48
#: Chance at most that a pair at the threshold agrees in too few coordinates to be found.
MISSED = 4e-9
#: Similarity wanted, in hundredths, and words in a shingle, for corpus stages; the query fixes its own.
PERCENT = 80
SHINGLE = 5

#: Sizes of the blocks in which the members outside a list's main component meet the list's members.
OUTSIDERS, MEMBERS = 512, 4096
#: Sizes of the blocks in which full sets are compared: sets or outsiders, and their shingles.
PART_NODES, CHUNK_NODES, BLOCK_SHINGLES = 1024, 4096, 1 << 21

_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_BLOCK = 4096


def matches(percent: int) -> int:
    """Coordinates in which a pair of this similarity agrees at least, but for a chance of MISSED: a binomial tail."""
    below, share = 0.0, percent / 100
    for k in range(COORDINATES + 1):
        below += math.comb(COORDINATES, k) * share**k * (1 - share) ** (COORDINATES - k)
        if below > MISSED:
            return max(1, k)
    return COORDINATES


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; with fewer words the whole sequence is the only one."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        total = mix(total * M1 + words[k : len(words) - size + 1 + k] * M2)
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of the hashes under each seed, as 32-bit integers."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), _BLOCK):
        hashes = shingles[start : start + _BLOCK, None] * _SEEDS[None, :]
        np.minimum(least, (hashes ^ (hashes >> np.uint64(29))).min(axis=0), out=least)
    return (mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _lowered_sets(rows: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    words, begins = hashed_words(pc.ascii_lower(rows.column("text")))
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        yield shingle_set(words[a:b], size)


def _sketches(size: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            n, first, second, signatures = [], [], [], []
            for shingles in _lowered_sets(rows, size):
                n.append(len(shingles))
                first.append(int(np.add.reduce(mix(shingles ^ M3)).view(np.int64)))
                second.append(int(np.add.reduce(mix(shingles + M1)).view(np.int64)))
                signatures.append(signature(shingles) if len(shingles) else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, signatures)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *signatures])))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("doc_id", "_uid", "_tie")), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists],
                ["doc_id", "_uid", "_tie", "n", "h1", "h2", "sig"],
            )

    return emit


def _full_sets(size: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            sets = list(_lowered_sets(rows, size))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("sig"), lists], ["node", "sig", "shingles"])

    return emit


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the two numbers that tell rows apart, see `row_key`."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"]
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), *row_key(doc_id, text))


def _postings(classes: DataFrame, least: int) -> DataFrame:
    """node, key: each class under the rarest of the coordinate-value pairs it shares with another class."""
    keys = classes.select("node", F.posexplode("sig").alias("at", "value")).select(
        "node", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").bitwiseAND(0xFFFFFFFF)).alias("key")
    )
    often = keys.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    shared = keys.join(often, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("_shared"))
    rarest = F.slice("_shared", 1, F.size("_shared") - least + 1)
    return shared.where(F.size("_shared") >= least).select("node", F.explode(rarest["key"]).alias("key"))


def _exact_postings(sets: DataFrame, percent: int) -> DataFrame:
    """node, key: each class under its rarest shingles. Of n, two similar classes share at least percent of n, so any n - that + 1 hold one of them."""
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("often"))
    ranked = each.join(often, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("_all"))
    rarest = F.slice("_all", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    return ranked.select("node", F.explode(F.filter(rarest, lambda x: x["often"] > 1)["key"]).alias("key"))


def _similar(common, n_a, n_b, percent: int):
    """Whether a common part of this size lets two sets reach the similarity."""
    return 100 * common >= percent * (n_a + n_b - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in `least` places and whose full sets are similar."""
    a = sets.select(F.col("node").alias("a"), F.col("sig").alias("_sig_a"), F.col("shingles").alias("_set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("sig").alias("_sig_b"), F.col("shingles").alias("_set_b"))
    agree = F.size(F.filter(F.zip_with("_sig_a", "_sig_b", lambda x, y: x == y), lambda same: same))
    common = F.size(F.array_intersect("_set_a", "_set_b"))
    both = pairs.join(a, "a").join(b, "b").where(agree >= least)
    return both.where(_similar(common, F.size("_set_a"), F.size("_set_b"), percent)).select("a", "b")


PARTNERS = "o long, n_o long, home long, part int, partners array<long>"


def _partners(percent: int):
    """The members of one block (right) that the outsiders of another (left) must be compared with, packed by outsider, home and part.

    A pair is taken in the first list that both are in, and only if the shingles they alone have leave room for the similarity.
    """

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"o": [], "n_o": [], "home": [], "part": [], "partners": []}
        if left.num_rows and right.num_rows:
            columns = {c: right.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("node", "n", "common", "comp", "main", "home", "part")}
            node, n, common, comp, home, part = (columns[c] for c in ("node", "n", "common", "comp", "home", "part"))
            this, inside = right.column("key")[0].as_py(), comp == columns["main"]
            lists = right.column("keys").combine_chunks()
            keys, begins = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            owner = np.repeat(np.arange(len(node)), np.diff(begins))
            before = keys < this
            order = np.argsort(keys[before], kind="stable")
            sorted_keys, holders = keys[before][order], owner[before][order]
            for o, n_o, common_o, comp_o, own in zip(*(left.column(c).to_pylist() for c in ("node", "n", "common", "comp", "keys")), strict=True):
                least = np.minimum(common, common_o)
                wanted = (comp != comp_o) & (inside | (node > o)) & (100 * least >= percent * (n + n_o - least))
                for key in own:
                    if key < this:
                        wanted[holders[np.searchsorted(sorted_keys, key) : np.searchsorted(sorted_keys, key, "right")]] = False
                found = np.flatnonzero(wanted)
                if not len(found):
                    continue
                found = found[np.lexsort((part[found], home[found]))]
                cut = np.flatnonzero(np.append(True, (home[found][1:] != home[found][:-1]) | (part[found][1:] != part[found][:-1])))
                for group in np.split(found, cut[1:]):
                    out["o"].append(o)
                    out["n_o"].append(n_o)
                    out["home"].append(home[group[0]])
                    out["part"].append(part[group[0]])
                    out["partners"].append(node[group])
        kinds = {"o": pa.int64(), "n_o": pa.int64(), "home": pa.int64(), "part": pa.int32(), "partners": pa.list_(pa.int64())}
        return pa.Table.from_pydict({c: pa.array(out[c], kinds[c]) for c in kinds})

    return find


def _compared(percent: int):
    """The similar pairs among outsiders with their partners (left) and the full sets of a part of a home (right)."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            place = {x: k for k, x in enumerate(right.column("node").to_pylist())}
            lists = right.column("shingles").combine_chunks()
            flat, begins = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            begins = begins - begins[0]
            for o, partners, own in zip(left.column("o").to_pylist(), left.column("partners"), left.column("shingles"), strict=True):
                mine, nodes = own.values.to_numpy(), partners.values.to_numpy()
                at = np.fromiter((place[x] for x in nodes.tolist()), np.int64, len(nodes))
                sizes = begins[at + 1] - begins[at]
                starts = np.cumsum(sizes) - sizes
                theirs = flat[np.repeat(begins[at] - starts, sizes) + np.arange(int(sizes.sum()))]
                hit = np.searchsorted(mine, theirs)
                common = np.add.reduceat((mine[np.minimum(hit, len(mine) - 1)] == theirs).astype(np.int64), starts)
                near = 100 * common >= percent * (sizes + len(mine) - common)
                links += [(min(o, x), max(o, x)) for x in nodes[near].tolist()]
        return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return find


def _homes(placed: DataFrame, leads: DataFrame) -> DataFrame:
    """node, keys, home, part: the lists of each class, the least lead of these, and a part of its home, of bounded sets and shingles."""
    known = placed.select("key", "node", "n").join(leads, "key").groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"), F.min("lead").alias("home"), F.max("n").alias("n"))
    parts = F.greatest(F.ceil(F.count("*") / PART_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts")
    known = known.join(known.groupBy("home").agg(parts), "home")
    return known.select("node", "keys", "home", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int").alias("part"))


def _blocked(placed: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outsiders and members of the lists by (key, block, against): a block of about OUTSIDERS of the first against one of about MEMBERS of the second."""
    rows = placed.join(known, "node")
    block, against = (F.pmod(F.xxhash64("node", F.lit(k)), F.col(n)).cast("int") for k, n in ((0, "blocks"), (1, "sides")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outsiders = rows.where("comp <> main").withColumn("block", block).withColumn("against", every("sides"))
    members = rows.withColumn("against", against).withColumn("block", every("blocks"))
    # Columns of their own: both sides come from the same tables.
    outsiders = outsiders.select(*(F.col(c).alias(c) for c in ("key", "block", "against", "node", "n", "common", "comp", "keys")))
    return outsiders, members.select("key", "block", "against", "node", "n", "common", "comp", "main", "keys", "home", "part")


def _outsiders(placed: DataFrame, leads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the members outside their lists' main components.

    Pairs are formed and compared inside tasks, by blocks of both sides, so no table has a row for each
    pair and no task holds a list. A class's home is the least lead of its lists, where most of its
    partners are at home too.
    """
    known = write_and_read(_homes(placed, leads), "homes")
    outsiders, members = _blocked(placed, known)
    by = ("key", "block", "against")
    asked = outsiders.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(_partners(percent), PARTNERS)
    asked = asked.groupBy("o", "home", "part").agg(F.any_value("n_o").alias("n_o"), F.flatten(F.collect_list("partners")).alias("partners"))
    asked = write_and_read(asked, "outsiders")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_NODES), F.ceil(F.sum("n_o") / BLOCK_SHINGLES)).cast("int").alias("chunks")
    chunks = write_and_read(asked.groupBy("home", "part").agg(chunks), "chunks")
    asked = asked.join(chunks, ["home", "part"]).withColumn("chunk", F.pmod(F.xxhash64("o"), F.col("chunks")).cast("int"))
    asked = asked.join(sets.select(F.col("node").alias("o"), F.array_sort("shingles").alias("shingles")), "o").select("home", "part", "chunk", "o", "partners", "shingles")
    held = known.join(chunks, ["home", "part"]).join(sets.select("node", "shingles"), "node").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.select(*(F.col(c).alias(c) for c in ("home", "part", "chunk", "node", "shingles")))
    by = ("home", "part", "chunk")
    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_compared(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    A null or empty text, or one of white space, has no shingles and is linked with nothing. Rows with
    equal doc_id share their component if their texts are linked, and all count as kept if it is
    theirs. Null ids are never a component's id unless it has no other; then it is kept. Letters A to Z
    count as lower case. Other columns are left out.
    """
    rows = _labelled(docs, shingle, percent, exact)
    return rows.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def _labelled(docs: DataFrame, shingle: int, percent: int, exact: bool) -> DataFrame:
    """doc_id, n_shingles, component_id, comp (its number; null without shingles), and _uid, _tie of every row."""
    least = 0 if exact else matches(percent)
    ship(docs.sparkSession)
    texts = _identified(docs)
    sketched = write_and_read(
        texts.mapInArrow(_sketches(shingle), "doc_id long, _uid long, _tie long, n long, h1 long, h2 long, sig array<int>"), "sketches"
    )
    grouped = sketched.where("n > 0").groupBy("h1", "h2", "n")
    classes = grouped.agg(F.min("doc_id").alias("first_id"), F.min(F.struct("_uid", "_tie")).alias("_row"), F.any_value("sig").alias("sig"))
    classes = write_and_read(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    postings = None if exact else write_and_read(_postings(classes, least), "postings")

    wanted = classes if exact else classes.join(postings.select("node").distinct(), "node")
    wanted = wanted.select("node", "sig", "_row._uid", "_row._tie")
    made = texts.select("_uid", "_tie", "text").join(wanted, ["_uid", "_tie"]).select("node", "sig", "text")
    sets = made.mapInArrow(_full_sets(shingle), "node long, sig array<int>, shingles array<long>")
    sets = write_and_read(sets.groupBy("node").agg(F.any_value("sig").alias("sig"), F.any_value("shingles").alias("shingles")), "sets")
    if exact:
        postings = write_and_read(_exact_postings(sets, percent), "postings")

    owned = sets.select("node", F.explode("shingles").alias("_s")).groupBy("_s").agg(F.count("*").alias("_c"), F.min("node").alias("node"))
    alone = owned.where("_c = 1").groupBy("node").agg(F.count("*").alias("_alone"))
    bounds = sets.select("node", F.size("shingles").alias("n")).join(alone, "node", "left")
    bounds = bounds.select("node", "n", (F.col("n") - F.coalesce("_alone", F.lit(0))).alias("common")).where(100 * F.col("common") >= percent * F.col("n"))
    members = write_and_read(postings.join(bounds, "node"), "members")

    possible = _similar(F.least("x.common", "y.common"), F.col("x.n"), F.col("y.n"), percent)
    ends = (F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    leads = members.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("common")).alias("alone"), "node", "n", "common")).alias("_lead"))
    leads = leads.select("key", "_lead.*")
    stars = members.alias("x").join(leads.alias("y"), "key").where(possible & F.expr("x.node <> y.node")).select(*ends).distinct()
    stars = write_and_read(stars, "star-pairs")
    links = write_and_read(_confirmed(stars, sets, percent, least), "star-links")

    labels = components(links)
    placed = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mains = placed.groupBy("key", "comp").agg(F.count("*").alias("_size")).groupBy("key")
    mains = mains.agg(F.max_by("comp", F.struct("_size", "comp")).alias("main"), F.count("*").alias("_comps"), F.sum("_size").alias("_all"), F.max("_size").alias("_most"))
    blocks = (F.ceil(n / size).cast("int").alias(name) for n, size, name in ((F.col("_all") - F.col("_most"), OUTSIDERS, "blocks"), (F.col("_all"), MEMBERS, "sides")))
    mixed = mains.where("_comps > 1").select("key", "main", *blocks)
    placed = write_and_read(placed.join(mixed, "key"), "mixed-lists")
    more = write_and_read(_outsiders(placed, leads.select("key", F.col("node").alias("lead")), sets, percent), "rest-links")

    labels = components(links.union(more))
    of_class = classes.select("h1", "h2", "n", "first_id", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    firsts = of_class.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_class = of_class.join(firsts, "comp").select("h1", "h2", "n", "component_id", "comp", F.lit(True).alias("_known"))
    rows = sketched.select("doc_id", "_uid", "_tie", "n", "h1", "h2").join(of_class, ["h1", "h2", "n"], "left")
    component = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "comp", "_uid", "_tie")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """The rows of docs, in all their columns, one of each component: that of the least doc_id, null last.

    Several texts under that doc_id, or without any, go by their hashes; of rows with equal doc_id and text, one stays.
    """
    key = ["_uid", "_tie"]
    rows = write_and_read(_labelled(docs, shingle, percent, exact), "labelled-rows")
    first = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", *key)).alias("_first"))
    known = rows.join(first, "comp", "left").withColumn("kept", F.expr("comp IS NULL OR (_first._uid = _uid AND _first._tie = _tie)")).select(*key, "kept")
    known = write_and_read(known, "kept-rows")
    dropped = known.where("not kept").select(*key).distinct()
    repeated = known.where("kept").groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key)
    named = docs.select(F.struct("*").alias("_row"), *row_key(docs["doc_id"], docs["text"]))
    gone = write_and_read(dropped.union(repeated).distinct(), "dropped-or-repeated")
    single = named.join(gone, key, "left_anti")
    repeated = write_and_read(repeated, "repeated-rows")
    once = named.join(repeated, key, "left_semi").dropDuplicates(key)
    return single.union(once).select("_row.*")


@llm_query()
def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document, with 3-word shingles and a similarity of 0.85 or more."""
    return near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85)
