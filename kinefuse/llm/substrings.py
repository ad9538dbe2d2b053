"""Substring dedup with suffix trees that are partitioned by prefix.

A word suffix matters only if its first WINDOW words start somewhere else too, that is if it lies
below an internal node of the corpus's suffix tree of depth WINDOW or more. The tree is never built
whole, and only suffixes at anchors enter it:

1. Every window of WINDOW words elects an anchor, the least hash among its word runs of ANCHOR
   words. Equal windows elect equal anchors at equal places, so a window whose anchor is found only
   once in the corpus is a leaf that branches off above that depth, and is dropped. Anchors are one
   word in fourteen; each text sends each of them once.
2. The suffixes that start at the anchors left are dealt out by a prefix, into as many groups as keep a group
   within GROUP_BYTES; each brings its words, and those before it, as far as its windows reach. The prefix is the anchor's own
   words, or, where that many suffixes begin with these that one group could not hold them, lengthened to a whole window,
   so that the continuations of a common phrase spread over groups. Within a run of texts, suffixes with equal words all around
   are met before anything is sent: all but one of them are decided there, and a passage
   that a third of all texts hold costs a group one suffix for each run of texts.
3. A group sorts its suffixes by their words, and the words before them from the anchor backwards. The longest
   common prefixes of neighbours are the two trees: at any depth, an internal node is a range of neighbours
   that share as many words. A window that reaches so many words back is repeated if a second suffix is below its
   node of the words back and its node of the words ahead. Neighbouring repeated windows are one maximal
   repeat; overlapping ones of one text join, and their words are removed.

Words are compared by 64-bit hashes, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.llm.queries import llm_query, table
from kinefuse.llm.rows import row_key
from kinefuse.llm.shipping import ship
from kinefuse.llm.words import M1, M2, hashed_words, mix, runs
from kinefuse.storage import write_and_read

WINDOW = 35
ANCHOR = 8
#: Bytes of suffixes that one group may hold on average.
GROUP_BYTES = 16 << 20
#: An anchor that this many texts hold is frequent.
FREQUENT = 1000

_INVERSE = np.uint64(pow(int(M1), -1, 1 << 64))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each position on (none for the last length - 1 positions), modulo 2 to the 64."""
    count = len(words) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(M1, len(words)), out=total[1:])
    return mix((total[length:] - total[:count]) * _powers(_INVERSE, count))


def anchors(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the word run at each position, and the position of the anchor of the window at each position."""
    values = run_hashes(words, anchor)
    span = window - anchor + 1
    if len(values) < span:
        return values, np.empty(0, np.int64)
    least, at, width = values, np.arange(len(values)), 1
    while width < span:
        step = min(width, span - width)
        first, second = least[:-step], least[step:]
        left = first <= second
        least, at, width = np.where(left, first, second), np.where(left, at[:-step], at[step:]), width + step
    return values, at


def _windows(texts: pa.Array, window: int, anchor: int):
    """Word hashes of some texts, where each text's words begin, the anchors' hashes, and for each window inside one text: its position, its anchor's position, its text."""
    words, begins = hashed_words(texts)
    values, at = anchors(words, window, anchor)
    counts = np.maximum(np.diff(begins) - window + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    return words, begins, values, place, at[place], owner


def _keys(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return rows.column("_uid").to_numpy(), rows.column("_tie").to_numpy()


def identified(docs: DataFrame) -> DataFrame:
    """_row (the columns but the text), text, and the two numbers that tell rows apart, see `row_key`."""
    fields = F.struct(*(docs[n] for n in docs.columns if n != "text")).alias("_row")
    return docs.select(fields, docs["text"], *row_key(docs["doc_id"], docs["text"]))


def _text_anchors(window: int, anchor: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            _, _, values, _, at, owner = _windows(rows.column("text"), window, anchor)
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
            value, owner = values[at[new]], owner[new]
            order = np.lexsort((value, owner))
            value, owner = value[order], owner[order]
            first = np.ones(len(value), bool)
            first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            often = np.diff(np.append(np.flatnonzero(first), len(value))) > 1
            uid, tie = _keys(rows)
            owner = owner[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[first].view(np.int64)), pa.array(uid[owner]), pa.array(tie[owner]), pa.array(often)],
                ["anchor", "_uid", "_tie", "often"],
            )

    return emit


def _range_hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the words from each start to its stop, whatever their number."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(M1, len(words)), out=total[1:])
    return mix((total[stop] - total[start]) * _powers(_INVERSE, len(words) + 1)[start] + (stop - start).astype(np.uint64))


def _suffixes(window: int, anchor: int, groups: int):
    """Suffixes at live anchors, each run of texts packed into one row per group; the windows of a negative group are known to be repeated."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            words, begins, values, place, at, owner = _windows(rows.column("text"), window, anchor)
            live, often = (_member(values, at, owner, rows.column(n)) for n in ("live", "frequent"))
            place, at, owner, often = place[live], at[live], owner[live], often[live]
            if not len(place):
                continue
            # A suffix has the windows in a row that elected its anchor; one with a frequent anchor has one window.
            new = np.ones(len(place), bool)
            new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | often[1:]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place)) - 1
            start, stop, at, owner, often = place[first], place[last] + window, at[first], owner[first], often[first]
            prefix = np.where(often, _range_hashes(words, start, stop), mix(values[at]))
            around, second = _range_hashes(words, start, stop), _range_hashes(mix(words ^ M2), start, stop)
            back = at - start
            order = np.lexsort((back, second, around))
            same = (around[order][1:] == around[order][:-1]) & (second[order][1:] == second[order][:-1]) & (back[order][1:] == back[order][:-1])
            lead = order[np.append(True, ~same)]
            met = np.diff(np.append(np.flatnonzero(np.append(True, ~same)), len(order))) > 1
            group = (mix(prefix[lead]) % np.uint64(groups)).astype(np.int64)
            by = np.argsort(group, kind="stable")
            lead, met, group = lead[by], met[by], group[by]
            cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            uid, tie = _keys(rows)

            def packed(numbers: np.ndarray, cut: np.ndarray, chosen: np.ndarray, met: np.ndarray, with_words: bool) -> pa.RecordBatch:
                sizes = stop[chosen] - start[chosen]  # noqa: B023
                ends = np.cumsum(sizes)
                flat = np.repeat(start[chosen] - (ends - sizes), sizes) + np.arange(sizes.sum()) if with_words else np.empty(0, np.int64)  # noqa: B023
                held = owner[chosen]  # noqa: B023
                small = lambda x: x.astype(np.int32)
                columns = {
                    "size": small(sizes), "back": small(back[chosen]), "uid": uid[held], "tie": tie[held], "start": small(start[chosen] - begins[held]), "met": met,  # noqa: B023
                }
                each = small(np.append(cut, len(chosen)))
                lists = {n: pa.ListArray.from_arrays(pa.array(each), pa.array(np.ascontiguousarray(x))) for n, x in columns.items()}
                of_words = small(np.append(0, ends)[each]) if with_words else np.zeros(len(each), np.int32)
                text = pa.ListArray.from_arrays(pa.array(of_words), pa.array(words[flat].view(np.int64)))  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(numbers), text, *lists.values()], ["grp", "words", *lists])

            yield packed(group[cut], cut, lead, met, True)
            known = np.flatnonzero(np.isin(np.arange(len(start)), order[np.append(same, False) | np.append(False, same)], assume_unique=True))
            if len(known):
                # Rows of equal doc_id and text share their places.
                known = known[_distinct(uid[owner[known]], tie[owner[known]], (start - begins[owner])[known])]
                number = np.array([-1 - int(mix(around[known[:1]])[0] % np.uint64(groups))])
                yield packed(number, np.zeros(1, np.int64), known, np.ones(len(known), bool), False)

    return emit


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Indexes of the distinct rows of some columns."""
    order = np.lexsort(columns[::-1])
    first = np.ones(len(order), bool)
    first[1:] = np.any([x[order][1:] != x[order][:-1] for x in columns], axis=0)
    return order[first]


def _member(values: np.ndarray, at: np.ndarray, owner: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether each window's anchor is in its text's list."""
    begins = lists.offsets.to_numpy()
    listed = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[begins[0] : begins[-1]]
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(begins), 0)
    salt = mix(np.arange(len(lists), dtype=np.uint64))
    return np.isin(values[at] ^ salt[owner], listed ^ np.repeat(salt, sizes))


SUFFIXES = "grp long, words array<long>, size array<int>, back array<int>, uid array<long>, tie array<long>, start array<int>, met array<boolean>"
REPEATED = "shard long, uid array<long>, tie array<long>, first array<int>, last array<int>"
FOUND = "_uid long, _tie long, places array<int>"


def _flat(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {n: table.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in names}


class Tree:
    """Rows of word codes in order, with what each shares with the one before; a row ends where its codes are -1."""

    def __init__(self, rows: np.ndarray):
        count, width = rows.shape
        order = np.lexsort(rows.T[::-1]) if width else np.arange(count)
        shared = np.logical_and.accumulate(rows[order][1:] == rows[order][:-1], axis=1).sum(axis=1) if width else np.zeros(max(count - 1, 0), np.int64)
        self.lcp = np.append(-1, shared)[:count]
        self.rank = np.empty(count, np.int64)
        self.rank[order] = np.arange(count)

    def nodes(self, depth: int) -> np.ndarray:
        """For each row the number of the node that its first `depth` words lead to."""
        return np.cumsum(self.lcp < depth)[self.rank]


def repeated_windows(words: np.ndarray, size: np.ndarray, back: np.ndarray, window: int, reach: int) -> np.ndarray:
    """For each suffix, with the words around it one after the other, which of its windows another suffix has too.

    size: words of each, back: those before its anchor, reach: most words before an anchor. Column k is the window that starts at its k-th word.
    """
    count = len(size)
    codes = np.unique(words, return_inverse=True)[1].astype(np.int32)
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(count), size)
    offset = np.arange(len(words)) - np.repeat(begin + back, size)
    ahead, behind = np.full((count, window), -1, np.int32), np.full((count, reach), -1, np.int32)
    right = (offset >= 0) & (offset < window)
    ahead[row[right], offset[right]] = codes[right]
    behind[row[offset < 0], -1 - offset[offset < 0]] = codes[offset < 0]
    forwards, backwards = Tree(ahead), Tree(behind)
    number = size - window + 1
    out = np.zeros((count, reach + 1), bool)
    for far in range(reach + 1):
        # The windows that start `far` words before their anchors.
        judged = np.flatnonzero((back >= far) & (back - far < number))
        if len(judged) < 2:
            continue
        node = forwards.nodes(window - far)[judged] * (count + 1) + backwards.nodes(far)[judged]
        _, inverse, times = np.unique(node, return_inverse=True, return_counts=True)
        out[judged, back[judged] - far] = times[inverse] > 1
    return out


def _subtree(window: int, anchor: int, shards: int):
    """The maximal repeats of a group, as the first and last window of each, in one row for each shard of the texts."""

    def find(suffixes: pa.Table) -> pa.Table:
        flat = _flat(suffixes, ("size", "back", "uid", "tie", "start", "met"))
        start, number = flat["start"], flat["size"] - window + 1
        if suffixes.column("grp")[0].as_py() < 0:
            row, first, last = np.arange(len(start)), start, start + number - 1
        else:
            found = repeated_windows(_flat(suffixes, ("words",))["words"], flat["size"].astype(np.int64), flat["back"].astype(np.int64), window, window - anchor)
            found |= flat["met"][:, None] & (np.arange(found.shape[1]) < number[:, None])
            edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, at = np.nonzero(edges == 1)
            first, last = start[row] + at, start[row] + np.nonzero(edges == -1)[1] - 1
        uid, tie = flat["uid"][row], flat["tie"][row]
        once = _distinct(uid, tie, first, last)
        uid, tie, first, last = uid[once], tie[once], first[once].astype(np.int32), last[once].astype(np.int32)
        shard = (mix(uid.view(np.uint64) ^ mix(tie.view(np.uint64))) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        cut = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x[order])) for x in (uid, tie, first, last)]
        return pa.Table.from_arrays([pa.array(shard[cut[:-1]]), *lists], ["shard", "uid", "tie", "first", "last"])

    return find


def _by_text(repeated: pa.Table) -> pa.Table:
    """One row for each text of a shard, with the starts of its repeated windows."""
    uid, tie, first, last = _flat(repeated, ("uid", "tie", "first", "last")).values()
    sizes = (last - first + 1).astype(np.int64)
    ends = np.cumsum(sizes)
    pos = (np.repeat(first - (ends - sizes), sizes) + np.arange(sizes.sum())).astype(np.int32)
    uid, tie = np.repeat(uid, sizes), np.repeat(tie, sizes)
    once = _distinct(uid, tie, pos)
    uid, tie, pos = uid[once], tie[once], pos[once]
    begin = np.flatnonzero(np.append(True, (uid[1:] != uid[:-1]) | (tie[1:] != tie[:-1])))[: len(uid)]
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(uid)).astype(np.int32)), pa.array(pos))
    return pa.Table.from_arrays([pa.array(uid[begin]), pa.array(tie[begin]), lists], ["_uid", "_tie", "places"])


def repeated_places(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """The identified texts, and for those with repeats the word positions (from 0) at which a repeated window starts."""
    if not 1 <= anchor <= window:
        raise ValueError("the anchor must be no longer than the window")
    spark = docs.sparkSession
    ship(spark)
    texts = identified(docs)
    held = texts.select("_uid", "_tie", "text").mapInArrow(_text_anchors(window, anchor), "anchor long, _uid long, _tie long, often boolean")
    count = held.groupBy("anchor").agg(F.count("*").alias("n"), F.max("often").alias("often")).where("n > 1 or often")
    live = held.join(count.select("anchor", (F.col("n") >= FREQUENT).alias("frequent")), "anchor")
    by_text = live.groupBy("_uid", "_tie").agg(
        F.collect_set("anchor").alias("live"), F.collect_set(F.when(F.col("frequent"), F.col("anchor"))).alias("frequent")
    )
    by_text = write_and_read(by_text, "live-anchors")
    suffixes = by_text.agg(F.sum(F.size("live"))).first()[0] or 0
    # An anchor is elected by half as many windows as could, on the average.
    each = 8 * (window + (window - anchor) // 2) + 40
    groups = max(1, suffixes * each // GROUP_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    below = texts.join(by_text, ["_uid", "_tie"], "left").mapInArrow(_suffixes(window, anchor, groups), SUFFIXES)
    repeated = below.groupBy("grp").applyInArrow(_subtree(window, anchor, groups), REPEATED)
    return texts, repeated.groupBy("shard").applyInArrow(_by_text, FOUND)


def _cut_texts(window: int):
    """Kept words of each text joined by single spaces, and the removed spans."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            texts = pc.fill_null(rows.column("text"), "").to_pylist()
            n_words, n_removed, kept_texts, removed = [], [], [], []
            for text, places in zip(texts, rows.column("places"), strict=True):
                words = [x for x in _split(text) if x]
                spans = _spans(places.values.to_numpy(), window) if places.is_valid else []
                kept, at = [], 0
                for start, stop in spans:
                    kept += words[at:start]
                    at = stop
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                kept_texts.append(" ".join(kept))
                removed.append([{"start": a, "stop": b} for a, b in spans])
            arrays = [rows.column("_row"), rows.column("text"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.string()), pa.array(removed, _SPANS)]
            yield pa.RecordBatch.from_arrays(arrays, ["_row", "text", "n_words", "n_removed", "kept_text", "spans"])

    return emit


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _split(text: str) -> list[str]:
    return text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")


def _spans(places, window: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by the windows at some positions."""
    if not len(places):
        return []
    at = np.sort(np.asarray(places))
    first = np.flatnonzero(np.append(True, at[1:] - at[:-1] > window))
    last = np.append(first[1:], len(at)) - 1
    return list(zip(at[first].tolist(), (at[last] + window).tolist(), strict=True))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """_row (struct: the input's columns but the text), text, n_words, n_removed, kept_text, spans (start, stop: word positions) of every row.

    Removed is each word covered by a window of `window` words whose words also start at another
    position, in any text. kept_text is the other words joined by single spaces. Null texts count as
    empty and have no words; texts shorter than a window keep all. Rows with equal doc_id and text are
    two texts that repeat each other. A null doc_id is as good as any.
    """
    texts, places = repeated_places(docs, window)
    rows = texts.join(places, ["_uid", "_tie"], "left")
    types = dict(texts.dtypes)
    return rows.mapInArrow(
        _cut_texts(window),
        f"_row {types['_row']}, text string, n_words long, n_removed long, kept_text string, spans array<struct<start: int, stop: int>>",
    )


@llm_query()
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document keeps."""
    rows = remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("_row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
