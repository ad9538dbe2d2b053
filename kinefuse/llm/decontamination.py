"""Benchmark decontamination by canonical templates.

Numbers and names are replaced by typed placeholders, so a question asked anew with other values
keeps its template. A number with its unit, a run of number words and a run of names are one placeholder
each. Windows of WINDOW such tokens are hashed and joined with those of the benchmark; a window with too
few plain words is taken word for word. For each document and item, the values that the matched windows
put into the placeholders must agree: along one alignment a value of the item stands for one value of the
document. Windows that disagree do not count. Of an item the words count that the windows left cover, over
all alignments, or the longest run of them along one. Of items that are found at the same place, the one that the
document covers best is reported, and others that it covers as well.

Names are known by capitals, which a text in capitals or title case makes useless and the start of a
sentence hides; so windows are taken with names as plain words, with the capitals within sentences as
names, and with all capitals as names, and matches of any kind count.

Before the join a bitmap of bounded size, made from the benchmark's hashes, drops windows that cannot
match. Only it is sent to the workers; the benchmark itself is joined by size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.llm.queries import llm_query, table
from kinefuse.llm.rows import row_key
from kinefuse.llm.shipping import ship
from kinefuse.llm.words import M1, M2, coded_words, mix, runs
from kinefuse.storage import write_and_read

WINDOW = 5
#: Plain words that a window with placeholders needs at least, unless it is a whole text.
LEAST_PLAIN = 2
#: Share of an item's windows, in hundredths; matched pieces count as the windows of one piece with as many words.
LEAST_SHARE = 80
#: Or a run along one alignment: share of the item's words, in hundredths, and words.
RUN_SHARE, RUN_WORDS = 60, 12
#: Share of an item's words in a document, in hundredths, that another item covers better, from which it is not reported.
LEAST_LOST = 90
#: Bits of the bitmap: some 16 a window of the benchmark, within these limits. Beyond the upper one more windows pass it.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 28

# Kinds of words, and words for units.
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl dl l s sec secs min mins h hr hrs ms kb mb gb tb hz khz mhz ghz w kw mw v a j kj cal kcal pa bar k c f "
    "usd eur gbp percent dollar dollars euro euros pound pounds cent cents meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet "
    "inch inches yard yards gram grams kilogram kilograms ton tons tonne tonnes ounce ounces liter liters litre litres second seconds minute minutes hour hours day "
    "days week weeks month months year years degree degrees"
).split()

NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty "
    "sixty seventy eighty ninety hundred thousand million billion trillion dozen"
).split()

_TENS = r"^(twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)-(one|two|three|four|five|six|seven|eight|nine)$"
_NUMBER = r"^[+-]?[$€£]?\d[\d.,:/]*(?:[a-z%°]{0,4})$"
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%+-") + "“”„‘’«»…–—¿¡"
_CODES = mix(np.arange(101, 105, dtype=np.uint64))

WINDOWS = "_uid long, _tie long, item long, at int, upto int, hash long, kinds array<tinyint>, words array<string>, total int"


def _canonical(texts: pa.Array):
    """Words without edge punctuation (empty ones left out), their hashes, kinds and marks, and where each text's words begin.

    Marks: a capital at a sentence's start, and whether the word may be one token with the word before.
    """
    codes, names, begins = coded_words(texts)
    trimmed = pc.utf8_trim(pc.utf8_lower(names), _EDGES)
    hashes = pd.util.hash_array(trimmed.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(trimmed) else np.empty(0, np.uint64)
    flag = lambda x: x.to_numpy(zero_copy_only=False)
    full = flag(pc.not_equal(trimmed, ""))
    spelled = flag(pc.or_(pc.is_in(trimmed, pa.array(NUMBER_WORDS, trimmed.type)), pc.match_substring_regex(trimmed, _TENS)))
    number = flag(pc.match_substring_regex(trimmed, _NUMBER)) | spelled
    unit = flag(pc.is_in(trimmed, pa.array(UNITS, trimmed.type)))
    capital = flag(pc.match_substring_regex(names, r"^[^\pL]*\p{Lu}[^\p{Lu}]*$"))
    ends = flag(pc.match_substring_regex(names, r"[.!?:][^\pL\d]*$"))
    parted = flag(pc.match_substring_regex(names, r"[,;][^\pL\d]*$"))
    kept = full[codes] if len(codes) else np.empty(0, bool)
    begins = np.append(0, np.cumsum(kept))[begins]
    codes = codes[kept]
    starts, breaks = np.ones(len(codes) + 1, bool), np.ones(len(codes) + 1, bool)
    starts[1:] = ends[codes]
    breaks[1:] = (ends | parted)[codes]
    starts[begins] = breaks[begins] = True
    starts, joins = starts[:-1], ~breaks[:-1]
    before = np.append(False, number[codes])[:-1]
    before[begins[:-1][begins[:-1] < len(codes)]] = False
    kinds = np.where(number[codes], NUMBER, np.where(unit[codes] & before, UNIT, np.where(capital[codes] & ~starts, NAME, PLAIN))).astype(np.int8)
    first = capital[codes] & starts & (kinds == PLAIN)
    joins &= ((kinds == UNIT) | spelled[codes]) & before | (kinds == NAME)
    return trimmed, codes, hashes[codes], kinds, first, joins, begins


def _window_hashes(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    total = np.full(len(at), np.uint64(size))
    for k in range(size):
        total = mix(total * M1 + values[at + k] * M2)
    return total


#: Which words are names: none, capitals within sentences, all capitals.
FORMS = (0, 1, 2)


def _tokens(form: int, hashes, kinds, first, joins, begins):
    """Tokens of a form: first word (and one entry more), kind, hash of the words, whether a sentence's first word is in it, and where each text's tokens begin."""
    if form == 0:
        kinds = np.where(kinds == NAME, PLAIN, kinds).astype(np.int8)
    elif form == 2:
        kinds = np.where(first, NAME, kinds).astype(np.int8)
    before = np.append(np.int8(PLAIN), kinds)[:-1]
    joined = joins & np.where(kinds == NAME, before == NAME, kinds != PLAIN)
    opens = np.flatnonzero(~joined)
    words = np.append(opens, len(kinds))
    rank = np.arange(len(kinds)) - np.repeat(opens, np.diff(words))
    mixed = mix(hashes + rank.astype(np.uint64) * M1)
    literal = np.add.reduceat(mixed, opens) if len(opens) else mixed
    return words, kinds[opens], literal, first[opens], np.searchsorted(opens, begins)


def _windows(keyed: tuple[str, ...], bitmap: np.ndarray | None, short: tuple[int, ...] = ()):
    """Windows of each text that the bitmap does not rule out, also of the short lengths; of the benchmark, where there is no bitmap, all."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            trimmed, codes, hashes, kinds, first, joins, begins = _canonical(rows.column("text"))
            totals = np.diff(begins)
            for form in FORMS:
                words, shown, literal, starts, opens = _tokens(form, hashes, kinds, first, joins, begins)
                typed = np.where(shown == PLAIN, literal, _CODES[shown])
                lengths = np.diff(opens)
                plain = np.append(0, np.cumsum(shown == PLAIN))
                wanted = np.append(0, np.cumsum(starts if form == 2 else shown == NAME))
                for size in range(1, WINDOW + 1):
                    # A text shorter than a window is one window as a whole.
                    inner = lengths >= size if size == WINDOW or size in short else lengths == size
                    counts = np.where(inner, lengths - size + 1, 0)
                    owner = np.repeat(np.arange(len(counts)), counts)
                    if not len(owner):
                        continue
                    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + opens[owner]
                    enough = plain[at + size] - plain[at] >= LEAST_PLAIN
                    whole = (lengths[owner] == size) & (size < WINDOW)
                    for exact in (False, True) if form == 0 else (False,):
                        good = ~enough if exact else enough | whole
                        if form:
                            good = good & (wanted[at + size] > wanted[at])
                        where = np.flatnonzero(good)
                        if not len(where):
                            continue
                        window = _window_hashes(literal if exact else typed, at[where], size)
                        if bitmap is not None:
                            bit = (window.view(np.int64) % np.int64(8 * len(bitmap))).astype(np.uint64)
                            known = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                            where, window = where[known], window[known]
                        if len(where):
                            kind = np.full(len(shown), PLAIN, np.int8) if exact else shown
                            yield _batch(rows, keyed, trimmed, codes, words, kind, owner[where], at[where], size, window, begins, totals)

    return emit


def _batch(rows, keyed, trimmed, codes, words, shown, owner, at, size, window, begins, totals) -> pa.RecordBatch:
    cuts = pa.array(np.arange(len(at) + 1, dtype=np.int32) * size)
    inner = np.repeat(at, size) + np.tile(np.arange(size), len(at))
    sizes = words[inner + 1] - words[inner]
    ends = np.cumsum(sizes)
    places = np.repeat(words[inner] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
    said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), trimmed.take(pa.array(codes[places]))), " ")
    ids = {name: rows.column(name).take(pa.array(owner)) if name in keyed else pa.nulls(len(owner), kind) for name, kind in (("_uid", pa.int64()), ("_tie", pa.int64()), ("item", pa.int64()))}
    columns = ids | {
        "at": pa.array((words[at] - begins[owner]).astype(np.int32)),
        "upto": pa.array((words[at + size] - begins[owner]).astype(np.int32)),
        "hash": pa.array(window.view(np.int64)),
        "kinds": pa.ListArray.from_arrays(cuts, pa.array(shown[inner])),
        "words": pa.ListArray.from_arrays(cuts, said),
        "total": pa.array(totals[owner].astype(np.int32)),
    }
    return pa.RecordBatch.from_pydict(columns)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(docs["doc_id"], docs["text"]), docs["text"].alias("text"))


def _bitmap(known: DataFrame) -> np.ndarray:
    """A bit for each window hash of the benchmark, put together by Spark in buckets. Its size grows with the benchmark, up to MOST_BITS."""
    windows = known.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * windows).bit_length()))
    place = F.pmod(F.col("hash"), F.lit(bits)) + 1
    buckets = known.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bytes"))
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in buckets.toLocalIterator():
        part = np.frombuffer(bytes(row.bytes), np.uint8)
        bitmap[(row.bucket - 1) * len(part) : row.bucket * len(part)] = part
    return bitmap


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """_uid, _tie, items (sorted ids) of the documents that hold items; see `marked` for the numbers that tell documents apart."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item"), benchmark["text"].alias("text")).where("item is not null")
    known = write_and_read(items.mapInArrow(_windows(("item",), None), WINDOWS).drop("_uid", "_tie"), "benchmark-windows")
    bitmap = _bitmap(known)
    short = known.select(F.size("kinds").alias("size")).where(F.col("size") < WINDOW).distinct().collect()
    found = _identified(docs).mapInArrow(_windows(("_uid", "_tie"), bitmap, tuple(row[0] for row in short)), WINDOWS).drop("item", "total")

    pair = F.zip_with("x.words", "y.words", lambda a, b: F.struct(a.alias("of_item"), b.alias("of_doc")))
    typed = F.zip_with("x.kinds", pair, lambda kind, both: F.struct(kind.alias("kind"), both["of_item"].alias("of_item"), both["of_doc"].alias("of_doc")))
    joined = found.alias("y").join(known.alias("x"), "hash").where(F.expr("x.kinds = y.kinds"))
    matched = joined.select("y._uid", "y._tie", "x.item", "x.total", "x.at", "x.upto", (F.col("y.at") - F.col("x.at")).alias("shift"), typed.alias("_typed"))
    matched = matched.where(F.forall("_typed", lambda x: (x["kind"] != PLAIN) | (x["of_item"] == x["of_doc"])))
    slots = F.transform(F.filter("_typed", lambda x: x["kind"] != PLAIN), lambda x: F.struct(x["of_item"].alias("of_item"), x["of_doc"].alias("of_doc")))
    matched = matched.select("_uid", "_tie", "item", "total", "at", "upto", "shift", slots.alias("slots"))
    # Added words and longer values move the shift: an alignment is one shift, or one of two overlapping ranges of shifts.
    wide = "(8 + total div 8)"
    lines = F.expr(f"array(struct(0 as way, shift as line), struct(1 as way, cast(floor(shift / {wide}) as int) as line), struct(2 as way, cast(floor(shift / {wide} + 0.5) as int) as line))")
    matched = write_and_read(matched, "template-matches").withColumn("_line", F.explode(lines)).select("*", "_line.*").drop("_line")

    line = ("_uid", "_tie", "item", "way", "line")
    said = matched.select(*line, F.explode("slots").alias("_s")).groupBy(*line, "_s").agg(F.count("*").alias("_n"))
    said = said.groupBy(*line, "_s.of_item").agg(F.max_by("_s", F.struct("_n", "_s")).alias("_s"))
    agreed = said.groupBy(*line).agg(F.collect_set("_s").alias("_agreed"))
    rows = matched.join(agreed, list(line), "left").where(F.forall("slots", lambda x: F.array_contains(F.col("_agreed"), x)))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "upto")), lambda x: F.sequence(x["at"], x["upto"] - 1)))))
    runs_of = rows.groupBy(*line).agg(words.alias("_words"), F.max("total").alias("total")).withColumn("_run", _longest("_words"))
    one = (F.col("_run") >= RUN_WORDS) & (100 * F.col("_run") >= RUN_SHARE * F.col("total"))
    item = ("_uid", "_tie", "item")
    over = runs_of.groupBy(*item).agg(F.size(F.array_distinct(F.flatten(F.collect_list("_words")))).alias("_n"), F.max("total").alias("total"), F.max(one).alias("_one"))
    less = F.least(F.lit(WINDOW), "total") - 1
    held = over.where(F.col("_one") | (100 * (F.col("_n") - less) >= LEAST_SHARE * (F.col("total") - less)))
    held = write_and_read(held.select(*item, (F.col("_n") / F.col("total")).alias("share")), "held-items")
    return write_and_read(_best_items(held, rows).groupBy("_uid", "_tie").agg(F.sort_array(F.collect_set("item")).alias("items")), "leaks")


def _best_items(held: DataFrame, rows: DataFrame) -> DataFrame:
    """The held items without those whose words in the document are, by LEAST_LOST of them, better covered by another item.

    Items that differ in a plain word share most windows; the one that the document holds covers more of itself. Each document keeps an item.
    """
    item = ("_uid", "_tie", "item")
    spans = rows.join(held.select(*item), list(item), "left_semi").select(*item, F.explode(F.sequence(F.col("at") + F.col("shift"), F.col("upto") + F.col("shift") - 1)).alias("word"))
    words = write_and_read(spans.distinct().join(held, list(item)), "held-words")
    best = words.groupBy("_uid", "_tie", "word").agg(F.max("share").alias("_best"))
    lost = words.join(best, ["_uid", "_tie", "word"]).groupBy(*item).agg((100 * F.avg((F.col("_best") > F.col("share")).cast("int"))).alias("_lost"))
    return lost.where(F.col("_lost") < LEAST_LOST)


def _longest(words: str) -> Column:
    """Length of the longest run of successive numbers in a sorted array."""
    begin = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(seen: Column, word: Column) -> Column:
        run = F.when(word == seen["last"] + 1, seen["run"] + 1).otherwise(F.lit(1))
        return F.struct(word.alias("last"), run.alias("run"), F.greatest(seen["best"], run).alias("best"))

    return F.aggregate(words, begin, step, lambda seen: seen["best"])


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """_row (all columns of docs) and items: the sorted ids of the benchmark items that a document holds, empty if none.

    Null and empty texts hold none. An item shorter than a window is one window, found anywhere in a text: by its template
    with LEAST_PLAIN plain words, else word for word, or by its template as a whole text. An item without words is never held. Null item ids are left out. Rows with equal doc_id and text get the same items.
    """
    found = leaks(docs, benchmark)
    rows = docs.select(F.struct("*").alias("_row"), *row_key(docs["doc_id"], docs["text"])).join(found, ["_uid", "_tie"], "left")
    return rows.select("_row", F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, in all their columns, that hold no benchmark item."""
    return marked(docs, benchmark).where(F.size("items") == 0).select("_row.*")


@llm_query()
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items that each document holds."""
    rows = marked(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return rows.select("_row.doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items")
