"""Files of any size as pieces that are documents of their own.

A large file is read in chunks. What a chunk means depends on where the text before it left off: inside
a quoted field, inside a string, at which depth. Each chunk therefore reports, for every state it may start in,
the state it ends in; these reports, one small row a chunk, are composed in order for each file, and
then every chunk knows its start. It looks for the first place where one record ends and the next begins, and is cut there.
From one cut to the next is a piece. With the file's header, or closed by brackets, a piece reads
like a small file, by the same expressions as small files.

A file is JSON when its structure closes at its end and every piece is; else it is CSV. A record, and for objects
what lies outside their event arrays, has to fit a piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinefuse.functions.payload import RECORD
from kinefuse.functions.text import lenient_utf8
from kinefuse.sources.chunks import CHUNK_BYTES, PACKED_RATIO, is_packed, list_all_files, read_chunks
from kinefuse.sources.extract import csv_payload, own_columns, parse_documents, split_csv_fields, split_csv_records
from kinefuse.sources.files import plain_path, read_text_files, with_owner
from kinefuse.shipping import ship
from kinefuse.storage import LARGE_ROWS, write_and_read

# What Spark hides below a folder: a name on the way that starts with `.`, or with `_` and holds no `=`.
HIDDEN = r"/(?:\.|_[^/=]*(?:/|\z))"
#: Bytes of a file above which it is read in pieces. Chunks are no larger, and no larger than CHUNK_BYTES.
SPLIT_BYTES = 16 << 20

# States of a CSV reader: at a field's start, in a plain field, in a quoted field, after a quote in a quoted field.
START, PLAIN, QUOTED, AFTER = range(4)
# A move says for each of the four states which one follows, two bits each; _THEN holds the move that two moves make, first one first.
_FOLLOWS = (np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3
_THEN = (np.take(_FOLLOWS, _FOLLOWS, axis=1).transpose(1, 0, 2) << np.arange(0, 8, 2)).sum(axis=2).astype(np.uint8)


def _move(*follows: int) -> int:
    return sum(state << 2 * k for k, state in enumerate(follows))


_STAY, _AT_END, _AT_TEXT = _move(START, PLAIN, QUOTED, AFTER), _move(START, START, QUOTED, START), _move(PLAIN, PLAIN, QUOTED, PLAIN)
_AT_QUOTE = _move(QUOTED, PLAIN, AFTER, QUOTED)
# States of a JSON reader: outside strings, inside one, inside one and after a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)

_RECORD = rb'(?:"[^"]*+(?:""[^"]*+)*+(?:"|\Z))?+[^,\r\n]*+(?:,(?:"[^"]*+(?:""[^"]*+)*+(?:"|\Z))?+[^,\r\n]*+)*+'
_CSV_RECORD = re.compile(_RECORD)
#: What brings a reader at a record's start into each state.
_LEADS = {START: b"", PLAIN: b"x", QUOTED: b'"', AFTER: b'""'}
_BLANK = b" \t\r\n"


def csv_ends(content: bytes) -> list[int]:
    """The state a chunk ends in, for each of the four states it may start in."""
    data = np.frombuffer(content, np.uint8)
    quotes = np.flatnonzero(data == ord('"'))
    stops = np.append(quotes, len(data))
    sizes = stops - np.concatenate(([0], quotes + 1))
    before = data[np.maximum(stops - 1, 0)] if len(data) else np.zeros(1, np.uint8)
    ended = (before == ord(",")) | (before == ord("\n")) | (before == ord("\r"))
    moves = np.where(sizes == 0, _STAY, np.where(ended, _AT_END, _AT_TEXT)).astype(np.uint8)
    moves[1:] = _THEN[_AT_QUOTE][moves[1:]]
    while len(moves) > 1:
        if len(moves) % 2:
            moves = np.append(moves, np.uint8(_STAY))
        moves = _THEN[moves[::2], moves[1::2]]
    return _FOLLOWS[moves[0]].tolist()


def csv_cut(content: bytes, state: int) -> int | None:
    """Where the record that a chunk starts in is over, behind its line break; none if the chunk does not show it."""
    lead = _LEADS[state]
    end = _CSV_RECORD.match(lead + content).end() - len(lead)
    if end >= len(content):
        return None
    return end + (2 if content[end : end + 2] == b"\r\n" else 1)


_STRUCTURAL = np.zeros(256, bool)
_STRUCTURAL[list(b"{}[],")] = True


class Structure:
    """Brackets and commas of a chunk with the number of quotes before each, for one way of reading its first byte."""

    def __init__(self, content: bytes, escaped: bool):
        data = np.frombuffer(content, np.uint8)
        quotes, slashes = np.flatnonzero(data == ord('"')), np.flatnonzero(data == ord("\\"))
        if escaped:
            quotes, slashes = quotes[quotes > 0], slashes[slashes > 0]
        self.trails = False
        if len(slashes):
            first = np.append(True, np.diff(slashes) > 1)
            begin = slashes[first]
            end = slashes[np.append(first[1:], True)] + 1
            held = end[(end - begin) % 2 == 1]
            self.trails = bool(len(held) and held[-1] == len(data))
            quotes = quotes[~np.isin(quotes, held)]
        self.quotes = len(quotes)
        at = np.flatnonzero(_STRUCTURAL[data])
        self.at, self.kind, self.inner = at, data[at], np.searchsorted(quotes, at) % 2 == 1

    def end(self, inside: bool) -> int:
        """State after the chunk, started inside a string or not."""
        inside = inside != (self.quotes % 2 == 1)
        return ESCAPED if inside and self.trails else INSIDE if inside else OUTSIDE

    def outside(self, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        keep = self.inner == inside
        return self.at[keep], self.kind[keep]


def _steps(kind: np.ndarray) -> np.ndarray:
    return np.where((kind == ord("{")) | (kind == ord("[")), 1, np.where(kind == ord(","), 0, -1))


def json_ends(content: bytes) -> tuple[list[int], list[int]]:
    """For each of the three start states the end state, and by how much the depth grows."""
    plain = Structure(content, False)
    # A backslash before the chunk takes effect on its first byte only.
    escaped = Structure(content, True) if content[:1] in (b'"', b"\\") else plain
    ends = [plain.end(False), plain.end(True), escaped.end(True) if content else ESCAPED]
    grown = [int(_steps(s.outside(inside)[1]).sum()) for s, inside in ((plain, False), (plain, True), (escaped, True))]
    return ends, grown


# What is known of the value at depth 2 of an object document, when a chunk begins.
NO_EVENTS, UNDECIDED, EVENTS = range(3)


def _first_filled(content: bytes, start: int = 0) -> int | None:
    found = re.compile(rb"[^ \t\r\n]").search(content, start)
    return found.start() if found else None


def _opened(content: bytes, at: int) -> int:
    """What an array that opens at a place holds, by its first item."""
    if content[at : at + 1] != b"[":
        return NO_EVENTS
    first = _first_filled(content, at + 1)
    return UNDECIDED if first is None else EVENTS if content[first : first + 1] == b"{" else NO_EVENTS


def json_outline(content: bytes, state: int, depth: int, started: bool) -> tuple[int | None, int | None, bool]:
    """Of a chunk with known start: what its last value opened at depth 2 holds, what an undecided one turns out to be, and whether the document is sound here.

    It is not if it ends before the text does, or closes what is not open.
    """
    structure = Structure(content, state == ESCAPED)
    at, kind = structure.outside(state != OUTSIDE)
    steps = _steps(kind)
    depths = depth + np.cumsum(steps)
    first = _first_filled(content)
    resolved = None if first is None else EVENTS if content[first : first + 1] == b"{" else NO_EVENTS
    sound = not len(depths) or int(depths.min()) >= 0
    over = np.flatnonzero((depths == 0) & (steps < 0))
    if len(over):
        sound &= _first_filled(content, int(at[over[0]]) + 1) is None
    elif depth == 0 and started and state == OUTSIDE:
        sound &= first is None
    opens = np.flatnonzero((depths == 2) & (steps > 0))
    return (_opened(content, int(at[opens[-1]])) if len(opens) else None), resolved, sound


def json_cut(content: bytes, state: int, depth: int, held: int, is_array: bool) -> int | None:
    """Place of the first comma between two records: at depth 1 of an array, at depth 2 in an array of events of an object."""
    structure = Structure(content, state == ESCAPED)
    at, kind = structure.outside(state != OUTSIDE)
    depths = depth + np.cumsum(_steps(kind))
    if is_array:
        found = np.flatnonzero((kind == ord(",")) & (depths == 1))
        return int(at[found[0]]) if len(found) else None
    if held == UNDECIDED:
        first = _first_filled(content)
        held = EVENTS if first is not None and content[first : first + 1] == b"{" else NO_EVENTS
    commas = np.flatnonzero((kind == ord(",")) & (depths == 2))
    opens = np.flatnonzero((depths == 2) & (_steps(kind) > 0))
    # Commas by the value they lie in; of each value the first one is enough.
    value, first = np.unique(np.searchsorted(opens, commas), return_index=True)
    for number, k in zip(value.tolist(), first.tolist(), strict=True):
        if (held if number == 0 else _opened(content, int(at[opens[number - 1]]))) == EVENTS:
            return int(at[commas[k]])
    return None


REPORTS = "file_path string, chunk long, lead int, csv_ends array<int>, json_ends array<int>, grown array<long>"
STARTS = "file_path string, chunk long, root int, csv_state int, json_state int, depth long, started boolean, closed boolean"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for content in batch.column("content"):
            content = content.as_py()
            first = _first_filled(content)
            rows.append((None if first is None else content[first], csv_ends(content), *json_ends(content)))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("file_path"), batch.column("chunk"), *arrays], ["file_path", "chunk", "lead", "csv_ends", "json_ends", "grown"])


def _in_order(rows: pa.Table) -> list[dict]:
    return sorted(rows.to_pylist(), key=lambda r: r["chunk"])


def _compose(rows: pa.Table) -> pa.Table:
    """The states every chunk of one file starts in; root is the document's first character, closed whether it ends outside of everything."""
    out, root, csv, state, depth = [], None, START, OUTSIDE, 0
    for r in _in_order(rows):
        out.append([r["file_path"], r["chunk"], None, csv, state, depth, root is not None, None])
        root = r["lead"] if root is None else root
        csv, depth, state = r["csv_ends"][csv], depth + r["grown"][state], r["json_ends"][state]
    for row in out:
        row[2], row[7] = root, state == OUTSIDE and depth == 0
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_())
    names = [x.split()[0] for x in STARTS.split(", ")]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


OUTLINES = "file_path string, chunk long, opened int, resolved int, sound boolean"
HELD = "file_path string, chunk long, held int, sound boolean"


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            json_outline(content.as_py(), state, depth, started)
            for content, state, depth, started in zip(
                batch.column("content"), *(batch.column(n).to_pylist() for n in ("json_state", "depth", "started")), strict=True
            )
        ]
        columns = list(zip(*found, strict=True)) or [[]] * 3
        arrays = [pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.bool_()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("file_path"), batch.column("chunk"), *arrays], ["file_path", "chunk", "opened", "resolved", "sound"])


def _hold(rows: pa.Table) -> pa.Table:
    """What the value at depth 2 holds where each chunk of one file begins, and whether all chunks are sound."""
    out, held, sound = [], NO_EVENTS, True
    for r in _in_order(rows):
        out.append((r["file_path"], r["chunk"], held))
        if held == UNDECIDED and r["resolved"] is not None:
            held = r["resolved"]
        held = held if r["opened"] is None else r["opened"]
        sound &= r["sound"]
    names = ["file_path", "chunk", "held"]
    arrays = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int32()))]
    return pa.Table.from_arrays([*arrays, pa.array([sound] * len(out))], [*names, "sound"])


def _cuts(kind: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            places = []
            for k, chunk in enumerate(chunks):
                content = batch.column("content")[k].as_py()
                value = lambda name: batch.column(name)[k].as_py()  # noqa: B023, E731
                if kind == "csv":
                    places.append(csv_cut(content, value("csv_state")) if chunk else 0)
                else:
                    places.append(json_cut(content, value("json_state"), value("depth"), value("held"), value("root") == ord("[")) if chunk else 0)
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), batch.column("chunk"), batch.column("content"), pa.array(places, pa.int64())], ["file_path", "chunk", "content", "cut"])

    return cut


def _pieces(cut: DataFrame, skipped: int) -> DataFrame:
    """file_path, piece, content, is_last: from each cut to the next one. skipped: bytes of a cut that belong to no piece.

    A piece is put together from the chunks it reaches into: one for itself, others only as long as they hold no cut.
    """
    file = Window.partitionBy("file_path")
    earlier = file.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("cut")
    own = cut.select("file_path", "chunk", F.when(at.isNotNull(), F.col("chunk")).alias("own"))
    numbered = own.select("file_path", "chunk", F.last("own", ignorenulls=True).over(earlier).alias("before"), F.max("own").over(file).alias("last"))
    placed = cut.join(write_and_read(numbered, "piece-numbers"), ["file_path", "chunk"])
    skip = F.when(F.col("chunk") > 0, skipped).otherwise(0)
    size = F.octet_length("content")
    part = lambda owner, start, length: F.struct(owner.alias("piece"), F.substring("content", start.cast("int"), length.cast("int")).alias("content"))
    head = part(F.col("before"), F.lit(1), F.coalesce(at, size))
    rest = part(F.col("chunk"), at + skip + 1, size - at - skip)
    parts = F.array_compact(F.array(F.when(F.col("before").isNotNull(), head), F.when(at.isNotNull(), rest)))
    rows = placed.select("file_path", "chunk", "last", F.explode(parts).alias("part")).select("file_path", "chunk", "last", "part.*")
    joined = rows.groupBy("file_path", "piece").agg(F.sort_array(F.collect_list(F.struct("chunk", "content")))["content"].alias("parts"), F.max("last").alias("last"))
    text = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x))
    return joined.select("file_path", "piece", text.alias("content"), (F.col("piece") == F.col("last")).alias("is_last"))


def _json_documents(pieces: DataFrame, roots: DataFrame) -> DataFrame:
    """Pieces as documents: text, and whether what was cut apart was a list without gaps."""
    raw = lenient_utf8(F.col("content").cast("string"))
    first, trimmed = F.col("piece") == 0, F.btrim(raw, F.lit(" \t\r\n"))
    is_array = F.col("root") == ord("[")
    opening = F.when(first, "").when(is_array, "[").otherwise('{"\\u0002piece":[')
    closing = F.when(F.col("is_last"), "").when(is_array, "]").otherwise("]}")
    gap = (~first & ((trimmed == "") | F.startswith(trimmed, F.lit("]")))) | (~F.col("is_last") & ((trimmed == "") | F.endswith(trimmed, F.lit("["))))
    return pieces.join(roots, "file_path").select("file_path", "piece", F.concat(opening, raw, closing).alias("text"), (~gap).alias("whole"))


def _csv_parsed(pieces: DataFrame) -> DataFrame:
    """Pieces (a written table) under the header of their file: the first record of the first piece that has one."""
    texts = pieces.select("file_path", "piece", lenient_utf8(F.col("content").cast("string")).alias("text"))
    head = F.regexp_extract("text", r"(?s)\A[\r\n]*+(" + _RECORD.decode().replace(r"\Z", r"\z") + ")", 1)
    heads = texts.select("file_path", "piece", head.alias("head")).where("head <> ''")
    heads = write_and_read(heads.groupBy("file_path").agg(F.min(F.struct("piece", "head")).alias("first")), "heads")
    rows = texts.join(heads, "file_path", "left").withColumn("records", split_csv_records(F.col("text"))).withColumn("header", split_csv_fields(F.col("first.head")))
    own = F.when(F.col("piece") == F.col("first.piece"), F.slice("records", 2, F.size("records"))).when(F.col("piece") > F.col("first.piece"), F.col("records"))
    names = F.transform(F.array_distinct("header"), lambda k: F.struct(k.alias("name"), F.array(k).alias("path")))
    records = F.transform(own, lambda record: csv_payload(F.col("header"), record))
    none = F.array().cast(f"array<{RECORD}>")
    return rows.select(
        "file_path", "piece", F.lit("CSV").alias("format"), F.coalesce(records, none).alias("records"), F.coalesce(names, F.array().cast(COLUMNS)).alias("columns")
    )


COLUMNS = "array<struct<name:string,path:array<string>>>"


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (file_path, chunk, content) to pieces: file_path, piece, format, records, columns (of the whole file, in order), first_position (records before).

    chunks must be a written table; it is read several times. What is known of a file, a chunk or a piece is written
    before contents or records meet it: so they stay where they are, or are dealt out by chunk or piece. By file, a task would hold a whole one.
    """
    ship(chunks.sparkSession)
    reports = chunks.mapInArrow(_report, REPORTS).groupBy("file_path").applyInArrow(_compose, STARTS)
    starts = write_and_read(reports, "chunk-starts")
    may_be_json = F.col("closed") & F.col("root").isin(ord("["), ord("{"))
    candidates = chunks.join(starts.where(may_be_json).drop("csv_state", "closed"), ["file_path", "chunk"])
    held = write_and_read(candidates.mapInArrow(_outline, OUTLINES).groupBy("file_path").applyInArrow(_hold, HELD), "chunk-outlines")
    sound = candidates.join(held.where("sound").drop("sound"), ["file_path", "chunk"])
    cut = write_and_read(sound.mapInArrow(_cuts("json"), "file_path string, chunk long, content binary, cut long"), "json-cuts", **LARGE_ROWS)
    roots = write_and_read(starts.select("file_path", "root").distinct(), "roots")
    documents = write_and_read(_json_documents(_pieces(cut, 1), roots), "json-documents", **LARGE_ROWS)
    # Of a key that an object repeats the last value counts, wherever it is: such a document stays in one piece.
    keys = documents.where(F.col("text").rlike(r"\A\s*+\{")).select("file_path", F.explode(F.json_object_keys("text")).alias("key")).where("key <> '\u0002piece'")
    twice = write_and_read(keys.groupBy("file_path", "key").count().where("count > 1").select("file_path").distinct(), "repeated-keys")
    uncut = cut.join(twice, "file_path", "left_semi").withColumn("cut", F.when(F.col("chunk") == 0, F.col("cut")))
    documents = documents.join(twice, "file_path", "left_anti").unionByName(_json_documents(_pieces(uncut, 1), roots))
    parsed = parse_documents(documents)
    parsed = write_and_read(_counted(parsed).withColumn("sound", F.col("whole") & (F.col("format") == "JSON")).drop("whole"), "json-pieces", **LARGE_ROWS)
    as_json = write_and_read(parsed.groupBy("file_path").agg(F.min("sound").alias("sound")).where("sound").select("file_path"), "json-files")
    as_csv = chunks.join(as_json, "file_path", "left_anti").join(starts.select("file_path", "chunk", "csv_state"), ["file_path", "chunk"])
    csv_cut_ = write_and_read(as_csv.mapInArrow(_cuts("csv"), "file_path string, chunk long, content binary, cut long"), "csv-cuts", **LARGE_ROWS)
    csv_pieces = write_and_read(_pieces(csv_cut_, 0), "csv-pieces", **LARGE_ROWS)
    csv = write_and_read(_counted(_csv_parsed(csv_pieces)), "csv-records", **LARGE_ROWS)
    return _placed(parsed.join(as_json, "file_path", "left_semi").drop("sound").unionByName(csv))


def _counted(pieces: DataFrame) -> DataFrame:
    """Adds the number of records of a piece, so that it is known without reading them again."""
    return pieces.withColumn("n", F.size(F.filter("records", lambda r: ~F.map_contains_key(r, "\u0002end"))))


def _placed(pieces: DataFrame) -> DataFrame:
    """What a piece must know of its file instead of its own `columns` and `n`: all columns in the order of their first place, and the number of records before."""
    cells = pieces.select("file_path", "piece", F.posexplode("columns").alias("place", "column"))
    first = cells.groupBy("file_path", "column").agg(F.min(F.struct("piece", "place")).alias("at"))
    ordered = write_and_read(first.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("at", "column")))["column"].alias("columns")), "piece-columns")
    earlier = Window.partitionBy("file_path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = write_and_read(pieces.select("file_path", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("first_position")), "positions")
    rows = pieces.drop("columns", "n").join(ordered, "file_path", "left").join(counts, ["file_path", "piece"])
    return rows.withColumn("columns", own_columns(F.coalesce("columns", F.array().cast(COLUMNS))))


def read_parsed(
    spark: SparkSession,
    folders: list[str],
    split_bytes: int = SPLIT_BYTES,
    paths: list[str] | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Every file below the folders, parsed: source_path, source, file_path, modified, format, records, columns, first_position.

    Files that Spark shows and that are no larger than split_bytes are one row each; all others, hidden ones
    too, are a row a piece. The rows are the same for every split_bytes. `paths` narrows the reading to some files;
    `listing` is a written list of files (see `list_all_files`) that is known already, which may hold more than these folders.
    """
    if listing is None:
        listing = write_and_read(list_all_files(spark, folders).distinct(), "listing")
    named = listing.withColumn("file_path", plain_path(F.col("path")))
    if paths is not None:
        named = named.where(F.col("file_path").isin(paths))
    size = F.col("length") * F.when(is_packed(F.col("path")), PACKED_RATIO).otherwise(1)
    # A file below two of the folders is read by Spark if one of them shows it.
    shown = F.min(F.expr("substring(file_path, length(source_path) + 1)").rlike(HIDDEN))
    listing = with_owner(named, folders).groupBy("path", "modificationTime", "length").agg(shown.alias("hidden"))
    listing = write_and_read(listing.withColumn("in_pieces", (size > split_bytes) | F.col("hidden")), "ways")
    others = listing.where("in_pieces")
    alone = paths if paths is None else [r.path for r in listing.where("NOT in_pieces").select("path").collect()]
    whole = parse_documents(read_text_files(spark, folders, alone, split_bytes))
    whole = whole.withColumn("columns", own_columns(F.col("columns"))).withColumn("first_position", F.lit(0).cast("long"))
    if others.isEmpty():
        return whole
    chunks = write_and_read(read_chunks(others, min(split_bytes, CHUNK_BYTES)), "chunks", **LARGE_ROWS)
    times = others.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"))
    pieces = parse_chunks(chunks).drop("piece").join(times, "file_path").withColumn("file_path", plain_path(F.col("file_path")))
    return whole.unionByName(with_owner(pieces, folders).select(whole.columns))
