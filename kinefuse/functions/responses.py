"""Model response texts: the JSON object at the end, the reasoning before it, KEY=VALUE lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinefuse.functions.payload import bind, entries_to_map, mark_text, parse_record, unmark
from kinefuse.functions.text import NULL_WORDS, strip, stripped_or_null
from kinefuse.schemas import ROLES

_NO_DATA = "map<string,string>"


def _block(text: Column) -> Column:
    """Where the last balanced {…} lies: struct(found, start, length), start counted from 1.

    The text up to its last closing brace is cut in front of every brace; walking the pieces from
    the end needs one step per brace instead of one per character.
    """
    head = F.regexp_extract(text, r"(?s)\A.*\}", 0)
    pieces = F.reverse(F.split(head, r"(?=[{}])"))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done")
    )

    def walk(state: Column, piece: Column) -> Column:
        depth = (
            F.when(F.startswith(piece, F.lit("}")), state["depth"] + 1)
            .when(F.startswith(piece, F.lit("{")), state["depth"] - 1)
            .otherwise(state["depth"])
        )
        stepped = F.struct(
            depth.alias("depth"),
            (state["length"] + F.length(piece)).alias("length"),
            (depth == 0).alias("done"),
        )
        return F.when(state["done"] | (piece == ""), state).otherwise(stepped)

    def place(end: Column) -> Column:
        return F.struct(
            end["done"].alias("found"),
            F.when(end["done"], F.length(head) - end["length"] + 1).otherwise(F.length(head)).alias("start"),
            F.when(end["done"], end["length"]).otherwise(0).alias("length"),
        )

    return F.when(head != "", bind(F.aggregate(pieces, start, walk), place))


def last_json_text(text: Column) -> Column:
    """Text of the last balanced {…} block; null when there is none."""
    return bind(_block(text), lambda b: F.when(b["found"], F.substr(text, b["start"], b["length"])))


def last_json(text: Column) -> Column:
    """That block as a map; an empty map when there is none or it is not JSON."""
    empty = F.create_map().cast(_NO_DATA)
    return F.coalesce(parse_record(mark_text(last_json_text(text))), empty)


def reasoning(text: Column) -> Column:
    """Text inside <think> tags, or else all text before the last JSON block."""
    tagged = F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)
    has_tags = text.rlike(r"(?s)<think>.*?</think>")
    before = bind(_block(text), lambda b: F.when(b.isNotNull(), F.left(text, b["start"] - 1)).otherwise(text))
    cleaned = strip(F.regexp_replace(strip(before), r"</?think>", ""))
    return F.when(has_tags, strip(tagged)).otherwise(cleaned)


def json_fields(record: Column) -> Column:
    """Map of the fields that name something: null words dropped, values stripped."""
    cleaned = F.transform_values(record, lambda _, v: stripped_or_null(unmark(v)))
    return F.map_filter(cleaned, lambda _, v: v.isNotNull())


def line_fields(text: Column) -> Column:
    """Map from KEY=VALUE lines; tags and {…} blocks are removed first, the last of a key counts."""
    bare = F.regexp_replace(F.regexp_replace(text, r"</?think>", ""), r"\{[^}]*\}", "")
    lines = F.filter(
        F.transform(F.split(bare, "\n"), strip), lambda line: F.contains(line, F.lit("="))
    )

    def entry(line: Column) -> Column:
        value = strip(F.regexp_extract(line, r"(?s)\A[^=]*=(.*)\z", 1))
        return F.struct(
            strip(F.substring_index(line, "=", 1)).alias("key"), F.btrim(value, F.lit("\",'")).alias("value")
        )

    kept = F.filter(F.transform(lines, entry), lambda e: ~F.upper(e["value"]).isin(*NULL_WORDS))
    return entries_to_map(kept)


def response_fields(text: Column) -> Column:
    """Fields of a response: from its JSON block, or from its lines when that gives none."""
    return bind(
        json_fields(last_json(text)),
        lambda fields: F.when(F.size(fields) > 0, fields).otherwise(line_fields(text)),
    )


def missing_roles(fields: Column) -> Column:
    """Required keys a response lacks."""
    return F.array_except(F.array(*[F.lit(r) for r in ROLES]), F.map_keys(fields))
