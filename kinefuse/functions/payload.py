"""Payload maps: parsing, flattening, pruning.

`from_json(text, 'map<string,string>')` keeps key order and leaves nested values as JSON text, but
afterwards the number 12 and the text "12", or an object and a text that holds an object, look the
same. `mark_text` puts U+0002 in front of every such text before parsing; `unmark` takes it away.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_MARK = "\u0002"
RECORD = "map<string,string>"
STRICT_JSON = {"allowSingleQuotes": "false"}

# Names the export keeps for itself.
RESERVED = ("event_timestamp", "sensor_id", "id")

_QUOTED_MARK = '"\\u0002'
_CONFUSABLE = r'(?<!\\)"(?=[\[{+\-.0-9]|true"|false")'


def mark_text(json_text: Column) -> Column:
    """Mark quoted values that would look like numbers, booleans, objects or arrays once unquoted."""
    return F.regexp_replace(json_text, F.lit(_CONFUSABLE), F.lit(r'"\\u0002'))


def unmark(value: Column) -> Column:
    return F.ltrim(value, F.lit(TEXT_MARK))


def _clean(value: Column) -> Column:
    """Value without marks, also inside what stayed JSON text."""
    return F.when(
        F.contains(value, F.lit(_QUOTED_MARK)), F.replace(value, F.lit(_QUOTED_MARK), F.lit('"'))
    ).otherwise(unmark(value))


def parse_record(json_text: Column) -> Column:
    """Object text to a map; of a repeated key the last value counts."""
    return last_wins(F.from_json(json_text, RECORD, STRICT_JSON))


def is_object(value: Column) -> Column:
    """Null for null, so for conditions only."""
    return F.startswith(value, F.lit("{"))


def is_array(value: Column) -> Column:
    return F.startswith(value, F.lit("["))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_while(
    value: Column, test: Callable[[Column], Column], step: Callable[[Column], Column], most: Column
) -> Column:
    """Apply `step` while `test` holds, at most `most` times; one expression whatever the number."""
    return F.aggregate(
        F.array_repeat(F.lit(0), F.coalesce(most, F.lit(0))), value, lambda v, _: F.when(test(v), step(v)).otherwise(v)
    )


def last_wins(record: Column) -> Column:
    """Map as parsed with each repeated key reduced to its last value."""

    def reduced(r: Column) -> Column:
        repeats = F.size(F.array_distinct(F.map_keys(r))) < F.size(F.map_keys(r))
        return F.when(repeats, entries_to_map(F.map_entries(r))).otherwise(r)

    return bind(record, reduced)


def _braces(text: Column) -> Column:
    """Opening brackets of objects in a text, no fewer than its levels of nesting."""
    return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))


def entries_to_map(entries: Column) -> Column:
    """Entries to a map. A repeated key keeps its first place and takes its last value."""

    def merge(items: Column) -> Column:
        return F.transform(
            F.array_distinct(F.transform(items, lambda e: e["key"])),
            lambda k: F.struct(
                k.alias("key"),
                F.element_at(F.filter(items, lambda e: e["key"] == k), -1)["value"].alias("value"),
            ),
        )

    def build(items: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(items, lambda e: e["key"])))
        return F.map_from_entries(F.when(distinct == F.size(items), items).otherwise(merge(items)))

    return bind(entries, build)


def _expand(leaves: Column) -> Column:
    """Replace each nested object by its own members, one level."""

    def open_up(e: Column) -> Column:
        inner = F.transform(
            F.map_entries(parse_record(e["value"])),
            lambda c: F.struct(
                F.concat(e["key"], F.lit("."), unmark(c["key"])).alias("key"),
                c["value"].alias("value"),
                F.concat(e["path"], F.array(c["key"])).alias("path"),
            ),
        )
        return F.when(is_object(e["value"]), inner).otherwise(F.array(e))

    return F.flatten(F.transform(leaves, open_up))


def _holds_object(leaves: Column) -> Column:
    return F.exists(leaves, lambda e: is_object(e["value"]))


def _leaves(record: Column) -> Column:
    """Leaves of a parsed record as (dotted name, value, path of keys), plain ones first, at any depth."""

    def plain_first(leaves: Column) -> Column:
        nested = F.filter(leaves, lambda e: is_object(e["value"]))
        plain = F.filter(leaves, lambda e: F.coalesce(~is_object(e["value"]), F.lit(True)))
        return F.concat(plain, _expand(nested))

    top = F.transform(
        F.map_entries(record),
        lambda e: F.struct(
            unmark(e["key"]).alias("key"), e["value"].alias("value"), F.array(e["key"]).alias("path")
        ),
    )

    def opened(leaves: Column) -> Column:
        levels = F.array_max(F.transform(leaves, lambda e: F.when(is_object(e["value"]), _braces(e["value"]))))
        first = F.when(_holds_object(leaves), plain_first(leaves)).otherwise(leaves)
        return repeat_while(first, _holds_object, _expand, levels)

    return bind(top, opened)


def flatten_record(record: Column) -> Column:
    """Nested objects to dotted names. Plain keys come first, then nested ones; arrays stay whole."""

    def entry(e: Column) -> Column:
        return F.struct(e["key"].alias("key"), _clean(e["value"]).alias("value"))

    return entries_to_map(F.transform(_leaves(record), entry))


def leaf_columns(record: Column) -> Column:
    """Names of the flattened record, in order, each with the keys that lead to its value."""
    return F.transform(_leaves(record), lambda e: F.struct(e["key"].alias("name"), e["path"].alias("path")))


def value_at(record: Column, path: Column) -> Column:
    """Value at a path of keys in a parsed record; only a path into nested objects parses them.

    A record without the nested value may have it under the dotted name as a plain key.
    """
    top = F.try_element_at(record, F.get(path, F.lit(0)))
    inner = F.aggregate(
        F.slice(path, F.lit(2), F.size(path)),
        top,
        lambda value, key: F.try_element_at(parse_record(value), key),
    )
    dotted = F.try_element_at(record, F.array_join(path, "."))
    return F.when(F.size(path) == 1, top).otherwise(F.coalesce(inner, dotted))


# In compact JSON: keys are kept, all other texts, numbers and words are taken out.
_KEY_OR_SCALAR = r'("(?:[^"\\]++|\\.)*+":)|"(?:[^"\\]++|\\.)*+"|[^"{}\[\],:]++'


def skeleton(record_json: Column) -> Column:
    """Structure of a record without its values. Records with one skeleton have the same columns."""
    return F.regexp_replace(record_json, F.lit(_KEY_OR_SCALAR), F.lit("$1"))


def strip_reserved(payload: Column) -> Column:
    """Payload without the names the export keeps for itself."""
    return F.map_filter(payload, lambda k, _: ~k.isin(*RESERVED))


def first_name_ending(names: Column, ending: str) -> Column:
    """First name, in order, whose lower-case form has the ending; null when there is none."""
    return F.get(F.filter(names, lambda n: F.endswith(F.lower(n), F.lit(ending))), F.lit(0))


def section_payload(payload_json: Column) -> Column:
    """Stored payload text to a flat map; unreadable text gives an empty map."""
    empty = F.create_map().cast(RECORD)
    return strip_reserved(flatten_record(F.coalesce(parse_record(mark_text(payload_json)), empty)))


def section_fields(payload_json: Column) -> Column:
    """Top-level plain values of a stored payload; objects are null, unreadable text gives an empty map."""
    empty = F.create_map().cast(RECORD)
    parsed = F.coalesce(parse_record(mark_text(payload_json)), empty)
    return F.transform_values(parsed, lambda _, v: F.when(~is_object(v), _clean(v)))


def key_paths(json_text: Column) -> Column:
    """Every object path in a JSON text, inner objects included, arrays transparent. Not distinct.

    Works on a list of (path, value) nodes. Each round gives every object its members and every
    array its items as nodes of their own, and takes the value from the opened node.
    """

    def node(path: Column, value: Column) -> Column:
        return F.struct(path.alias("path"), value.alias("value"))

    def opens(n: Column) -> Column:
        return is_object(n["value"]) | is_array(n["value"])

    def children(n: Column) -> Column:
        prefix = F.when(n["path"] == "", F.lit("")).otherwise(F.concat(n["path"], F.lit(".")))
        members = F.transform(
            F.map_entries(parse_record(n["value"])),
            lambda c: node(F.concat(prefix, unmark(c["key"])), c["value"]),
        )
        items = F.transform(
            F.from_json(n["value"], "array<string>", STRICT_JSON), lambda v: node(n["path"], v)
        )
        return F.when(is_object(n["value"]), members).otherwise(items)

    def opened(nodes: Column) -> Column:
        closed = F.lit(None).cast("string")
        return F.flatten(
            F.transform(
                nodes,
                lambda n: F.when(
                    opens(n), F.concat(F.array(node(n["path"], closed)), children(n))
                ).otherwise(F.array(n)),
            )
        )

    start = F.array(node(F.lit(""), mark_text(json_text)))
    rounds = F.length(json_text) - F.length(F.translate(json_text, "{[", ""))
    nodes = repeat_while(start, lambda ns: F.exists(ns, opens), opened, rounds)
    return F.filter(F.transform(nodes, lambda n: n["path"]), lambda p: p != "")
