"""Text files to events: JSON first, CSV when the text is not JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefuse.functions.payload import (
    RECORD,
    STRICT_JSON,
    bind,
    entries_to_map,
    flatten_record,
    is_object,
    last_wins,
    leaf_columns,
    mark_text,
    parse_record,
    skeleton,
    unmark,
    value_at,
)
from kinefuse.functions.times import event_time, time_number, time_value

JSON_BLANKS = " \t\r\n"
_SENTINEL = "\u0002end"
_ITEMS = "array<string>"
_RECORDS = f"array<{RECORD}>"
_COLUMNS = "array<struct<name:string,path:array<string>>>"

# A nested object shows in the text of a file as a colon and a brace. (Inside a quoted text it may
# show too; then only time is lost.)
_NESTED = r":\s*+\{"

# CSV, as the usual dialect has it: a quote opens a quoted field only at the start of a field.
# Possessive repeats keep the matcher from backtracking or recursing on long text.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
_FIELD = rf"(?:{_QUOTED})?+[^,\r\n]*+"
_CSV_RECORD = rf"{_FIELD}(?:,{_FIELD})*+"
_CSV_FIELD = rf",((?:{_QUOTED})?+[^,]*+)"
_CSV_QUOTED = r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"?(.*)\z'


def _closed(body: Column, closing: str, extra: str) -> Column:
    """Body with `extra` put before its last bracket; not closed by that bracket gives null."""
    opened = F.left(body, F.length(body) - 1)
    return F.when(F.endswith(body, F.lit(closing)), F.concat(opened, F.lit(extra + closing)))


def json_array_items(body: Column) -> Column:
    """Items of an array document as text; null when the whole text is not one array.

    A last item is added before parsing. It is missing afterwards when the array ended earlier,
    which is how text after the document shows.
    """
    guarded = F.from_json(_closed(body, "]", ',"\\u0002end"'), _ITEMS, STRICT_JSON)
    return F.when(body.rlike(r"\A\[\s*\]\z"), F.array().cast(_ITEMS)).otherwise(
        bind(
            guarded,
            lambda items: F.when(
                F.try_element_at(items, F.lit(-1)) == _SENTINEL,
                F.slice(items, F.lit(1), F.size(items) - 1),
            ),
        )
    )


def json_object_entries(body: Column) -> Column:
    """Entries of an object document; null when the whole text is not one object."""
    guarded = F.map_entries(F.from_json(_closed(body, "}", ',"\\u0002end":0'), RECORD, STRICT_JSON))
    empty = F.map_entries(F.create_map().cast(RECORD))
    return F.when(body.rlike(r"\A\{\s*\}\z"), empty).otherwise(
        bind(
            guarded,
            lambda entries: F.when(
                F.try_element_at(entries, F.lit(-1))["key"] == _SENTINEL,
                F.map_entries(entries_to_map(F.slice(entries, F.lit(1), F.size(entries) - 1))),
            ),
        )
    )


def _starts_with_object(value: Column) -> Column:
    """Whether an array in an object document holds events; null for other values."""
    return F.startswith(value, F.lit("[{"))


def _body(text: Column) -> Column:
    return mark_text(F.btrim(text, F.lit(JSON_BLANKS)))


def _object_records(entries: Column, body: Column) -> Column:
    """Records of an object document: its arrays that start with an object, else the object itself."""
    chosen = F.transform(
        F.filter(entries, lambda e: _starts_with_object(e["value"])),
        lambda e: F.from_json(e["value"], _ITEMS, STRICT_JSON),
    )
    return F.when(
        entries.isNotNull(),
        bind(F.flatten(chosen), lambda items: F.when(F.size(items) > 0, items).otherwise(F.array(body))),
    )


def json_records(text: Column) -> Column:
    """Texts of the event objects in a JSON document, in order; null when the text is not JSON."""
    return _body_records(_body(text))


def _body_records(marked: Column) -> Column:
    def read(body: Column) -> Column:
        root_array = json_array_items(body)
        root_object = bind(json_object_entries(body), lambda entries: _object_records(entries, body))
        items = F.when(F.startswith(body, F.lit("[")), root_array).when(
            F.startswith(body, F.lit("{")), root_object
        )
        return F.filter(items, is_object)

    return bind(marked, read)


def split_csv_records(text: Column) -> Column:
    """CSV text to records, blank lines skipped; a quoted field may contain line breaks."""
    plain = F.split(text, r"\r\n|\n|\r")
    quoted = F.regexp_extract_all(text, F.lit(_CSV_RECORD), F.lit(0))
    return F.filter(
        F.when(F.contains(text, F.lit('"')), quoted).otherwise(plain), lambda r: r != ""
    )


def split_csv_fields(record: Column) -> Column:
    """CSV record to field texts, quotes removed."""

    def unquote(field: Column) -> Column:
        inner = F.replace(F.regexp_extract(field, _CSV_QUOTED, 1), F.lit('""'), F.lit('"'))
        return F.when(
            F.startswith(field, F.lit('"')), F.concat(inner, F.regexp_extract(field, _CSV_QUOTED, 2))
        ).otherwise(field)

    quoted = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CSV_FIELD), F.lit(1)), unquote
    )
    return F.when(F.contains(record, F.lit('"')), quoted).otherwise(F.split(record, ","))


def csv_payload(header: Column, record: Column) -> Column:
    """Payload of one record: missing fields are null, surplus fields are left out."""
    return bind(
        split_csv_fields(record),
        lambda fields: entries_to_map(
            F.transform(
                header, lambda name, i: F.struct(name.alias("key"), F.get(fields, i).alias("value"))
            )
        ),
    )


def _csv_parts(text: Column) -> Column:
    """Header and payload maps of a CSV text."""

    def parts(records: Column) -> Column:
        body = F.slice(records, F.lit(2), F.size(records))
        return bind(
            split_csv_fields(F.get(records, F.lit(0))),
            lambda header: F.struct(
                header.alias("header"),
                F.transform(body, lambda record: csv_payload(header, record)).alias("records"),
            ),
        )

    return bind(split_csv_records(text), parts)


def _top_columns(names: Column) -> Column:
    """Distinct top-level names as columns."""
    return F.transform(
        F.array_distinct(names), lambda k: F.struct(unmark(k).alias("name"), F.array(k).alias("path"))
    )


def _nested_columns(texts: Column) -> Column:
    """Columns of records with nested objects, from the first record of each structure."""

    def first_of_each(skeletons: Column) -> Column:
        return F.transform(
            F.array_distinct(skeletons),
            lambda shape: leaf_columns(parse_record(F.get(texts, F.array_position(skeletons, shape).cast("int") - 1))),
        )

    return F.array_distinct(F.flatten(bind(F.transform(texts, skeleton), first_of_each)))


def _sensor(source: Column) -> Column:
    return F.coalesce(F.when(source != "", source), F.lit("generic_sensor"))


def own_columns(columns: Column) -> Column:
    """Payload columns in order, then the event's own time and sensor."""
    own = [F.struct(F.lit(n).alias("name"), F.array(F.lit(n)).alias("path")) for n in ("event_timestamp", "sensor_id")]
    return F.array_distinct(F.concat(columns, F.array(*own)))


def route_format(files: DataFrame) -> DataFrame:
    """Add `format` (JSON or CSV, by content) and `json_records`."""
    routed = files.withColumn("json_records", json_records(F.col("text")))
    return routed.withColumn(
        "format", F.when(F.col("json_records").isNull(), "CSV").otherwise("JSON")
    )


def parse_files(files: DataFrame) -> DataFrame:
    """Whole files to `records` array<map>, their `format`, and the ordered `columns` of the file, its own time and sensor last."""
    return parse_documents(files).withColumn("columns", own_columns(F.col("columns")))


def parse_documents(files: DataFrame) -> DataFrame:
    """The same, with the columns of the payloads alone.

    All stay on the file's row, so finding out which columns a file has needs no shuffle. Records
    are not flattened: a column is a dotted name and the keys that lead to its values, so that only
    the values that are wanted get read.

    Most JSON files parse in one go (`fast`), closed by one more object that shows whether the
    document ended where the text does. Texts of single records are needed only for files with
    items that are no objects, and for the structure of files with nested objects. The steps are
    columns, not nested lambdas, because a lambda copies the arrays it hands on.
    """
    kept = [c for c in files.columns if c != "text"]
    body, fast, texts = F.col("body"), F.col("fast"), F.col("json_texts")
    is_array = F.startswith(body, F.lit("["))
    opened = files.withColumn("body", _body(F.col("text"))).withColumns(
        {
            "root_array": F.when(
                is_array, F.from_json(_closed(body, "]", ',{"\\u0002end":0}'), _RECORDS, STRICT_JSON)
            ),
            "root_object": F.when(
                F.startswith(body, F.lit("{")),
                last_wins(F.from_json(_closed(body, "}", ',"\\u0002end":0'), RECORD, STRICT_JSON)),
            ),
        }
    )
    array_ends = F.map_contains_key(F.try_element_at("root_array", F.lit(-1)), _SENTINEL)
    inner = F.transform(
        F.filter(F.map_values("root_object"), _starts_with_object),
        lambda v: F.from_json(v, _RECORDS, STRICT_JSON),
    )
    in_one_go = F.when(array_ends, F.col("root_array")).when(
        F.map_contains_key("root_object", _SENTINEL), F.flatten(inner)
    )
    is_fast = fast.isNotNull() & (F.size(fast) > 0) & ~F.exists(fast, lambda r: r.isNull())
    staged = opened.withColumn("fast", in_one_go).select(
        *kept, "text", "body", F.when(is_fast, fast).alias("fast")
    )
    single = F.when(fast.isNotNull() & is_array, F.from_json(body, _ITEMS, STRICT_JSON)).otherwise(
        _body_records(body)
    )
    staged = staged.withColumn(
        "json_texts", F.when(fast.isNull() | body.rlike(_NESTED), single)
    ).drop("body")
    is_json = fast.isNotNull() | texts.isNotNull()
    keys = F.array_remove(F.flatten(F.transform(fast, F.map_keys)), _SENTINEL)
    staged = staged.withColumn("csv", F.when(~is_json, _csv_parts(F.col("text")))).drop("text")
    columns = F.coalesce(
        F.when(texts.isNotNull(), _nested_columns(texts)),
        F.when(fast.isNotNull(), _top_columns(keys)),
        _top_columns(F.col("csv.header")),
        F.array().cast(_COLUMNS),
    )
    staged = staged.withColumn("columns", columns)
    records = (
        F.when(fast.isNotNull(), F.transform(fast, last_wins))
        .when(texts.isNotNull(), F.transform(texts, parse_record))
        .otherwise(F.col("csv.records"))
    )
    return staged.select(
        *kept,
        F.when(is_json, "JSON").otherwise("CSV").alias("format"),
        records.alias("records"),
        F.col("columns"),
    )


def explode_records(parsed: DataFrame) -> DataFrame:
    """One row per event with its unflattened `record`. The sensor is the source; a file's time
    dates events without their own. Of a file in pieces, `first_position` counts the records before each.

    The outer form keeps Spark from adding a filter on the array below, which would parse each
    file a second time.
    """
    kept = [c for c in parsed.columns if c not in ("records", "columns", "first_position")]
    first = F.col("first_position") if "first_position" in parsed.columns else F.lit(0).cast("long")
    rows = parsed.select(*kept, first.alias("first_position"), F.posexplode_outer("records").alias("line", "record")).filter(
        F.col("line").isNotNull() & ~F.map_contains_key("record", _SENTINEL)
    )
    dated = rows.withColumn(
        "time_text", F.when(F.col("format") == "JSON", time_value(F.col("record")))
    ).withColumn("time_number", time_number(F.col("time_text")))
    return dated.select(
        *[c for c in kept if c not in ("modified", "format")],
        "format",
        (F.col("first_position") + F.col("line")).alias("position"),
        F.coalesce(event_time(F.col("time_text"), F.col("time_number")), F.col("modified")).alias(
            "event_timestamp"
        ),
        _sensor(F.col("source")).alias("sensor_id"),
        "record",
    )


def column_values(parsed: DataFrame) -> DataFrame:
    """Parsed files to one row per event and column: (source_path, column, value)."""
    rows = explode_records(parsed.withColumn("listed", F.col("columns")))
    cells = rows.select("source_path", "record", F.explode_outer("listed").alias("column"))
    return cells.select(
        "source_path",
        F.col("column.name").alias("column"),
        unmark(value_at(F.col("record"), F.col("column.path"))).alias("value"),
    )


def extract_events(files: DataFrame) -> DataFrame:
    """Files (source, file_path, modified, text) to events with flat payloads."""
    return events_of(parse_files(files))


def events_of(parsed: DataFrame) -> DataFrame:
    """Parsed files to events with flat payloads."""
    rows = explode_records(parsed)
    payload = F.when(F.col("format") == "JSON", flatten_record(F.col("record"))).otherwise(F.col("record"))
    return rows.withColumn("payload", payload).drop("record", "format")
