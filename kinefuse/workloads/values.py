"""Scalar expressions over the tables: numbers, times, names, payloads, roundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.functions import numbers, payload, text, times
from kinefuse.operators import export
from kinefuse.operators.resolution import location_columns as locate
from kinefuse.workloads.registry import query, table
from kinefuse.workloads.standins import SQL_TIME_TEXT, TIME_TEXT


def _by_key(key: Column, *choices: Column) -> Column:
    """One of the choices, by the key's remainder."""
    turn = key % len(choices)
    chosen = F.when(turn == 0, choices[0])
    for place, choice in enumerate(choices[1:], 1):
        chosen = chosen.when(turn == place, choice)
    return chosen


@query(
    """
SELECT o_orderkey, CASE o_orderkey % 10
    WHEN 0 THEN o_custkey + 0.25 WHEN 1 THEN -o_custkey WHEN 2 THEN o_custkey * 1000.0 WHEN 3 THEN 0.5
    WHEN 8 THEN CAST('inf' AS DOUBLE) END AS number
FROM orders"""
)
def lenient_number(spark: SparkSession, folder: str) -> DataFrame:
    """Text to number: signs, exponents and bare points count; padding, suffixes and words do not."""
    key, digits = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    shown = _by_key(
        key,
        F.concat(digits, F.lit(".25")),
        F.concat(F.lit("-"), digits),
        F.concat(digits, F.lit("E+3")),
        F.lit(".5"),
        F.concat(F.lit(" "), digits),
        F.concat(digits, F.lit("d")),
        F.lit(""),
        F.lit("NaN"),
        F.lit("Infinity"),
        F.concat(digits, F.lit("\n")),
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", numbers.text_to_number(shown).alias("number")
    )


@query("SELECT doc_id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS characters FROM documents")
def lenient_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Text with broken bytes put in, decoded: the text comes back."""
    half = (F.length("text") / 2).cast("int")
    broken = F.concat(
        F.encode(F.left("text", half), "UTF-8"),
        F.unhex(F.lit("FF")),
        F.encode(F.substr(F.col("text"), half + 1), "UTF-8"),
        F.unhex(F.lit("E282")),
    )
    decoded = table(spark, folder, "documents", "doc_id").select("doc_id", text.lenient_utf8(broken).alias("decoded"))
    return decoded.select(
        "doc_id", F.md5("decoded").alias("digest"), F.length("decoded").cast("long").alias("characters")
    )


@query(
    f"""
SELECT o_orderkey, strftime(CASE o_orderkey % 9
    WHEN 0 THEN make_timestamp(1500000000000000 + o_orderkey * 1000000)
    WHEN 1 THEN make_timestamp(1500000000250000 + o_orderkey * 1000000)
    WHEN 2 THEN make_timestamp(1500000000000000 + o_orderkey * 1000)
    WHEN 3 THEN o_orderdate + INTERVAL 10 HOUR + INTERVAL 30 MINUTE
    WHEN 4 THEN o_orderdate + INTERVAL 7 HOUR + INTERVAL 15 MINUTE
    WHEN 5 THEN o_orderdate
    WHEN 6 THEN TIMESTAMP '2001-02-03 04:05:06'
    WHEN 7 THEN TIMESTAMP '2001-02-03 04:05:06'
    ELSE make_timestamp(1000000) END, '{SQL_TIME_TEXT}') AS event_time
FROM orders"""
)
def event_time(spark: SparkSession, folder: str) -> DataFrame:
    """Event time from seconds, milliseconds and ISO texts; an unreadable first key ends the search."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    seconds = (F.lit(1500000000) + key).cast("string")

    def shown(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'{{"v": 1, "{name}": '), value, F.lit(', "event_timestamp": 5}'))

    document = _by_key(
        key,
        shown("timestamp", seconds),
        shown("time", F.concat(seconds, F.lit(".25"))),
        shown("pubMillis", (F.lit(1500000000000) + key).cast("string")),
        shown("date", F.concat(F.lit('"'), day, F.lit('T10:30:00Z"'))),
        shown("timestamp", F.concat(F.lit('"'), day, F.lit('T10:15:00+03:00"'))),
        shown("date", F.concat(F.lit('"'), F.replace(day, F.lit("-"), F.lit("")), F.lit('"'))),
        shown("timestamp", F.lit('"yesterday"')),
        shown("time", F.concat(F.lit('"'), seconds, F.lit('"'))),
        shown("time", F.lit("true")),
    )
    fallback = F.lit("2001-02-03 04:05:06").cast("timestamp")
    rows = table(spark, folder, "orders", "o_orderkey").select(
        "o_orderkey", payload.parse_record(payload.mark_text(document)).alias("record")
    )
    rows = rows.withColumn("time_text", times.time_value(F.col("record")))
    number = times.time_number(F.col("time_text"))
    time = F.coalesce(times.event_time(F.col("time_text"), number), fallback)
    return rows.select("o_orderkey", F.date_format(time, TIME_TEXT).alias("event_time"))


@query(
    f"""
SELECT o_orderkey, strftime(CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 1 HOUR
    WHEN 2 THEN o_orderdate + INTERVAL 125000 MICROSECOND WHEN 3 THEN o_orderdate - INTERVAL 2 HOUR END,
    '{SQL_TIME_TEXT}') AS event_timestamp
FROM orders"""
)
def export_time(spark: SparkSession, folder: str) -> DataFrame:
    """Stored time texts of several forms, as UTC; unreadable ones are null."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    shown = _by_key(
        F.col("o_orderkey"),
        day,
        F.concat(day, F.lit("T01:00:00Z")),
        F.concat(day, F.lit(" 00:00:00.125000")),
        F.concat(day, F.lit(" 00:00:00+02:00")),
        F.lit("None"),
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", F.date_format(times.iso_time(shown), TIME_TEXT).alias("event_timestamp")
    )


# Forms of one time; those without a clock, or without a day, give its start.
_TIME_FORMS = (
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "t"),
    ("MM/dd/yyyy hh:mm:ss a", "date_trunc('second', t)"),
    ("dd MMMM yyyy HH:mm", "date_trunc('minute', t)"),
    ("MMM d, yyyy h:mm a", "date_trunc('minute', t)"),
    ("EEE, dd MMM yyyy HH:mm:ss '+0130'", "date_trunc('second', t) - INTERVAL 90 MINUTE"),
    ("EEE MMM d HH:mm:ss yyyy", "date_trunc('second', t)"),
    ("yyyyMMddHHmmss", "date_trunc('second', t)"),
    ("dd-MMM-yyyy", "date_trunc('day', t)"),
    ("yyyy.MM.dd HH:mm", "date_trunc('minute', t)"),
    ("HH:mm yyyy/M/d", "date_trunc('minute', t)"),
    ("MMM yyyy", "date_trunc('month', t)"),
    # The first number is the month unless it is above 12.
    ("dd/MM/yyyy", "CASE WHEN day(t) > 12 THEN date_trunc('day', t) ELSE CAST(make_date(year(t), day(t), month(t)) AS TIMESTAMP) END"),
    ("HH:mm", "NULL"),
)
_SQL_TIME = "(o_orderdate + INTERVAL (o_orderkey * 7919 % 86400) SECOND + INTERVAL (o_custkey % 1000 * 1000) MICROSECOND)"


@query(
    f"""
SELECT o_orderkey, strftime(CASE o_orderkey % {len(_TIME_FORMS)} {" ".join(f"WHEN {k} THEN {sql}" for k, (_, sql) in enumerate(_TIME_FORMS))} END, '{SQL_TIME_TEXT}') AS event_timestamp
FROM (SELECT *, {_SQL_TIME} AS t FROM orders)"""
)
def mixed_times(spark: SparkSession, folder: str) -> DataFrame:
    """Stored times written in a dozen forms."""
    micros = (F.col("o_orderkey") * 7919 % 86400) * 1_000_000 + F.col("o_custkey") % 1000 * 1000
    time = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + micros)
    shown = _by_key(F.col("o_orderkey"), *(F.date_format(time, form) for form, _ in _TIME_FORMS))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.date_format(times.mixed_time(shown), TIME_TEXT).alias("event_timestamp")
    )


@query(
    """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount <> 0 THEN CAST(round_even(l_quantity / 2, 0) AS BIGINT) END AS speed_val,
       round_even(l_extendedprice * 0.015 * 100, 0) / 100 AS flow_val,
       CASE WHEN l_tax <> 0 THEN round_even((l_quantity * 1.015) * 100, 0) / 100 END AS intensity_val
FROM lineitem"""
)
def export_rounding(spark: SparkSession, folder: str) -> DataFrame:
    """Speed to whole numbers half-even, flow and intensity to hundredths, infinities to null."""
    infinite, nan = F.lit(float("inf")), F.lit(float("nan"))
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_discount") != 0, F.col("l_quantity") / 2).otherwise(-infinite).alias("speed_val"),
        (F.col("l_extendedprice") * 0.015).alias("flow_val"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity") * 1.015).otherwise(nan).alias("intensity_val"),
    )
    return export.export_rounding(rows)


@query(
    """
SELECT event_id,
       CASE event_id % 3 WHEN 0 THEN 'e,l,s,a.b,a.c.d' WHEN 1 THEN 'l,x' ELSE 'a.b,z' END AS names,
       CASE event_id % 3 WHEN 0 THEN value WHEN 2 THEN value * 2 END AS b,
       CASE event_id % 3 WHEN 0 THEN json_extract_string(props, '$.k') END AS d,
       CASE event_id % 3 WHEN 0 THEN '{"q":1}' END AS s
FROM events"""
)
def flatten_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Nested payloads to dotted names: plain keys first, empty objects gone, quoted JSON left alone."""
    value, k = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    document = _by_key(
        F.col("event_id"),
        F.concat(
            F.lit('{"a":{"b":'), value, F.lit(',"c":{"d":'), k, F.lit('}},"e":"'), F.col("event_type"),
            F.lit('","l":[1,{"z":2}],"s":"{\\"q\\":1}","n":{}}'),
        ),
        F.lit('{"l":[],"x":null,"y":{"w":{"v":{}}}}'),
        F.concat(F.lit('{"a.b":1,"z":0,"a":{"b":'), (F.col("value") * 2).cast("string"), F.lit("}}")),
    )
    flat = table(spark, folder, "events", "event_id").select(
        "event_id", payload.flatten_record(payload.parse_record(payload.mark_text(document))).alias("flat")
    )

    def entry(name: str) -> Column:
        return F.try_element_at("flat", F.lit(name))

    return flat.select(
        "event_id",
        F.array_join(F.map_keys("flat"), ",").alias("names"),
        numbers.text_to_number(F.coalesce(entry("a.b"))).alias("b"),
        entry("a.c.d").alias("d"),
        entry("s").alias("s"),
    )


@query(
    """
SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'speed_val,geo.id' ELSE 'speed_val' END AS names FROM events"""
)
def reserved_strip(spark: SparkSession, folder: str) -> DataFrame:
    """Stored payloads without the names the export keeps for itself."""
    document = _by_key(
        F.col("event_id"),
        F.lit('{"id":1,"speed_val":2,"event_timestamp":"x","geo":{"id":3},"sensor_id":"s"}'),
        F.concat(F.lit('{"speed_val":'), F.col("value").cast("string"), F.lit(',"id":{}}')),
    )
    flat = payload.section_payload(document)
    return table(spark, folder, "events", "event_id").select(
        "event_id", F.array_join(F.map_keys(flat), ",").alias("names")
    )


@query(
    """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pos.LAT' WHEN 1 THEN 'flat' WHEN 2 THEN 'a_Lat' END AS lat_col,
       CASE p_partkey % 4 WHEN 0 THEN 'lon' WHEN 1 THEN 'colon' END AS lon_col
FROM part"""
)
def location_columns(spark: SparkSession, folder: str) -> DataFrame:
    """First column, in order, whose name ends in lat or lon."""

    def names(*listed: str) -> Column:
        return F.array(F.col("p_name"), F.col("p_type"), *[F.lit(n) for n in listed])

    columns = _by_key(
        F.col("p_partkey"),
        names("pos.LAT", "lon", "lat"),
        names("flat", "lat", "colon", "lon"),
        names("lat_x", "a_Lat"),
        names("latitude", "longitude"),
    )
    return table(spark, folder, "part").withColumns(locate(columns)).select("p_partkey", "lat_col", "lon_col")


@query(
    """
SELECT c_custkey, 'section_' || lower(regexp_replace(c_name || ' Éß-' || c_mktsegment, '[^\\p{L}\\p{N}]', '_', 'g')) AS section
FROM customer"""
)
def section_name(spark: SparkSession, folder: str) -> DataFrame:
    """Source names to section names."""
    name = F.concat("c_name", F.lit(" Éß-"), "c_mktsegment")
    return table(spark, folder, "customer").select("c_custkey", text.section_name(name).alias("section"))


@query(
    """
SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN ' None ' WHEN 4 THEN p_name END AS plain,
       CASE p_partkey % 5 WHEN 4 THEN p_name END AS stripped
FROM part"""
)
def null_scrub(spark: SparkSession, folder: str) -> DataFrame:
    """Words that mean "no column" turn to null, with and without stripping."""
    words = _by_key(
        F.col("p_partkey"), F.lit("null"), F.lit(""), F.lit("NONE"), F.lit(" None "), F.col("p_name")
    )
    return table(spark, folder, "part").select(
        "p_partkey",
        text.null_words_to_null(words).alias("plain"),
        text.stripped_or_null(words).alias("stripped"),
    )
