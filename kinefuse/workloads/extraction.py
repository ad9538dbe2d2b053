"""Files to events, file types, column resolution, roles, sections: text built from rows, then read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.functions.numbers import text_to_number
from kinefuse.operators import resolution, roles
from kinefuse.schemas import ROLES
from kinefuse.sources import extract, files
from kinefuse.storage import write_and_read
from kinefuse.workloads.registry import query, table
from kinefuse.workloads.standins import (
    SQL_DATA_SOURCES,
    SQL_SENSOR_EVENTS,
    SQL_TIME_TEXT,
    data_sources,
    sensor_events,
    time_text,
    with_sql,
)


def _file_rows(rows: DataFrame, text: Column) -> DataFrame:
    """Each sensor row as one small file holding `text`."""
    return rows.select(
        "source_path",
        "source",
        F.col("position").cast("string").alias("file_path"),
        F.col("event_timestamp").alias("modified"),
        text.alias("text"),
    )


def _entry(name: str) -> Column:
    return F.try_element_at("payload", F.lit(name))


def _digits(column: str) -> Column:
    return F.col(column).cast("string")


def _k() -> Column:
    return F.col("flow_val").cast("int").cast("string")


def _millis() -> Column:
    return F.expr("unix_millis(event_timestamp)").cast("string")


_SQL_MILLIS = f"strftime(make_timestamp(epoch_us(event_timestamp) // 1000 * 1000), '{SQL_TIME_TEXT}')"
_SQL_SECONDS = f"strftime(date_trunc('second', event_timestamp), '{SQL_TIME_TEXT}')"
_SQL_EXACT = f"strftime(event_timestamp, '{SQL_TIME_TEXT}')"


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + f"""
SELECT position AS file, CAST(0 AS BIGINT) AS event_no, {_SQL_MILLIS} AS event_time, speed_val AS speed, source AS kind FROM sensor_events
UNION ALL
SELECT position, 1, {_SQL_SECONDS}, flow_val, NULL FROM sensor_events"""
)
def extract_json_array(spark: SparkSession, folder: str) -> DataFrame:
    """Array documents: every object is an event, other items are not."""
    iso = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.concat(
        F.lit(' [{"speed":'), _digits("speed_val"), F.lit(',"time":'), _millis(), F.lit(',"kind":"'),
        F.col("source"), F.lit('"}, 7, "{\\"speed\\":1}", null, [{"speed":2}],\n{"speed":'), _k(),
        F.lit(',"date":"'), iso, F.lit('"}]\n'),
    )
    events = extract.extract_events(_file_rows(sensor_events(spark, folder, spread=True), text))
    return events.select(
        F.col("file_path").cast("long").alias("file"),
        F.col("position").alias("event_no"),
        time_text().alias("event_time"),
        text_to_number(_entry("speed")).alias("speed"),
        _entry("kind").alias("kind"),
    )


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + f"""
SELECT position AS file, CAST(0 AS BIGINT) AS event_no, {_SQL_EXACT} AS event_time, speed_val AS speed FROM sensor_events
UNION ALL
SELECT position, 1, {_SQL_SECONDS}, flow_val FROM sensor_events WHERE position % 3 <> 0
UNION ALL
SELECT position, 2, {_SQL_EXACT}, NULL FROM sensor_events WHERE position % 3 = 2"""
)
def extract_json_object(spark: SparkSession, folder: str) -> DataFrame:
    """Object documents: all arrays that start with an object, in key order, or the object itself."""
    seconds = F.floor(F.expr("unix_micros(event_timestamp)") / 1000000).cast("string")
    alert = F.concat(F.lit('{"speed":'), _digits("speed_val"), F.lit("}"))
    jam = F.concat(F.lit('{"speed":'), _k(), F.lit(',"timestamp":'), seconds, F.lit("}"))
    whole = F.concat(F.lit('{"empty":[],"nums":[1,{"speed":4}],"speed":'), _digits("speed_val"), F.lit("}"))
    two = F.concat(F.lit('{"at":1,"alerts":['), alert, F.lit(',3],"nums":[[{"speed":4}]],"jams":['), jam, F.lit("]}"))
    three = F.concat(F.lit('{"a":['), alert, F.lit("],"), F.lit('"b":['), jam, F.lit(',{}],"c":{"speed":9}}'))
    turn = F.col("position") % 3
    text = F.when(turn == 0, whole).when(turn == 1, two).otherwise(three)
    events = extract.extract_events(_file_rows(sensor_events(spark, folder, spread=True), text))
    return events.select(
        F.col("file_path").cast("long").alias("file"),
        F.col("position").alias("event_no"),
        time_text().alias("event_time"),
        text_to_number(_entry("speed")).alias("speed"),
    )


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + f"""
SELECT position AS file, CAST(0 AS BIGINT) AS event_no, {_SQL_EXACT} AS event_time, speed_val AS speed,
       'a "q", ' || chr(10) || 'b' AS note, source AS kind FROM sensor_events
UNION ALL
SELECT position, 1, {_SQL_EXACT}, flow_val, '5" pipe', NULL FROM sensor_events"""
)
def extract_csv(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files: each under its own header, quotes and short rows included."""
    text = F.concat(
        F.when(F.col("position") % 2 == 0, 'speed,note,kind\r\n').otherwise('speed,"note","kind"\n'),
        _digits("speed_val"), F.lit(',"a ""q"", \nb",'), F.col("source"), F.lit("\n\n"),
        _k(), F.lit(',5" pipe\n'),
    )
    events = extract.extract_events(_file_rows(sensor_events(spark, folder, spread=True), text))
    return events.select(
        F.col("file_path").cast("long").alias("file"),
        F.col("position").alias("event_no"),
        time_text().alias("event_time"),
        text_to_number(_entry("speed")).alias("speed"),
        _entry("note").alias("note"),
        _entry("kind").alias("kind"),
    )


@query(
    """
SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN 'JSON' ELSE 'CSV' END AS format,
       CASE WHEN doc_id % 6 IN (0, 1) THEN CAST(1 AS BIGINT) END AS records
FROM documents"""
)
def route_format(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as JSON documents, JSON lines, broken JSON and prose: JSON or else CSV."""
    quoted = F.to_json(F.struct("text"))
    turn = F.col("doc_id") % 6
    shown = (
        F.when(turn == 0, F.concat(F.lit("["), quoted, F.lit("]\n")))
        .when(turn == 1, F.concat(F.lit("\n"), quoted))
        .when(turn == 2, F.concat(quoted, F.lit("\n"), quoted))
        .when(turn == 3, F.concat(quoted, F.lit("]")))
        .when(turn == 4, F.lit("{'a': 1}"))
        .otherwise(F.col("text"))
    )
    routed = extract.route_format(table(spark, folder, "documents", "doc_id").select("doc_id", shown.alias("text")))
    return routed.select(
        "doc_id",
        "format",
        F.when(F.col("format") == "JSON", F.size("json_records").cast("long")).alias("records"),
    )


# Page addresses in the role of file paths: the host is the folder, the ending comes from the key.
_ENDINGS = (".csv", ".JSON", ".net.xml", ".xml.gz", ".xlsx", ".txt", ".csv.gz", ".net.xml.gz")
_SQL_ENDINGS = "list_extract([" + ", ".join(f"'{e}'" for e in _ENDINGS) + f"], page_id % {len(_ENDINGS)} + 1)"
_SQL_HOST = "regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+')"
_SQL_TYPE = f"""CASE {_SQL_ENDINGS} WHEN '.csv' THEN 'CSV' WHEN '.csv.gz' THEN 'CSV' WHEN '.JSON' THEN 'JSON'
     WHEN '.xml.gz' THEN 'XML' WHEN '.xlsx' THEN 'Excel' END"""


def _page_files(spark: SparkSession, folder: str) -> DataFrame:
    ending = F.get(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("page_id") % len(_ENDINGS)).cast("int"))
    return table(spark, folder, "pages").select(
        F.regexp_extract("url", "^[a-z]+://[^/]+/[a-z]+", 0).alias("folder"),
        F.concat(F.lit("page"), F.col("page_id").cast("string"), ending).alias("name"),
    )


@query(
    f"""
SELECT {_SQL_HOST} AS folder, coalesce(string_agg(DISTINCT {_SQL_TYPE}, ',' ORDER BY {_SQL_TYPE}), '') AS file_types
FROM pages GROUP BY 1"""
)
def file_types(spark: SparkSession, folder: str) -> DataFrame:
    """Supported file types per folder, road networks and unknown endings left out."""
    return files.file_types(_page_files(spark, folder)).select(
        "folder", F.array_join("file_types", ",").alias("file_types")
    )


_KINDS = "CASE length(folder) % 3 WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'LOCAL' ELSE 'regional' END"


@query(
    f"""
SELECT folder AS path, regexp_extract(folder, '[^/]*$') AS name, 'src_' || left(md5(folder), 8) AS id, file_types,
       CASE WHEN length(folder) % 3 < 2 THEN {_KINDS} ELSE 'UNASSOCIATED' END AS association_type
FROM (SELECT {_SQL_HOST} AS folder, string_agg(DISTINCT {_SQL_TYPE}, ',' ORDER BY {_SQL_TYPE}) AS file_types
      FROM pages GROUP BY 1)
WHERE file_types IS NOT NULL"""
)
def register_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Folders with a supported file become data sources; an unknown type reads as UNASSOCIATED."""
    found = files.file_types(_page_files(spark, folder)).withColumn("association_type", F.expr(_KINDS))
    return files.register_sources(found).select(
        "path", "name", "id", F.array_join("file_types", ",").alias("file_types"), "association_type"
    )


@query(
    """
SELECT source, CAST(min(doc_id) AS BIGINT) AS doc_id, arg_min(md5(text), doc_id) AS digest
FROM documents GROUP BY source"""
)
def sample_file(spark: SparkSession, folder: str) -> DataFrame:
    """First file of each source."""
    path = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    documents = table(spark, folder, "documents").select("source", path.alias("file_path"), "text")
    return files.sample_file(documents).select(
        "source", F.col("file_path").cast("long").alias("doc_id"), F.md5("text").alias("digest")
    )


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + """
SELECT source, array_to_string(list_sort(list_distinct(flatten(list(
         ['a', 'a.b', 'a.list', 'a.list.x', 'k' || CAST(CAST(flow_val AS BIGINT) % 3 AS VARCHAR), source, 'n'])))), ',') AS paths
FROM sensor_events GROUP BY source"""
)
def key_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every object path per source: inner objects listed, arrays looked through."""
    text = F.concat(
        F.lit('{"a":{"b":'), _digits("speed_val"), F.lit(',"list":[{"x":1},[{"x":2}],3]},"k'),
        (F.col("flow_val").cast("long") % 3).cast("string"), F.lit('":"{\\"y\\":1}","'),
        F.col("source"), F.lit('":null,"n":{}}'),
    )
    documents = sensor_events(spark, folder, spread=True).select("source", text.alias("json_text"))
    return roles.source_key_paths(documents).select("source", F.array_join("paths", ",").alias("paths"))


@query(
    """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CASE o_orderstatus WHEN 'F' THEN 'at, at.f, at.lat, speed' ELSE 'at, at.lat, at.' || lower(o_orderstatus) || ', speed' END WHEN 1 THEN 'k, k.v, list, list.x'
       WHEN 2 THEN 'speed,flow_' || lower(o_orderstatus) WHEN 3 THEN NULL ELSE '' END AS listed
FROM orders"""
)
def available_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The columns a document offers: paths of JSON, the header of CSV, nothing of other texts."""
    key, digits, status = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.lower("o_orderstatus")
    turn = key % 5
    text = (
        F.when(turn == 0, F.concat(F.lit('{"speed":'), digits, F.lit(',"at":{"lat":1,"'), status, F.lit('":"x, y"}}')))
        .when(turn == 1, F.concat(F.lit('[{"list":[{"x":'), digits, F.lit('}]},{"k":{"v":null}}, 3]')))
        .when(turn == 2, F.concat(F.lit(" speed,flow_"), status, F.lit("\r\n1,"), digits))
        .when(turn == 3, F.concat(F.lit("speed\n1,"), digits))
        .otherwise(digits)
    )
    return table(spark, folder, "orders").select("o_orderkey", roles.available_columns(text).alias("listed"))


# Wanted names and the columns of each file, by source; the first listed fit of the best kind wins.
_RESOLUTION = {
    "click": ("Speed", "flow", "x.density", "speed,data.flow,density,geo.lat"),
    "view": ("speed", "root.flow", "nothing", "avg_speed,root.flow_raw,SPEED,lon"),
    "error": ("a.speed", "flow", None, "b.speed,overflow,my.flow"),
    "signup": ("velo", "vehicle_count", "", "velocity,count,k"),
    "purchase": ("time", "q", "k", "a,b,c"),
}
# Speed, flow, intensity, latitude and longitude found; a pair where the last column, which not
# every file has, makes a difference: with it, without it.
_RESOLVED = {
    "click": ("speed", "data.flow", "density", ("geo.lat", None), None),
    "view": ("SPEED", "root.flow_raw", None, None, ("lon", None)),
    "error": ("b.speed", ("my.flow", "overflow"), None, None, None),
    "signup": ("velocity", "count", None, None, None),
    "purchase": ("event_timestamp", None, None, None, None),
}


def _sql_name(name: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if name is None else f"'{name}'"


def _sql_case(place: int) -> str:
    cases = []
    for source, found in _RESOLVED.items():
        full, short = found[place] if isinstance(found[place], tuple) else (found[place], found[place])
        cases.append(
            f"WHEN '{source}' THEN CASE WHEN bool_or(position % 2 = 0) THEN {_sql_name(full)} ELSE {_sql_name(short)} END"
        )
    return "CASE source " + " ".join(cases) + " END"


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + f"""
SELECT source, file_path, {_sql_case(0)} AS speed_col, {_sql_case(1)} AS flow_col,
       {_sql_case(2)} AS intensity_col, {_sql_case(3)} AS lat_col, {_sql_case(4)} AS lon_col
FROM sensor_events GROUP BY source, file_path"""
)
def resolve_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted names to each file's own columns in four tiers.

    Each event carries only some of the columns of its file, so their order comes from first appearance.
    """
    rows = sensor_events(spark, folder)

    def by_source(place: int) -> Column:
        chosen = F.lit(None).cast("string")
        for source, wanted in _RESOLUTION.items():
            chosen = F.when(F.col("source") == source, F.lit(wanted[place])).otherwise(chosen)
        return chosen

    names = F.split(by_source(3), ",")
    # Every second event lacks the last column, and all carry the two injected ones at the end.
    kept = F.when(F.col("position") % 2 == 0, names).otherwise(F.slice(names, F.lit(1), F.size(names) - 1))
    columns = F.concat(kept, F.array(F.lit("event_timestamp"), F.lit("sensor_id")))
    payload = F.map_from_arrays(columns, F.transform(columns, lambda _: F.lit("1")))
    events = rows.select("source", "file_path", "position", payload.alias("payload"))
    wanted = rows.select("source").distinct().select(
        "source",
        *[by_source(i).alias(r) for i, r in enumerate(ROLES[:3])],
        *[F.lit(None).cast("string").alias(r) for r in ROLES[3:]],
    )
    maps = write_and_read(wanted, "wanted")
    resolved = resolution.resolve_by_file(resolution.file_columns(events), maps)
    return resolved.select("source", "file_path", "speed_col", "flow_col", "intensity_col", "lat_col", "lon_col")


_SQL_PROFILE = """
profile AS (
  SELECT l_returnflag AS source, count_if(l_discount <> 0) AS filled, count(*) AS n FROM lineitem GROUP BY l_returnflag
)"""


@query(
    with_sql(_SQL_PROFILE)
    + """
SELECT source, CASE source WHEN 'A' THEN 'speed_kmh' WHEN 'N' THEN 'averageSpeed' END AS speed_col,
       CASE WHEN source = 'A' THEN 'vehicle_count' END AS flow_col,
       CASE WHEN source = 'A' AND filled > 0 THEN 'level' END AS intensity_col,
       CASE WHEN source = 'R' THEN 'seg.length' END AS distance_col,
       CASE WHEN source = 'R' THEN 'duration' END AS time_col,
       CASE WHEN source = 'R' THEN 'occ' END AS occupancy_col,
       CAST(0.99 AS DOUBLE) AS confidence_score
FROM profile"""
)
def discover_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Roles from column names and data: templates lose, direct columns rule out ingredients."""
    flag = F.col("l_returnflag")

    def payload(**columns: Column) -> Column:
        entries = [x for name, value in columns.items() for x in (F.lit(name.replace("__", ".")), value.cast("string"))]
        return F.create_map(*entries)

    zero, quantity, number = F.lit(0.0), F.col("l_quantity"), F.col("l_linenumber")
    first = payload(
        currentSpeed=zero, speed_kmh=quantity, vehicle_count=number, level=F.col("l_discount"),
        occ=F.col("l_tax"), length=quantity, duration=number, timestamp=number,
    )
    second = payload(averageSpeed=quantity, flow=number, density=number, occupancy=number, speed_note=F.lit("fast"))
    third = payload(seg__length=quantity, duration=number, time=zero, occ=F.col("l_tax"), q=F.lit("none"))
    events = table(spark, folder, "lineitem", "l_orderkey").select(
        flag.alias("source"), F.when(flag == "A", first).when(flag == "N", second).otherwise(third).alias("payload")
    )
    kinds = events.select("source").distinct().withColumn(
        "association_type", F.when(F.col("source") == "N", "GLOBAL").otherwise("LOCAL")
    )
    return roles.discover_roles(roles.column_profile(roles.payload_cells(events)), kinds)


_MAP_ROLES = {
    "speed_col": "CASE WHEN seq % 4 = 0 THEN 'v' END",
    "flow_col": "CASE WHEN seq % 2 = 0 THEN 'q' END",
    "intensity_col": "CASE WHEN seq % 7 = 0 THEN 'k' END",
    "distance_col": "CASE WHEN seq % 4 < 3 THEN 'd' END",
    "time_col": "CASE WHEN seq % 4 = 1 THEN 't' END",
    "occupancy_col": "CASE WHEN seq % 7 = 1 THEN 'o' END",
}


@query(
    with_sql(SQL_DATA_SOURCES)
    + """
SELECT path AS source, association_type = 'LOCAL' AND seq % 4 IN (2, 3) AS lacks_speed,
       association_type = 'LOCAL' AND seq % 7 NOT IN (0, 1) AS lacks_intensity,
       association_type = 'LOCAL' AND seq % 2 = 1 AS lacks_flow
FROM data_sources"""
)
def coverage_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Which variables the map of a LOCAL source cannot give."""
    maps = data_sources(spark, folder).withColumns({r: F.expr(e) for r, e in _MAP_ROLES.items()})
    return roles.coverage_warnings(maps).select(
        F.col("path").alias("source"), "lacks_speed", "lacks_intensity", "lacks_flow"
    )
