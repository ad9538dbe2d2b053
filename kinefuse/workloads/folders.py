"""Jobs over real folders: the tables' own, and sensor files that Spark writes from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.functions.numbers import text_to_number
from kinefuse.operators.export import sort_by_time
from kinefuse.plans.fusion import build_unified
from kinefuse.sources import files
from kinefuse.sources.chunks import landing_chunks, list_all_files, write_files
from kinefuse.sources.extract import events_of
from kinefuse.sources.splits import read_parsed
from kinefuse.storage import new_path, write_and_read
from kinefuse.workloads.measures import SQL_FLOW, SQL_SPEED
from kinefuse.workloads.registry import query, table
from kinefuse.workloads.standins import SQL_SENSOR_EVENTS, sensor_events, with_sql

# Events per sensor file; it bounds what one file, and so one group below, can hold.
EVENTS_PER_FILE = 2000

# Sources whose files are CSV; the others write JSON arrays.
CSV_SOURCES = ("view", "error")


_SQL_TYPE = """CASE WHEN lower(name) LIKE '%.net.xml' OR lower(name) LIKE '%.net.xml.gz' THEN NULL
       WHEN lower(name) LIKE '%.csv' OR lower(name) LIKE '%.csv.gz' THEN 'CSV'
       WHEN lower(name) LIKE '%.json' OR lower(name) LIKE '%.json.gz' THEN 'JSON'
       WHEN lower(name) LIKE '%.xml' OR lower(name) LIKE '%.xml.gz' THEN 'XML'
       WHEN lower(name) LIKE '%.xls' OR lower(name) LIKE '%.xlsx' THEN 'Excel' END"""


@query(
    f"""
WITH listed AS (
  SELECT url || '/' || page_id || CASE page_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.JSON.gz' WHEN 2 THEN '.net.xml' WHEN 3 THEN '.xlsx' WHEN 4 THEN '' ELSE '.txt' END AS path,
         strlen(html) AS size FROM pages
), named AS (
  SELECT path, size, regexp_extract(path, '^(.*)/[^/]*$', 1, 's') AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM listed
), typed AS (SELECT *, {_SQL_TYPE} AS file_type FROM named)
SELECT path, folder, name, CASE WHEN name LIKE '%.%' THEN lower('.' || split_part(name, '.', -1)) ELSE '' END AS extension,
       CAST(size AS BIGINT) AS size_bytes, file_type, coalesce(file_type IN ('CSV', 'JSON'), FALSE) AS is_parsed
FROM typed"""
)
def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as a listing of files: name, extension and type of each."""
    ending = F.expr("CASE page_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.JSON.gz' WHEN 2 THEN '.net.xml' WHEN 3 THEN '.xlsx' WHEN 4 THEN '' ELSE '.txt' END")
    path = F.concat("url", F.lit("/"), F.col("page_id").cast("string"), ending)
    listed = table(spark, folder, "pages").select(path.alias("path"), F.octet_length("html").cast("long").alias("length"))
    return files.file_inventory(listed)


def write_sensor_files(spark: SparkSession, folder: str, target: str) -> None:
    """Events as sensor files, one folder per event type and `EVENTS_PER_FILE` events per file."""
    number, speed, k = F.col("position"), F.col("speed_val"), F.col("flow_val").cast("int")
    record = F.to_json(
        F.struct(
            F.expr("unix_millis(event_timestamp)").alias("time"),
            speed.alias("speed_kmh"),
            k.alias("vehicle_count"),
            F.struct((speed / 10).alias("lat"), (-k).alias("lon")).alias("geo"),
        )
    )
    line = F.concat_ws(",", speed.cast("string"), (k % 5).cast("string"), (k / 4).cast("string"))
    is_csv = F.col("source").isin(*CSV_SOURCES)
    lines = sensor_events(spark, folder, spread=True).select(
        "source",
        F.floor(number / EVENTS_PER_FILE).alias("chunk"),
        F.struct(number.alias("number"), F.when(is_csv, line).otherwise(record).alias("line")).alias("entry"),
    )
    grouped = lines.groupBy("source", "chunk").agg(F.array_sort(F.collect_list("entry"))["line"].alias("lines"))
    text = F.when(is_csv, F.concat(F.lit("distance,duration,occ\n"), F.array_join("lines", "\n"))).otherwise(
        F.concat(F.lit("["), F.array_join("lines", ","), F.lit("]"))
    )
    grouped.select("source", text.alias("value")).write.partitionBy("source").option(
        "maxRecordsPerFile", 1
    ).text(target)


_SQL_FILE_ROWS = f"""
readings AS (
  SELECT source, position // {EVENTS_PER_FILE} AS chunk, position,
         make_timestamp(epoch_us(event_timestamp) // 1000 * 1000) AS event_timestamp,
         CASE WHEN source IN ('view', 'error') THEN CASE WHEN CAST(flow_val AS BIGINT) % 5 <> 0 THEN speed_val / (CAST(flow_val AS BIGINT) % 5) END
              ELSE speed_val END AS speed_val,
         CASE WHEN source IN ('click', 'purchase') THEN flow_val END AS flow_val,
         flow_val / 4 AS occ, speed_val / 10 AS lat, -flow_val AS lon
  FROM sensor_events
), per_file AS (
  SELECT source, {SQL_SPEED} AS speed_val,
         CASE WHEN source IN ('view', 'error') THEN CAST(count(*) AS DOUBLE) ELSE {SQL_FLOW} END AS flow_val,
         avg(occ) AS occ, arg_min(lat, position) AS lat, arg_min(lon, position) AS lon
  FROM readings GROUP BY source, chunk
)"""


@query(
    with_sql(SQL_SENSOR_EVENTS, _SQL_FILE_ROWS)
    + """
SELECT 'source=' || source AS sensor_id, CASE WHEN source = 'click' THEN '1' END AS sumo_id,
       CASE WHEN source = 'click' THEN 'NATION_1' END AS location_text,
       CASE WHEN source NOT IN ('view', 'error') THEN lat END AS lat, CASE WHEN source NOT IN ('view', 'error') THEN lon END AS lon,
       CASE WHEN source = 'signup' THEN 'GLOBAL' ELSE 'LOCAL' END AS origin_type,
       CAST(round_even(speed_val, 0) AS BIGINT) AS speed_val, round_even(flow_val * 100, 0) / 100 AS flow_val,
       round_even((CASE WHEN source IN ('view', 'error') THEN occ WHEN speed_val > 0 THEN flow_val / speed_val ELSE 0.0 END) * 100, 0) / 100 AS intensity_val,
       'section_source_' || source AS source_table
FROM per_file"""
)
def fuse_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Sensor folders to the delivered dataset: scan, discover roles, compute, store, locate, sort.

    Event times are left out: CSV files date their events by when they were written.
    """
    target = new_path(spark, "sensors")
    write_sensor_files(spark, folder, target)
    source = F.col("source")
    sources = sensor_events(spark, folder).select("source").distinct().select(
        F.concat(F.lit(target + "/source="), source).alias("path"),
        F.concat(F.lit("source="), source).alias("name"),
        F.when(source == "signup", "GLOBAL").otherwise("LOCAL").alias("association_type"),
        F.when(source == "click", "1").alias("associated_element_id"),
        F.lit(0).alias("seq"),
    )
    # One path per sensor folder, as a user of the job would list them.
    folders = [row.path for row in sources.select("path").collect()]
    edges = spark.read.parquet(f"{folder.rstrip('/')}/nation.parquet").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("real_name")
    )
    return sort_by_time(build_unified(spark, sources, folders, edges)).drop("event_timestamp")


# Bytes of a split: small, so that each of the files below falls apart into many.
SPLIT = 16 << 10


def write_large_files(spark: SparkSession, folder: str, target: str) -> None:
    """One file for each event type, written by one task as a stream of lines: CSV with quoted line breaks, arrays, and an object with two arrays."""
    events = sensor_events(spark, folder)
    number, speed, source = F.col("position"), F.col("speed_val"), F.col("source")
    note = F.concat(F.lit('say "'), number.cast("string"), F.lit('",\n{['), source)
    quoted = F.concat(F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))
    record = F.concat(F.to_json(F.struct(number.alias("id"), speed.alias("speed"), note.alias("note"), F.struct(F.struct(number.alias("c")).alias("b")).alias("a"))), F.lit(","))
    csv = F.concat_ws(",", number.cast("string"), speed.cast("string"), quoted)
    is_csv, is_object = source.isin(*CSV_SOURCES), source == "purchase"
    part = F.when(is_object, number % 2).otherwise(0)
    lines = events.select("source", part.alias("part"), number.alias("at"), F.when(is_csv, csv).otherwise(record).alias("line"))
    first, last = F.lit(-1).cast("long"), F.lit(2).cast("long")
    kinds = events.select("source").distinct()
    opening = F.when(is_csv, "id,speed,note").when(is_object, '{"meta":{"pages":[1,{"x":2}]},"even":[').otherwise("[")
    closing = F.when(is_csv, "").when(is_object, 'null],"end":[[],{"id":0}]}').otherwise("[7]]")
    between = kinds.where(is_object).select("source", F.lit(1).cast("long").alias("part"), first.alias("at"), F.lit('null],"odd":[').alias("line"))
    ends = kinds.select("source", F.explode(F.array(F.struct(first.alias("part"), first.alias("at"), opening.alias("line")), F.struct(last.alias("part"), first.alias("at"), closing.alias("line")))).alias("end"))
    rows = lines.unionByName(between).unionByName(ends.select("source", "end.*"))
    ordered = rows.repartition("source").sortWithinPartitions("source", "part", "at")
    ordered.select("source", F.col("line").alias("value")).write.partitionBy("source").text(target)


def _large_files(spark: SparkSession, folder: str) -> list[str]:
    target = new_path(spark, "large-files")
    write_large_files(spark, folder, target)
    kinds = sensor_events(spark, folder).select("source").distinct()
    # One path per sensor folder, as a user of the job would list them.
    return [f"{target}/source={row.source}" for row in kinds.collect()]


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + """
SELECT 'source=' || source AS sensor, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN source = 'purchase' THEN position % 2 ELSE 0 END, position) - 1 AS event_no,
       CAST(position AS DOUBLE) AS id, speed_val AS speed, 'say "' || position || '",' || chr(10) || '{[' || source AS note,
       CASE WHEN source NOT IN ('view', 'error') THEN CAST(position AS VARCHAR) END AS nested
FROM sensor_events"""
)
def split_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of many splits to events, each with its place in its file; quoted line breaks and brackets lie across the splits."""
    events = events_of(read_parsed(spark, _large_files(spark, folder), SPLIT))
    value = lambda name: F.try_element_at("payload", F.lit(name))
    return events.select(
        F.col("sensor_id").alias("sensor"),
        F.col("position").alias("event_no"),
        text_to_number(value("id")).alias("id"),
        text_to_number(value("speed")).alias("speed"),
        value("note").alias("note"),
        value("a.b.c").alias("nested"),
    )


@query(
    with_sql(SQL_SENSOR_EVENTS)
    + """
, names AS (SELECT 'source=' || source AS folder, unnest(['_hidden', '.hidden', 'empty', 'a=b']) AS name, source FROM (SELECT DISTINCT source FROM sensor_events))
SELECT folder, name, CAST(CASE WHEN name = 'empty' THEN 0 ELSE strlen(source || name) END AS BIGINT) AS size_bytes,
       md5(CASE WHEN name = 'empty' THEN '' ELSE source || name END) AS file_hash
FROM names"""
)
def landed_names(spark: SparkSession, folder: str) -> DataFrame:
    """Files of all names and sizes as they are listed and landed: hidden and empty ones too."""
    kinds = sensor_events(spark, folder).select("source").distinct()
    target = new_path(spark, "odd-names")
    texts = {name: F.concat("source", F.lit(name)) for name in ("_hidden", ".hidden", "a=b")} | {"empty": F.lit("")}
    rows = kinds.select("source", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), t.alias("value")) for n, t in texts.items()])).alias("x"))
    path = F.concat(F.lit(f"{target}/source="), "source", F.lit("/"), "x.name")
    write_files(rows.select(path.alias("path"), F.col("x.value").cast("binary").alias("content")))
    folders = [f"{target}/source={row.source}" for row in kinds.collect()]
    chunks = landing_chunks(write_and_read(list_all_files(spark, folders), "listing"))
    landed = files.folder_listing(chunks.withColumnRenamed("file_path", "path"))
    return landed.select(files.base_name(F.col("folder")).alias("folder"), "name", F.col("file_size_bytes").alias("size_bytes"), "file_hash")
