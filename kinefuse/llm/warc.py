"""WARC archives: written by Spark's text sink, read by a Python data source.

An archive is plain WARC/1.1. Of records with equal payloads one holds the payload and the others
refer to it. The data source plans partitions of whole files, takes conditions on record type and
headers from Spark, parses a record's headers first, and steps over the blocks of records that the
conditions exclude, or of all records if payloads are not wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from kinefuse.llm.queries import llm_query, table
from kinefuse.llm.shipping import ship
from kinefuse.storage import new_path, write_and_read

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Small files are read together in partitions of about this many bytes.
PARTITION_BYTES = 64 << 20
#: Payload bytes from which equal payloads are stored once.
LEAST_BYTES = 0
_BATCH_BYTES = 8 << 20


def base32_digest(hex_digest: Column) -> Column:
    """The 40 hexadecimal digits of a SHA-1 as 32 upper-case base32 characters: ten digits make eight characters."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, k * 10 + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(value: Column) -> Column:
    """A value that cannot end its header line."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in pairs))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Writes a record for every row of pages (page_id, url, html).

    Of rows with equal payloads of at least least_bytes bytes, those with the largest page_id are responses, the
    others revisit them; a null id is less than any other. A null html is an empty payload, a null url leaves its header out.
    Only page ids and digests of repeated payloads are joined; html moves only if these are too many to broadcast.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("_bytes", F.octet_length("html").cast("long")).withColumn("_digest", base32_digest(F.sha1("html")))
    counted = rows.where(F.col("_bytes") >= least_bytes).groupBy("_digest").agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n"))
    repeated = write_and_read(counted.where("_n > 1").drop("_n"), "repeated-payloads")
    rows = rows.join(repeated, "_digest", "left")
    revisit = F.col("_keeper").isNotNull() & (F.col("_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("_bytes"))
    head = _lines(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", _id(F.col("page_id"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", _header(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, _id(F.col("_keeper")))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", block.cast("string")),
    )
    record = F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, http_length long, payload binary"
_HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
_ARROW = pa.schema([*((name, pa.string()) for name in _HEADERS), ("http_length", pa.int64()), ("payload", pa.binary())])


class WarcSource(DataSource):
    """Options: path; payload ("false" steps over all blocks and gives null payloads)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.conditions: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for one in filters:
            name = one.attribute[0] if len(one.attribute) == 1 else None
            if name in _HEADERS and isinstance(one, EqualTo):
                self.conditions.append((name, "in", (one.value,)))
            elif name in _HEADERS and isinstance(one, In):
                self.conditions.append((name, "in", tuple(one.value)))
            elif name in _HEADERS and isinstance(one, StringStartsWith):
                self.conditions.append((name, "starts", one.value))
            elif name in _HEADERS and isinstance(one, IsNotNull):
                self.conditions.append((name, "given", None))
            else:
                yield one

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
        packs, size = [], 0
        for one in files:
            if not packs or size + one.size > PARTITION_BYTES:
                packs.append([])
                size = 0
            packs[-1].append(one.path)
            size += one.size
        return [Files(x) for x in packs] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as stream:
                for row in self._records(stream):
                    rows.append(row)
                    size += 300 + len(row["payload"] or b"")
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _records(self, stream) -> Iterator[dict]:
        text = _Window(stream)
        while (line := text.line()) is not None:
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins at byte {text.at}")
            headers = _fields(text)
            length = int(headers["content-length"])
            values = {name: headers.get(header) for name, header in _HEADERS.items()}
            wanted = all(_holds(values[name], kind, value) for name, kind, value in self.conditions)
            if not wanted or not self.payload:
                text.skip(length)
                if wanted:
                    yield values | {"http_length": None, "payload": None}
                continue
            start = text.at
            text.line()
            http = _fields(text)
            rest = length - (text.at - start)
            payload = text.take(rest)
            stored = values["record_type"] != "revisit"
            yield values | {"http_length": int(http["content-length"]) if "content-length" in http else None, "payload": payload if stored else None}


def _holds(value: str | None, kind: str, wanted) -> bool:
    if value is None:
        return False
    return value in wanted if kind == "in" else kind == "given" or value.startswith(wanted)


def _fields(text: "_Window") -> dict[str, str]:
    """Header lines up to an empty one, by lower-case name."""
    found = {}
    while line := text.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


class _Window:
    """A file read forward through a buffer; what is skipped beyond the buffer is not read."""

    def __init__(self, stream, step: int = 1 << 20):
        self.stream, self.step, self.size = stream, step, stream.size()
        self.at, self.held, self.begin = 0, b"", 0

    def _fill(self, least: int) -> None:
        """Hold at least this many bytes from `at` on, or all that are left."""
        if self.begin + len(self.held) - self.at < least:
            self.stream.seek(self.at)
            self.held, self.begin = self.stream.read(max(least, self.step)), self.at

    def line(self) -> bytes | None:
        if self.at >= self.size:
            return None
        least = 4096
        while True:
            self._fill(least)
            start = self.at - self.begin
            stop = self.held.find(b"\n", start)
            if stop >= 0 or self.begin + len(self.held) >= self.size:
                break
            least *= 4
        stop = len(self.held) if stop < 0 else stop + 1
        self.at = self.begin + stop
        return self.held[start:stop].rstrip(b"\r\n")

    def take(self, count: int) -> bytes:
        self._fill(count)
        start = self.at - self.begin
        self.at += count
        return self.held[start : start + count]

    def skip(self, count: int) -> None:
        self.at += count


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under a path; conditions on the header columns are pushed down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


ORACLE = """
WITH b AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
    SELECT page_id, strlen(html) AS payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS keeper FROM b
), c AS (
    SELECT page_id, payload_bytes, keeper, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST(('0x' || substr(hex, CAST(k // 4 AS INTEGER) * 5 + 1, 5)) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM c
"""


@llm_query(ORACLE)
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A record of every page, written and read back."""
    path = new_path(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    records = read_archives(spark, path)
    number = lambda name: F.regexp_extract(name, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha1:", "")).otherwise(base32_digest(F.sha1("payload"))).alias("payload_digest"),
        "record_type",
        F.when(revisit, number("refers_to")).alias("refers_to"),
    )
