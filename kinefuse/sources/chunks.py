"""Listings and contents of files in bounded chunks, by workers that read the file systems themselves.

Spark's own file sources hide names that start with `_` or `.` and files without rows, and hold a file
of the whole-file kinds in one value of at most 2 GB. Here a folder is listed whole by one task, and a
file is as many rows as it has chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.shipping import ship

#: Bytes of a chunk.
CHUNK_BYTES = 2 << 20
# File endings that are decompressed when read, and how much larger a text may become.
PACKED_ENDINGS = (".gz", ".bz2", ".zst", ".lz4")
PACKED_RATIO = 16

LISTING = "path string, modificationTime timestamp, length long"
CHUNKS = "file_path string, chunk long, content binary"


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it of an address; a plain path is local."""
    path = re.sub(r"\As3[an]:", "s3:", path)
    if re.match(r"\A[a-z][a-z0-9+.-]*:/", path):
        return pafs.FileSystem.from_uri(re.sub(r"\Afile:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def _address(folder: str, inner: str) -> str:
    """Path as listed, in the spelling of the folder it was found below."""
    scheme = re.match(r"\A([a-z][a-z0-9+.-]*):/", folder)
    if not scheme or scheme[1] == "file":
        return inner
    return f"{scheme[1]}://{inner.lstrip('/')}" if scheme[1].startswith("s3") else re.match(r"\A[^:]+://[^/]*", folder)[0] + inner


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            system, top = open_path(folder)
            found = [x for x in system.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True)) if x.type == pafs.FileType.File]
            names = {x.path for x in found}
            # A local checksum file that Hadoop keeps beside each file it writes is not one of the user's.
            kept = [x for x in found if not (x.base_name.endswith(".crc") and x.base_name.startswith(".") and x.path[: -len(x.base_name)] + x.base_name[1:-4] in names)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_address(folder, x.path) for x in kept], pa.string()),
                    pa.array([x.mtime_ns // 1_000_000 * 1000 for x in kept], pa.timestamp("us", "UTC")),
                    pa.array([x.size for x in kept], pa.int64()),
                ],
                ["path", "modificationTime", "length"],
            )


def list_all_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One row per file below the folders, hidden and empty ones included; one task lists one folder.

    A folder that is not there has no files. Times are in whole milliseconds, as Spark gives them. Hadoop's own checksum files are left out. A file below two of the folders is listed twice.
    """
    if not folders:
        return spark.createDataFrame([], LISTING)
    ship(spark)
    rows = spark.createDataFrame([(f.rstrip("/") or "/",) for f in folders], "folder string").repartition(len(folders))
    return rows.mapInArrow(_listed, LISTING)


def is_packed(path: Column) -> Column:
    lower = F.lower(path)
    test = F.endswith(lower, F.lit(PACKED_ENDINGS[0]))
    for ending in PACKED_ENDINGS[1:]:
        test = test | F.endswith(lower, F.lit(ending))
    return test


def _chunks(chunk_bytes: int, unpack: bool, carried: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (path, chunk) in enumerate(zip(batch.column("path").to_pylist(), batch.column("chunk").to_pylist(), strict=True)):

                def row(number: int, content: bytes) -> pa.RecordBatch:
                    own = [pa.array([path]), pa.array([number]), pa.array([content], pa.binary())]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*own, *(batch.column(n).slice(k, 1) for n in carried)], ["file_path", "chunk", "content", *carried])  # noqa: B023

                system, inner = open_path(path)
                if chunk < 0:
                    with system.open_input_stream(inner, compression="detect" if unpack else None) as stream:
                        number = 0
                        while content := stream.read(chunk_bytes):
                            yield row(number, content)
                            number += 1
                else:
                    with system.open_input_file(inner) as file:
                        yield row(chunk, file.read_at(chunk_bytes, chunk * chunk_bytes))

    return read


def _numbered(chunk_bytes: int) -> Column:
    last = F.greatest(F.ceil(F.col("length") / chunk_bytes) - 1, F.lit(0)).cast("long")
    return F.sequence(F.lit(0).cast("long"), last)


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out to as many tasks as a shuffle has. Without the number Spark would count the rows' bytes, not what is read for them, and give all to one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def read_chunks(listing: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Listed files as chunks numbered from 0. Packed files are unpacked as a stream by one task each; an empty file has no chunk."""
    ship(listing.sparkSession)
    numbers = F.when(is_packed(F.col("path")), F.array(F.lit(-1).cast("long"))).otherwise(_numbered(chunk_bytes))
    wanted = listing.where("length > 0").select("path", F.explode(numbers).alias("chunk"))
    return _spread(wanted, "path", "chunk").mapInArrow(_chunks(chunk_bytes, True, []), CHUNKS)


def _digests(chunk_bytes: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = open_path(path)
                digest = hashlib.md5(usedforsecurity=False)
                with system.open_input_stream(inner, compression=None) as stream:
                    while content := stream.read(chunk_bytes):
                        digest.update(content)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], ["path", "file_hash"])

    return read


def landing_chunks(listing: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Listed files as they are, packed ones too, in chunks: file_path, chunk, content, file_hash (MD5 of the whole file), file_size_bytes.

    An empty file is one empty chunk. MD5 needs a file's bytes in order, so one task streams a file for it,
    a chunk at a time; the chunks themselves are read by as many tasks as there are. No task holds more than a chunk.
    """
    ship(listing.sparkSession)
    digests = _spread(listing.select("path"), "path").mapInArrow(_digests(chunk_bytes), "path string, file_hash string")
    known = listing.select("path", F.col("length").alias("file_size_bytes"), _numbered(chunk_bytes).alias("numbers")).join(digests, "path")
    wanted = _spread(known.select("path", "file_hash", "file_size_bytes", F.explode("numbers").alias("chunk")), "path", "chunk")
    carried = ["file_hash", "file_size_bytes"]
    return wanted.mapInArrow(_chunks(chunk_bytes, False, carried), f"{CHUNKS}, file_hash string, file_size_bytes long")


def write_files(files: DataFrame) -> None:
    """Writes each content (binary) to its path."""
    ship(files.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task that is repeated writes the same files again.
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                system, inner = open_path(path)
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                with system.open_output_stream(inner, compression=None) as stream:
                    stream.write(content)
            yield batch.select(["path"])

    files.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
