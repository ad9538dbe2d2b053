"""Sensor folders as DataFrames: listing, file types, registration, text content."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefuse.functions.text import base_name, file_extension, known_association, lenient_utf8
from kinefuse.sources.chunks import PACKED_RATIO, is_packed, list_all_files
from kinefuse.storage import write_and_read

# File endings and the type they stand for; road networks are not sensor data.
NETWORK_ENDINGS = (".net.xml", ".net.xml.gz")
TYPE_ENDINGS = {
    "CSV": (".csv", ".csv.gz"),
    "JSON": (".json", ".json.gz"),
    "XML": (".xml", ".xml.gz"),
    "Excel": (".xls", ".xlsx"),
}
PARSED_TYPES = ("CSV", "JSON")

_LISTING = "path string, modificationTime timestamp, length long"
_WHOLE = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("text", T.StringType()),
    ]
)

def plain_path(path: Column) -> Column:
    """Path without the `file:` scheme and without trailing slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"\Afile:/+", "/"), r"(?<=.)/+\z", "")


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def load_existing(reader: DataFrameReader, spark: SparkSession, folders: list[str]) -> DataFrame | None:
    """Load the folders that exist; None when there is none. A missing folder contributes no files."""
    try:
        return reader.load(folders) if folders else None
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def exists(folder: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(conf).exists(path)

    found = [folder for folder in folders if exists(folder)]
    return reader.load(found) if found else None


def list_files(spark: SparkSession, folders: list[str], recursive: bool = True) -> DataFrame:
    """One row per file below the folders: path, modification time, size. No content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    loaded = load_existing(reader, spark, folders)
    if loaded is None:
        return spark.createDataFrame([], _LISTING)
    files = loaded.select(plain_path(F.col("path")).alias("path"), "modificationTime", "length")
    if recursive:
        return files
    # Without the recursive lookup, subfolders named key=value would be taken for partitions.
    return files.filter(parent_folder(F.col("path")).isin(*[plain_path(F.lit(f)) for f in folders]))


def file_type(name: Column) -> Column:
    """Type of a file by its name, null when it is not supported."""
    lower = F.lower(name)

    def has(endings: Iterable[str]) -> Column:
        test = F.lit(False)
        for ending in endings:
            test = test | F.endswith(lower, F.lit(ending))
        return test

    chosen = F.when(has(NETWORK_ENDINGS), F.lit(None).cast("string"))
    for kind, endings in TYPE_ENDINGS.items():
        chosen = chosen.when(has(endings), F.lit(kind))
    return chosen


def file_types(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """Supported types per folder, as a sorted set; a folder without any has an empty set."""
    return files.groupBy(folder).agg(
        F.array_sort(F.collect_set(file_type(F.col(name)))).alias("file_types")
    )


def folder_listing(files: DataFrame) -> DataFrame:
    """Split the path of a listing into folder and name."""
    path = F.col("path")
    return files.withColumns({"folder": parent_folder(path), "name": base_name(path)})


def file_inventory(files: DataFrame) -> DataFrame:
    """Listing with name, extension, type, and whether the engine reads that type."""
    kind = file_type(F.col("name"))
    return folder_listing(files).select(
        "path",
        "folder",
        "name",
        file_extension(F.col("name")).alias("extension"),
        F.col("length").alias("size_bytes"),
        kind.alias("file_type"),
        F.coalesce(kind.isin(*PARSED_TYPES), F.lit(False)).alias("is_parsed"),
    )


def register_sources(folders: DataFrame) -> DataFrame:
    """Folders (folder, file_types, association_type) to data sources.

    A folder without any supported file is not registered. The identifier is derived from the
    path, so registering twice gives the same source.
    """
    return folders.filter(F.size("file_types") > 0).select(
        F.col("folder").alias("path"),
        base_name(F.col("folder")).alias("name"),
        F.concat(F.lit("src_"), F.left(F.md5(F.col("folder")), F.lit(8))).alias("id"),
        "file_types",
        F.lit(None).cast("string").alias("parser_id"),
        known_association(F.col("association_type")).alias("association_type"),
        F.lit(None).cast("string").alias("associated_element_id"),
    )


def ancestors(path: Column) -> Column:
    """All folders that a plain path lies below, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def with_owner(files: DataFrame, folders: list[str]) -> DataFrame:
    """Add the folder a file belongs to and its name; a file below two of the folders is in both.

    A file looks up each folder above it, whose number is the depth of its path. The table of folders is
    written, so that Spark joins it where the files are as long as it is small.
    """
    spark = files.sparkSession
    rows = spark.createDataFrame([(f,) for f in dict.fromkeys(folders)], "folder string")
    roots = write_and_read(rows.select(plain_path(F.col("folder")).alias("source_path")).distinct(), "folders")
    above = files.withColumn("source_path", F.explode(ancestors(F.col("file_path"))))
    columns = [c for c in files.columns if c not in ("source_path", "source")]
    return above.join(roots, "source_path").select(*columns, "source_path", base_name(F.col("source_path")).alias("source"))


def read_text_files(
    spark: SparkSession, folders: list[str], paths: list[str] | None = None, most_bytes: int | None = None
) -> DataFrame:
    """One row per file below the folders, whatever its name and size; `.gz` is decompressed.

    `paths` narrows the reading to some files, `most_bytes` to those that are no larger once unpacked;
    Spark tells that from the listing.
    """
    reader = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
    texts = load_existing(reader, spark, folders if paths is None else paths)
    if texts is None:
        return spark.createDataFrame([], _WHOLE)
    if most_bytes is not None:
        path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
        texts = texts.where(F.when(is_packed(path), size * PACKED_RATIO).otherwise(size) <= most_bytes)
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    read = texts.select(
        plain_path(decoded).alias("file_path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        lenient_utf8(F.col("value")).alias("text"),
    )
    return with_owner(read, folders).select(*_WHOLE.names)


def sample_paths(spark: SparkSession, folders: list[str], listing: DataFrame | None = None) -> list[str]:
    """Lowest path below each folder, of a hidden file too; from the listing alone, one path per folder comes back."""
    files = list_all_files(spark, folders) if listing is None else listing
    listed = with_owner(files.select(plain_path(F.col("path")).alias("file_path")).distinct(), folders)
    first = listed.groupBy("source_path").agg(F.min("file_path").alias("file_path"))
    return [row.file_path for row in first.collect()]


def sample_file(files: DataFrame, source: str = "source", path: str = "file_path") -> DataFrame:
    """First file (lowest path) of each source, whole.

    Only paths are aggregated. Their table is written, so that the join back to the texts knows it
    is small and leaves the texts where they are.
    """
    first = write_and_read(files.groupBy(source).agg(F.min(path).alias(path)), "samples")
    return files.join(first, [source, path], "left_semi")
