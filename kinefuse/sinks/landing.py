"""Raw files as they came, with their fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinefuse.functions.text import base_name, file_extension
from kinefuse.storage import LARGE_ROWS


def raw_landing(files: DataFrame) -> DataFrame:
    """Files (source, file_path, content) to landing rows; the table's codec compresses the content."""
    hashed = files.withColumns({"file_hash": F.md5("content"), "file_size_bytes": F.octet_length("content").cast("long")})
    return landing_rows(hashed)


def landing_rows(files: DataFrame) -> DataFrame:
    """The same for content whose file's hash and size are known; a chunk of a file is a row with its number."""
    name = base_name(F.col("file_path"))
    return files.select(
        F.col("source").alias("source_id"),
        name.alias("filename"),
        file_extension(name).alias("file_extension"),
        F.current_timestamp().alias("import_timestamp"),
        "file_hash",
        "file_size_bytes",
        F.col("content").alias("raw_content"),
        *[c for c in ("chunk",) if c in files.columns],
    )


def write_raw_landing(files: DataFrame, path: str) -> None:
    """Append files, whole or in chunks, to the raw table."""
    rows = landing_rows(files) if "file_hash" in files.columns else raw_landing(files)
    rows.write.mode("append").options(**LARGE_ROWS).option("compression", "zstd").parquet(path)
