"""Session set-up and tables written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on: UTC times and adaptive execution."""
    builder = SparkSession.builder.appName("kinefuse")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Temporary folders of local sessions, by application.
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach. A local master may use a temporary folder; a cluster must name one."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="kinefuse-")
    return _local_dirs[context.applicationId]


# Folders of the runs under way, innermost last.
_runs: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    folder = _runs[-1] if _runs else f"{shared_dir(spark)}/kinefuse"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """One folder for all intermediate tables of a run, removed at its end. Results must be written by then."""
    folder = f"{shared_dir(spark)}/kinefuse/run-{uuid.uuid4().hex}"
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: For rows of some MB: Parquet looks at their size after each row and closes a row group early, as a reader holds a group whole.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "10"}


def write_and_read(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This ends the lineage in files that outlive any executor, and gives Spark the table's real
    size, so that a later join broadcasts it when it is under the broadcast threshold and
    shuffles it when it is not.
    """
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
