"""Datasets replaced as a whole.

Spark's overwrite deletes the old files before the new ones exist. Here the new dataset is written beside
the old one, and when it is complete the two change places by renaming. A job that ends while it writes
leaves the old dataset as it was; one that ends between the two renames leaves it beside its place, from
where the next write or `recover` brings it back. (In stores that rename by copying, the change takes as long
as a copy, with the same states in between.)
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_NEW, _OLD = ".new-", ".old-"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _beside(spark: SparkSession, target, mark: str):
    return spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}{mark}")


def _left(spark: SparkSession, files, target, mark: str) -> list:
    """What earlier jobs left beside the dataset, oldest first."""
    if not files.exists(target.getParent()):
        return []
    start = f".{target.getName()}{mark}"
    found = [x for x in files.listStatus(target.getParent()) if x.getPath().getName().startswith(start)]
    return [x.getPath() for x in sorted(found, key=lambda x: x.getModificationTime())]


def recover(spark: SparkSession, path: str) -> bool:
    """Puts the old dataset back if a job ended when neither it nor the new one was in place."""
    files, target = _files(spark, path)
    old = _left(spark, files, target, _OLD)
    if files.exists(target) or not old:
        return False
    return files.rename(old[-1], target)


def replace_table(df: DataFrame, path: str, **options: str) -> None:
    """Write Parquet in place of what is at the path, which may be read by `df` itself."""
    spark = df.sparkSession
    recover(spark, path)
    files, target = _files(spark, path)
    mark = uuid.uuid4().hex
    new, old = _beside(spark, target, _NEW + mark), _beside(spark, target, _OLD + mark)
    try:
        df.write.options(**options).parquet(new.toString())
        if files.exists(target) and not files.rename(target, old):
            raise OSError(f"{path} cannot be moved")
        if not files.rename(new, target):
            raise OSError(f"{path} cannot be put in place")
    except BaseException:
        files.delete(new, True)
        recover(spark, path)
        raise
    # Also what jobs before left when they ended at this point.
    for left in _left(spark, files, target, _OLD):
        files.delete(left, True)
