"""Datasets are replaced whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from kinefuse.operators.roles import available_columns
from kinefuse.sinks import replace


def values(spark, path):
    return sorted(r[0] for r in spark.read.parquet(path).collect())


def test_replace(spark, tmp_path):
    path = str(tmp_path / "table")
    replace.replace_table(spark.range(3), path)
    replace.replace_table(spark.read.parquet(path).where("id > 0"), path + "/")
    assert values(spark, path) == [1, 2] and os.listdir(tmp_path) == ["table"]


def test_a_job_that_fails_leaves_the_old_dataset(spark, tmp_path):
    path = str(tmp_path / "table")
    replace.replace_table(spark.range(3), path)
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        replace.replace_table(broken, path)
    assert values(spark, path) == [0, 1, 2] and os.listdir(tmp_path) == ["table"]


def test_a_job_that_ends_between_the_renames(spark, tmp_path):
    path = str(tmp_path / "table")
    replace.replace_table(spark.range(3), path)
    os.rename(path, str(tmp_path / ".table.old-x"))
    spark.range(5).write.parquet(str(tmp_path / ".table.new-x"))
    assert replace.recover(spark, path) and not replace.recover(spark, path)
    assert values(spark, path) == [0, 1, 2]
    os.rename(path, str(tmp_path / ".table.old-y"))
    replace.replace_table(spark.range(1), path)
    assert values(spark, path) == [0] and sorted(os.listdir(tmp_path)) == [".table.new-x", "table"]


def test_available_columns(spark):
    texts = {
        '[{"b":1,"a":{"c":[{"d":2}]}},{"e":3}]': "a, a.c, a.c.d, b, e",
        '{"x":null}': "x",
        "12": "",
        " speed,flow \r\n1,2": "speed,flow",
        '{"a":1}\n{"b":2}, x': None,
        "prose\nwith, comma": None,
        "": None,
        '{"a":1,}\n2': '{"a":1,}',
    }
    rows = spark.createDataFrame([(k,) for k in [*texts, None]], "text string").withColumn("listed", available_columns(F.col("text"))).collect()
    assert {r.text: r.listed for r in rows} == texts | {None: None}
