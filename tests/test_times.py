"""Times in any usual form, against pandas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinefuse.functions.times import mixed_time

FORMS = (
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%fZ", "%Y/%m/%d %H:%M", "%m/%d/%Y %I:%M %p", "%m/%d/%Y %I:%M:%S.%f %p", "%d %B %Y %H:%M:%S",
    "%b %d, %Y %I:%M %p", "%d-%b-%Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S +0100", "%a %b %d %H:%M:%S %Y", "%Y%m%d%H%M%S", "%Y%m%d", "%Y.%m.%d %H:%M",
    "%H:%M %Y-%m-%d", "%Y-%m-%d %H:%M:%S UTC", "%Y %b %d", "%A %d %B %Y", "%B %d, %Y", "%m/%d/%y", "%Y-%m", "%b %Y", "%Y", "%Y-%m-%d %H:%M:%S-0330", "%d/%m/%Y",
)


def read(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("t", F.unix_micros(mixed_time(F.col("text"))))
    return [r.t for r in rows.orderBy("k").collect()]


@pytest.mark.filterwarnings("ignore")
def test_forms_against_pandas(spark):
    rng = random.Random(5)
    texts = []
    for form in FORMS:
        for _ in range(20):
            # Which century a year of two digits is in depends on the day in pandas.
            when = pd.Timestamp(rng.randrange(1_000_000_000 if "%y" in form else 0, 2_000_000_000) * 1_000_000 + rng.randrange(1_000_000), unit="us")
            texts.append(when.strftime(form))
    texts += ["1/2/24", "13/02/2024", "01/02/2024", "31.01.2024 10:00", "1.2.2024", "2024-1-5", "March 5th, 2024", "31st of January 2024", "Sept 5 2024", "99/1/2", "24/01/31", "31/01/24"]
    texts += ["2024-13-01", "2024-01-31 24:00:00", "00/01/2024", "2/30/2024", "5 Sep", "1600000000", "never", "", "12:61 2024-01-01", "2024-01-31 10:00 PM", "2024-06-07 1:2:3", "x 2024-01-01"]
    want = [None if pd.isna(t := pd.to_datetime(pd.Series([x]), utc=True, format="mixed", errors="coerce")[0]) else t.value // 1000 for x in texts]
    for text, have, wanted in zip(texts, read(spark, texts), want, strict=True):
        assert have == wanted, text


def test_what_is_no_time(spark):
    assert read(spark, [None, "10:30", "now", "13:00 PM 2024-01-01", "2024-01-31 10:00:00 EST", "40/40/2024", "1/2/3/4"]) == [None] * 7
