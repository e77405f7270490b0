import pytest
from pyspark.sql import functions as F

from sievemark.functions.days import named_day

CASES = {
    "2026-02-03": "2026-02-03", "20260203": "2026-02-03", "2026/02/03": "2026-02-03", "2026-02-03T00:00:00Z": "2026-02-03", "03.02.2026": "2026-02-03", "3.2.2026": "2026-02-03",
    "3 Feb 2026": "2026-02-03", "Feb 3, 2026": "2026-02-03", "February 3, 2026": "2026-02-03", " 2026-02-03 ": "2026-02-03", "day:2026-02-03": "2026-02-03", "2026-034": "2026-02-03",
    "2026-W06-2": "2026-02-03", "2026-02-03..2026-02-03": "2026-02-03", "3 Feb. 2026 (final)": "2026-02-03", "03-Feb-2026": "2026-02-03",
    "2026-02": None, "2026-W11": None, "2026-02-03..2026-02-09": None, "last 28 days": None, "previous": None, "": None, None: None, "2026-02-30": None, "2026-366": None, "2-8 Feb 2026": None, "yoy": None,
}


def test_named_day(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "t string")
    got = {r.t: r.d for r in df.select("t", F.date_format(named_day(F.col("t")), "yyyy-MM-dd").alias("d")).collect()}
    assert {k: v for k, v in got.items() if v != CASES[k]} == {}


@pytest.mark.parametrize("n", [100_000])
def test_very_long_text(spark, n):
    df = spark.createDataFrame([("x" * n + " 2026-02-03 ",)], "t string")
    assert str(df.select(named_day(F.col("t"))).first()[0]) == "2026-02-03"
