"""Cells of digits alone take a short way, with the same result as the long one."""

from pyspark.sql import functions as F

from brindle.functions import numbers


def test_short_way(spark):
    cells = ["0", "12.50", "1" * 28, "1" * 29, "1.1234567890", "1.12345678901", "12\n", " 12 ", "1.", ".5", "-3", "1e3", "", None, "x", "٣"]
    c = F.col("c")
    rows = spark.createDataFrame([(x,) for x in cells], "c string").select("c", numbers.number_error(c).alias("e"), numbers.decimal(c).alias("d"), numbers._error(c).alias("e2"), F.regexp_replace(c, r"\s", "").try_cast(numbers.DECIMAL).alias("d2")).collect()
    assert all(r.e == r.e2 and r.d == (r.d2 if r.e is None else None) for r in rows) and sum(r.e is None for r in rows) == 10
    assert numbers.DIGITS in spark.range(1).select(numbers.decimal(F.lit("1"))).columns[0]
