import math

from pyspark.sql import functions as F

from tablescore.plans import report


def test_means_do_not_depend_on_the_order_of_rows(spark):
    """The mean is exactly 0.3678125; sums of doubles fall on both sides of it."""
    values = [0.01 * k for k in (7, 93, 71, 3, 19, 77, 45, 11)] * 4
    values = [round(x, 2) for x in values]
    values = [*values, *[0.37] * 31, 0.0]
    values[-1] = round(0.3678125 * 64 - math.fsum(values), 2)
    assert math.fsum(values) == 0.3678125 * 64
    for rows in (values, values[::-1], sorted(values), sorted(values, reverse=True)):
        df = spark.createDataFrame([("m", "ok", True, x, x) for x in rows], "model string, status string, success boolean, levenshtein double, teds double").coalesce(1)
        got = report.breakdown(df, ["model"]).select("levenshtein", F.round("teds", 6)).collect()
        assert [tuple(r) for r in got] == [(0.3678125, 0.367813)] * 2


def test_means_of_values_that_no_decimal_holds(spark):
    df = spark.createDataFrame([("a", 1e300), ("a", 3e300), ("b", float("nan")), ("b", 1.0), ("c", None), ("d", float("inf"))], "k string, x double")
    got = {r.k: r.m for r in df.groupBy("k").agg(report.exact_mean(F.col("x")).alias("m")).collect()}
    assert got["a"] == 2e300 and math.isnan(got["b"]) and got["c"] is None and got["d"] == math.inf
