import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewright.operators.trailing import each_day, latest_version, trailing_runs


def test_every_day_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), 100 + rng.randrange(60), rng.choice([None, float("nan"), float("inf"), 0.0, 0.1, -0.3, 1e-7, 12345.678])) for _ in range(80)]
    df = spark.createDataFrame(rows, "k string, d long, x double").withColumn("total", F.lit("clash"))
    got = {(r.k, r.span_days, r.on_day): (r.total, r.n) for r in each_day(trailing_runs(df, "k", "d", {7: "x", 30: "x"})).collect()}
    want = {}
    for k in "ab":
        for span in (7, 30):
            for day in range(90, 220):
                own = [x for kk, d, x in rows if kk == k and day - span < d <= day and x is not None and x == x and abs(x) < 1e300]
                if own:
                    want[k, span, str(date.fromordinal(date(1970, 1, 1).toordinal() + day))] = (sum(own), len(own))
    assert got.keys() == want.keys()
    for key, (total, n) in want.items():
        assert abs(got[key][0] - total) < 1e-9 and got[key][1] == n


def test_cancelled_amounts_leave_exact_zero(spark):
    rows = [("a", d, x) for d, x in ((1, 0.1), (2, 0.2), (3, -0.3), (400, 5.0))]
    runs = trailing_runs(spark.createDataFrame(rows, "k string, d long, x double"), "k", "d", {7: "x"})
    assert [(r.from_day, r.to_day, r.total, r.n) for r in runs.orderBy("from_day").collect()] == [
        (1, 2, 0.1, 1), (2, 3, 0.3, 2), (3, 8, 0.0, 3), (8, 9, -0.1, 2), (9, 10, -0.3, 1), (400, 407, 5.0, 1)]


@pytest.mark.parametrize("kind", ["double", "decimal(38,2)"])
def test_amounts_out_of_range_fail_and_are_not_dropped(spark, kind):
    def runs(*amounts):
        df = spark.createDataFrame([("a", d, x) for d, x in enumerate(amounts)], "k string, d long, x double")
        return trailing_runs(df.withColumn("x", F.col("x").try_cast(kind)), "k", "d", {7: "x"})

    for large in (9e13, 1e14, -1e14, 1e20, 9e22):
        assert [(r.total, r.n) for r in runs(5.0, large, None).where("from_day = 1").collect()] == [(5.0 + large, 2)]
    for bad in (2e23, -3e25):
        with pytest.raises(Exception, match="1e23 or more in column x"):
            runs(1.0, bad).collect()


def test_small_amounts_stay(spark):
    df = spark.createDataFrame([("a", 0, 1e-13), ("a", 1, -5e-14)], "k string, d long, x double")
    totals = [r.total for r in trailing_runs(df, "k", "d", {7: "x"}).orderBy("from_day").collect()]
    assert totals == [1e-13, 5e-14, -5e-14]


def test_latest_version_nulls_ties_and_empty(spark):
    schema = "k string, at long, id long, v double"
    df = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 1, 2, None), ("a", None, 9, 5.0), ("b", None, 1, 3.0), (None, 1, 1, 7.0)], schema)
    got = {r.k: r.v for r in latest_version(df, ["k"], ["at", "id"], ["v"]).collect()}
    assert got == {"a": None, "b": 3.0, None: 7.0}
    empty = spark.createDataFrame([], schema)
    assert latest_version(empty, ["k"], ["at"], ["v"]).count() == 0
    assert trailing_runs(empty, "k", "at", {7: "v"}).count() == 0
    assert trailing_runs(df, "k", "at", {7: "v"}).where("k is null").count() == 0
