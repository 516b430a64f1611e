from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.functions.text import squeeze
from tidewright.operators.heavy_keys import heavy_keys, most_repeated_value

S = "id long, k string, v string"


def test_hot_and_cold_keys_against_brute_force(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 40}", f"v{(i * i) % 7}") for i in range(3000)]
    rows += rows[:500] + [(9001, None, "v"), (9002, "n", None), (None, "n", "v")]
    counts = Counter((k, v) for _, k, v in {r for r in rows if None not in r})
    want = {}
    for (k, v), n in counts.items():
        if k not in want or (-n, v.encode()) < (-want[k][1], want[k][0].encode()):
            want[k] = (v, n)
    df = spark.createDataFrame(rows, S).repartition(5)
    for share in (0.002, 0.1, 0.9):
        assert {r.k: (r.v, r.n) for r in most_repeated_value(df, "k", "v", "id", share).collect()} == want
    assert [(r.k, r.n) for r in heavy_keys(df, "k", 0.3).collect()] == [("hot", sum(r[1] == "hot" for r in rows))]


def test_ties_in_byte_order_long_and_blank_values(spark):
    long = "x" * 100_000
    rows = [(1, "a", "é"), (2, "a", "z"), (3, "b", " \t"), (4, "c", f"  p \n q　{long} "), (5, "d", "\U0001f600"), (6, "d", "￿")]
    df = spark.createDataFrame(rows, S).withColumn("_v", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r.k: r.value for r in most_repeated_value(df, "k", squeeze(F.col("v")), "id").collect()}
    assert got == {"a": "z", "c": f"p q {long}", "d": "￿"}


def test_empty_table(spark):
    df = spark.createDataFrame([], S)
    assert most_repeated_value(df, "k", "v", "id").count() == 0 and heavy_keys(df, "k").count() == 0


def test_a_share_too_small_for_the_sketch_raises(spark):
    df = spark.createDataFrame([(1, "a", "v")], S)
    with pytest.raises(ValueError):
        heavy_keys(df, "k", 1e-6)
    assert heavy_keys(df, "k", 1e-4).count() == 1


def test_the_default_share_follows_the_partitions(spark):
    rows = spark.createDataFrame([(i, "x" if i % 10 == 0 else f"k{i}", "v") for i in range(2000)], S)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert heavy_keys(rows, "k").count() == 0
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        assert [(r.k, r.n) for r in heavy_keys(rows, "k").collect()] == [("x", 200)]
        spark.conf.set("spark.sql.shuffle.partitions", 5_000_000)
        assert heavy_keys(rows, "k").schema.names == ["k", "n"]  # a plan is made for any number of partitions
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
