"""As-of attributes against brute force and in every defined case."""

import random

from pyspark.sql import functions as F

from tidewright.operators.point_in_time import enclosing_node, interval_nodes, match_as_of, with_attributes_as_of

E = "event_id long, k string, t long"
A = "k string, s long, e long, p long, value double"
HOW = dict(key="k", event_id="event_id", event_tick="t", start_tick="s", end_tick="e", precedence=("p",), values=("value",))


def brute(events, attributes):
    out = {}
    for i, k, t in events:
        ok = [(p, v) for ak, s, e, p, v in attributes
              if i is not None and k is not None and t is not None and ak == k and s is not None and s <= t and (e is None or t < e)]
        if ok:
            out[i] = max(ok, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    return out


def test_nodes_cover_exactly(spark):
    top = F.lit(6)
    rows = [(s, e) for s in range(0, 65, 7) for e in [*range(s, 65, 11), 64]]
    df = spark.createDataFrame(rows, "s long, e long").select("s", "e", interval_nodes(F.col("s"), F.col("e"), top).alias("n"))
    every = F.array(*[enclosing_node(F.col("id"), top, F.lit(level)) for level in range(7)])
    points = {r.t: set(r.n) for r in spark.range(64).select(F.col("id").alias("t"), every.alias("n")).collect()}
    for r in df.collect():
        assert len(set(r.n)) == len(r.n) <= 16 + 2 * 2
        for t, own in points.items():
            assert len(own & set(r.n)) == int(r.s <= t < r.e)


def test_random_against_brute_force(spark):
    rng = random.Random(4)
    keys = ["a", "b", "c", None]
    events = [(i, rng.choice(keys), rng.choice([None, *range(0, 3000, 17)])) for i in range(600)]
    attributes = [(rng.choice(keys), (s := rng.choice([None, *range(-50, 3000)])), None if rng.random() < 0.4 or s is None else s + rng.randrange(-3, 400),
                   rng.choice([None, *range(5)]), float(i)) for i in range(400)]
    got = match_as_of(spark.createDataFrame(events, E), spark.createDataFrame(attributes, A), **HOW, share=0.004)
    assert {r.event_id: (r.p, r.value) for r in got.collect()} == brute(events, attributes)


def test_repeated_rows_ties_and_half_open_ends(spark):
    events = [(1, "a", 5), (1, "a", 5), (2, "a", 9), (None, "a", 5)]
    attributes = [("a", 5, 9, 1, 1.0), ("a", 5, 9, 1, 1.0), ("a", 5, 9, 1, 2.0), ("a", 7, 7, 9, 9.0), ("a", 8, 3, 9, 9.0)]
    got = match_as_of(spark.createDataFrame(events, E), spark.createDataFrame(attributes, A), **HOW).collect()
    assert [(r.event_id, r.p, r.value) for r in got] == [(1, 1, 2.0)]


def test_empty_tables_and_clashing_names(spark):
    none_e, none_a = spark.createDataFrame([], E), spark.createDataFrame([], A)
    one_e, one_a = spark.createDataFrame([(1, "a", 5)], E), spark.createDataFrame([("a", 0, None, 1, 1.5)], A)
    for e, a in ((none_e, one_a), (one_e, none_a), (none_e, none_a)):
        assert match_as_of(e, a, **HOW).count() == 0
    clash = one_e.withColumns({"value": F.lit("own"), "p": F.lit("own"), "_node": F.lit(1)})
    row = with_attributes_as_of(clash, one_a, **HOW).first()
    assert (row.value, row.p, row.asof_value, row.asof_p) == ("own", "own", 1.5, 1)
    assert with_attributes_as_of(clash, none_a, **HOW).first().asof_value is None


def test_microseconds_over_ten_years(spark):
    year, minute = 365 * 86_400_000_000, 60_000_000
    rng = random.Random(9)
    events = [(i, "a", rng.randrange(10 * year)) for i in range(300)] + [(1000, "a", 0), (1001, "a", 10 * year)]
    attributes = [("a", (s := rng.randrange(-year, 10 * year)), None if i % 3 else s + rng.randrange(10 * minute, year), i % 7, float(i)) for i in range(60)]
    attributes += [("a", t - 5 * minute, t + 5 * minute, 50, float(i)) for i, (_, _, t) in enumerate(events[:20])]
    attributes += [("a", -(1 << 63), None, 0, 0.5), ("a", (1 << 63) - 1, None, 99, 0.5), ("a", 5, -(1 << 63), 99, 0.5), ("a", -9, (1 << 63) - 1, 1, 0.5)]
    got = match_as_of(spark.createDataFrame(events, E), spark.createDataFrame(attributes, A), **HOW)
    assert {r.event_id: (r.p, r.value) for r in got.collect()} == brute(events, attributes)


def test_one_crowded_tick_is_dealt_over_copies(spark):
    events = spark.range(5000).select(F.col("id").alias("event_id"), F.lit("a").alias("k"), F.lit(7).cast("long").alias("t"))
    attributes = spark.createDataFrame([("a", 7, 8, 1, 1.5), ("a", 0, None, 0, 2.5)], A)
    got = match_as_of(events, attributes, **HOW, share=0.1)
    assert got.count() == 5000 and got.where("value = 1.5").count() == 5000
    plan = match_as_of(events, attributes, **HOW)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_too_wide_a_range_of_ticks_fails(spark):
    events = spark.createDataFrame([(1, "a", -(1 << 62)), (2, "a", (1 << 61))], E)
    try:
        match_as_of(events, spark.createDataFrame([("a", 0, None, 1, 1.5)], A), **HOW).collect()
    except Exception as e:  # noqa: BLE001
        assert "span more than" in str(e)
    else:
        raise AssertionError("no failure")
