"""Per-key results where a few keys hold most of the rows.

A frequent-items sketch over all rows (mergeable, of fixed size) names the keys that hold more than
their part of a partition.  Their number is bounded by the number of partitions, so the set is broadcast:
a broadcast join marks the heavy rows.  Then one shuffle moves every row once.  It deals the rows of heavy
keys over all tasks by value and row id, those of other keys by key alone.  Behind it both kinds go their
own way: other keys are finished where they are; heavy keys have been counted in parts, which are summed by
aggregations that combine before their shuffle.  The two results are united.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewright.runtime import partitions, require_columns

#: The sketch holds so many items for each key that may be heavy, and at least so many: a count is off by at
#: most rows * 3.5 / items.
ROOM, LEAST_ITEMS, MOST_ITEMS = 16, 8192, 1 << 20


def fair_share(spark: SparkSession) -> float:
    """Half of a partition's part of the rows; no less than the largest sketch can tell (that of 65,536 partitions)."""
    return max(0.5 / partitions(spark), 8 / MOST_ITEMS)


def frequent(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold at least about ``share`` of the rows whose key isn't null: (key, n, part of the rows).

    At most ``1 / share`` rows and those the sketch holds for as heavy, so safe to broadcast.  Counts are estimates.
    """
    most = math.ceil(1 / share)
    items = min(MOST_ITEMS, max(LEAST_ITEMS, 1 << (ROOM * most - 1).bit_length()))
    if most * 4 > items:
        raise ValueError(f"a share of {share} is too small for a sketch of {items} items")
    sketch = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {most}, {items})").alias("top"), F.count(F.lit(1)).alias("rows"))
    return sketch.select("rows", F.explode("top").alias("t")).where(F.col("t.count") >= F.col("rows") * share).select(
        F.col("t.item").alias(key), F.col("t.count").alias("n"), F.try_divide("t.count", "rows").alias("part"))


def heavy_keys(df: DataFrame, key: str, share: float | None = None) -> DataFrame:
    """Keys that hold at least about ``share`` of the rows, with the estimated count: (key, n).

    The default share is half of a partition's part, so it falls as partitions grow in number, and with it grows
    the sketch; a share too small for the largest sketch raises ValueError, as heavy keys would be missed.  At most
    ``1 / share`` rows.  Null keys don't count; an empty table has no heavy key.
    """
    require_columns(df, key)
    return frequent(df, key, share or fair_share(df.sparkSession)).drop("part")


def _only(df: DataFrame, column: str, kept: Column) -> DataFrame:
    """The rows of which ``kept`` holds, by a generator: a filter would be pushed below the shuffle, which then
    would run once for each side of the union."""
    nothing = F.array().cast(f"array<{dict(df.dtypes)[column]}>")
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.when(kept, F.array(column)).otherwise(nothing)).alias(column))


def most_repeated_value(df: DataFrame, key: str, value: str | Column, row_id: str, share: float | None = None) -> DataFrame:
    """The value with the most distinct row ids for every key: (key, value, n).

    Equal counts: the smallest value in byte order.  Rows with a null key, value or id don't count, keys
    without a counting row are left out, rows repeated with their id count once, and an empty table gives
    no row.  Values are compared as given, whatever their length; a value may be an expression, which is
    evaluated once for a row and named ``value`` in the result.  Other columns take no part.  Keys with
    more than ``share`` of the rows (default: half of a partition's part) are dealt over all tasks; the result
    doesn't depend on it.
    """
    require_columns(df, key, row_id)
    name, spread = value if isinstance(value, str) else "value", partitions(df.sparkSession)
    rows = df.withColumn("_k", F.col(key)).where(F.col("_k").isNotNull() & F.col(row_id).isNotNull())
    heavy = F.broadcast(heavy_keys(rows, "_k", share).select(F.col("_k").alias("_h")))
    marked = rows.join(heavy, F.col("_k") == F.col("_h"), "left").select(
        "_k", (F.col(value) if isinstance(value, str) else value).alias("_v"), F.col(row_id).alias("_id"), F.col("_h").isNotNull().alias("_hot"))
    dealt = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_v", "_id"), F.lit(spread))).otherwise(-1)).repartition("_k", "_salt")
    # null values are passed over here: a filter on them would be pushed below the shuffle and evaluate them twice
    first = F.min(F.when(F.col("_v").isNotNull(), F.struct((-F.col("n")).alias("m"), "_v"))).alias("w")

    def counted(part: DataFrame) -> DataFrame:
        return part.groupBy("_k", "_salt", "_v", "_id").agg(F.lit(1)).groupBy("_k", "_salt", "_v").agg(F.count(F.lit(1)).alias("n"))

    hot = counted(_only(dealt, "_id", F.col("_salt") >= 0)).groupBy("_k", "_v").agg(F.sum("n").alias("n")).groupBy("_k").agg(first)
    cold = counted(_only(dealt, "_id", F.col("_salt") < 0)).groupBy("_k", "_salt").agg(first).drop("_salt")
    return hot.unionByName(cold).where("w is not null").select(
        F.col("_k").alias(key), F.col("w._v").alias(name), (-F.col("w.m")).alias("n"))
