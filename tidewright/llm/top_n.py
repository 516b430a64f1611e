"""The N best items of every group, be a group tiny or a third of all rows.

Repeated items are merged first, by an aggregation that combines before its shuffle, so an item with a third of
all rows is one row a task.  Then two ranked stages: items are hashed into subgroups of their group, each subgroup
keeps the N best of its items; the survivors, at most ``salts * n`` for a group, are ranked again by group.

Scale: three shuffles.  The first moves one row for each task, group and item; the other two move what is left when
each task has kept the N best of every subgroup, then of every group, that it holds.  A subgroup of the largest
group is no larger than a partition, as there are as many subgroups as partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidewright.runtime import partitions, require_columns


def top_items(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int, salts: int | None = None) -> DataFrame:
    """The first ``n`` items of each group by score from high to low: (groups, item, score, place).

    Equal scores: by item, ascending.  An item counts once in a group, with its highest score.  Null and NaN
    scores and null items never count; null group values form a group of their own.  A group with fewer items
    gives what it has, an empty table nothing; infinite scores rank as numbers.  Other columns
    are ignored.  ``salts`` is the number of subgroups (default: spark.sql.shuffle.partitions); the result doesn't depend on it.
    """
    require_columns(df, *groups, item, score)
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(item).alias("_item"),
                     F.col(score).cast("double").alias("_score")).where("_item is not null and _score is not null and not isnan(_score)")
    order = [F.desc("_score"), F.asc("_item")]
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    spread = salts or partitions(df.sparkSession)
    best = rows.groupBy(*keys, "_item").agg(F.max("_score").alias("_score")).withColumn("_salt", F.pmod(F.xxhash64("_item"), F.lit(spread)).cast("int"))
    kept = best.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= n).drop("_place")
    last = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn("place", F.row_number().over(last)).where(F.col("place") <= n).select(
        *[F.col(k).alias(g) for g, k in zip(groups, keys)], F.col("_item").alias(item), F.col("_score").alias(score), "place")
