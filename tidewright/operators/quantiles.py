"""Exact quantiles of many or huge groups.

Equal values are counted first, by an aggregation that combines before its shuffle.  The distinct values are then
range-partitioned by (group, value); how many rows lie before a partition follows from the partitions' totals, one row for
a group and partition.  So the partition that holds a wanted rank is known, and only these partitions are looked at
again.  No task ever holds all values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewright.functions.safe import finite
from tidewright.runtime import cut_lineage, require_columns


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(groups, n, quantiles): linearly interpolated quantiles of the finite values of each group, in the order of ``shares``.

    Null, NaN and infinite values don't count, groups without any other have no row; null group values form a group.
    Repeated rows count each.  Without groups the result is one row, or none for an empty table.
    """
    require_columns(df, *groups, value)
    if not shares or any(not 0 <= q <= 1 for q in shares):
        raise ValueError("shares must lie in [0, 1]")
    keys = [f"_g{i}" for i in range(len(groups))]
    named = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], (finite(F.col(value).cast("double")) + 0.0).alias("_v"))
    counts = named.where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    # written once, since the sampling of a range partition isn't repeatable
    placed = cut_lineage(cut_lineage(counts).repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "_p").agg(F.sum("_n").alias("_held"))
    of_group = Window.partitionBy(*keys)
    totals = totals.withColumns({"_all": F.sum("_held").over(of_group),
                                 "_before": F.sum("_held").over(of_group.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_held")})
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), end.alias("rank")) for i, q in enumerate(map(float, shares))
                      for end in (F.floor((F.col("_all") - 1) * q), F.ceil((F.col("_all") - 1) * q))])
    wanted = totals.withColumn("_w", F.explode(F.array_distinct(ranks))).select(*keys, "_p", "_all", "_before", "_held", "_w.*").where(
        "rank >= _before and rank < _before + _held")
    wanted = wanted.groupBy(*keys, "_p", "_all", "_before").agg(F.collect_list(F.struct("i", "q", "rank")).alias("_w"))
    a, b = placed.alias("a"), wanted.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.col("a._p") == F.col("b._p"))
    near = a.join(b, same).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a._p").alias("_p"), "_v", "_n", "_all", "_before", "_w")
    within = Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = near.withColumn("_upto", F.sum("_n").over(within) + F.col("_before")).withColumn("_w", F.explode("_w"))
    hits = upto.where((F.col("_w.rank") < F.col("_upto")) & (F.col("_w.rank") >= F.col("_upto") - F.col("_n")))
    spot = (F.col("_all") - 1) * F.col("_w.q")
    ends = hits.groupBy(*keys, "_all", "_w.i").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.first(spot - F.floor(spot)).alias("_part"))
    cell = F.struct("i", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("x"))
    return ends.groupBy(*keys, "_all").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["x"]).alias("quantiles")).select(
        *[F.col(k).alias(g) for g, k in zip(groups, keys)], F.col("_all").alias("n"), "quantiles")
