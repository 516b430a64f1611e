"""Pairing records with the nearest record in time of the same entity.

Left and right records are ranged together, globally, by (entity, time, side, id): an entity may fill
many tasks, and a crowded moment too, since the id takes part.  Each task scans its sorted rows once and
gives every left row the right row before and after it, as far as its own partition holds them; a row that
repeats the one before it is passed over.  What may be missing lies over a partition's edge: each task also
gives its first and last right row, these edges go through a prefix scan by blocks (scan in each block, scan
of the block totals, both put together), and the result, two rows for each partition, is broadcast back.

Scale: one range shuffle of ids and keys, then no shuffle of the rows.  Equal keys on the right combine
before it.  A task keeps at most ``HELD`` left rows that wait for their successor: of a longer stretch without a
right row they leave with the stretch's number, and the row that ends it is joined to them afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidewright.runtime import cut_lineage, partitions, require_columns

#: Partitions that one block of the prefix scan holds.
BLOCK = 64
#: Left rows that a task keeps while they wait for the next right row.
HELD = 200_000
_SCANNED = ("pid int, id bigint, entity string, at bigint, before_id bigint, before_at bigint, after_id bigint, "
            "after_at bigint, open_before boolean, open_after boolean, stretch bigint, edge int")


def _scan(most: int):
    """For mapInPandas over a sorted partition: neighbours of left rows, then edge rows.

    Edges: 1 the first, 2 the last right row of the partition, 3 the right row that ends a stretch whose left rows
    were too many to wait for it.
    """
    columns = [c.split()[0] for c in _SCANNED.split(", ")]

    def edge(pid: int, kind: int, row: tuple, stretch: int | None = None) -> pd.DataFrame:
        return pd.DataFrame([[pid, row[2], row[0], row[1], None, None, None, None, False, False, stretch, kind]], columns=columns)

    def settled(rows: pd.DataFrame, following: tuple) -> pd.DataFrame:
        same = rows["entity"] == following[0]
        return rows.assign(after_id=np.where(same, following[2], None), after_at=np.where(same, following[1], None))[columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = first = before = None  # (entity, at, id) of right rows; (side, entity, at, id) of the row before
        waiting: list[pd.DataFrame] = []
        stretch, left_early, pid = 0, False, None
        for f in frames:
            if not len(f):
                continue
            pid = int(f["pid"].iloc[0])
            side, entity, at, ids = (f[c].to_numpy() for c in ("side", "entity", "at", "id"))
            new = np.ones(len(f), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (side[1:] != side[:-1]) | (at[1:] != at[:-1]) | (entity[1:] != entity[:-1])
            new[0] = before != (side[0], entity[0], at[0], ids[0])
            before = (side[-1], entity[-1], at[-1], ids[-1])
            side, entity, at, ids = side[new], entity[new], at[new], ids[new]
            n = len(ids)
            if not n:
                continue
            place, right = np.arange(n), side == 0
            prev = np.maximum.accumulate(np.where(right, place, -1))
            nxt = np.minimum.accumulate(np.where(right, place, n)[::-1])[::-1]
            left = place[~right]
            p, q = prev[left], nxt[left]
            safe_p, safe_q = np.maximum(p, 0), np.minimum(q, n - 1)
            out = pd.DataFrame({"pid": pid, "id": ids[left], "entity": entity[left], "at": at[left]})
            known = (p >= 0) & (entity[safe_p] == entity[left])
            before_id, before_at = np.where(known, ids[safe_p], None), np.where(known, at[safe_p], None)
            if last is not None:
                carried = (p < 0) & (entity[left] == last[0])
                before_id[carried], before_at[carried] = last[2], last[1]
            out["before_id"], out["before_at"], out["open_before"] = before_id, before_at, (p < 0) & (last is None)
            known = (q < n) & (entity[safe_q] == entity[left])
            out["after_id"], out["after_at"] = np.where(known, ids[safe_q], None), np.where(known, at[safe_q], None)
            out["open_after"], out["stretch"], out["edge"] = False, None, 0
            rights = place[right]
            if len(rights):
                head = (entity[rights[0]], int(at[rights[0]]), int(ids[rights[0]]))
                yield from (settled(w, head) for w in waiting)
                if left_early:
                    yield edge(pid, 3, head, stretch)
                waiting, stretch, left_early, first = [], stretch + 1, False, first or head
                last = (entity[rights[-1]], int(at[rights[-1]]), int(ids[rights[-1]]))
            held = q >= n
            if held.any():
                waiting.append(out[held])
                if sum(map(len, waiting)) > most:
                    yield from (w.assign(open_after=True, stretch=stretch)[columns] for w in waiting)
                    waiting, left_early = [], True
            if (~held).any():
                yield out.loc[~held, columns]
        yield from (w.assign(open_after=True, stretch=stretch if left_early else None)[columns] for w in waiting)
        for kind, row in ((1, first), (2, last)):
            if row is not None:
                yield edge(pid, kind, row)

    return run


def _carried(edges: DataFrame, count: int) -> DataFrame:
    """For each partition the last right row before it and the first after it, by a prefix scan in blocks."""
    kept = edges.groupBy("pid").agg(*[F.max(F.when(F.col("edge") == e, F.struct("entity", "at", "id"))).alias(c)
                                      for e, c in ((1, "first"), (2, "last"))])
    every = edges.sparkSession.range(0, count, 1, 1).select(F.col("id").cast("int").alias("pid"))
    rows = every.join(F.broadcast(kept), "pid", "left").withColumn("block", F.floor(F.col("pid") / BLOCK))
    within = Window.partitionBy("block").orderBy("pid")
    ahead, behind = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(1, Window.unboundedFollowing)
    local = rows.select("pid", "block", F.last("last", True).over(ahead).alias("l"), F.first("first", True).over(behind).alias("f"))
    blocks = rows.groupBy("block").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("pid"))).alias("last"),
                                       F.min_by("first", F.when(F.col("first").isNotNull(), F.col("pid"))).alias("first"))
    over = Window.orderBy("block")  # one row for each block of partitions
    totals = blocks.select("block", F.last("last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("bl"),
                           F.first("first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("bf"))
    return local.join(F.broadcast(totals), "block").select(
        "pid", F.coalesce("l", "bl").alias("carried_before"), F.coalesce("f", "bf").alias("carried_after"))


def nearest_in_time(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, entity: str, at: str,
                    tolerance: int, count: int | None = None) -> DataFrame:
    """Left ids with the nearest right id of their entity: (left_id, right_id, gap); gap is right minus left.

    Ids and times are whole numbers.  Left rows without a right row at most ``tolerance`` away are left out;
    of two equally near ones the earlier wins, at one time the smallest right id.  A right row at the very
    time has gap 0.  ``count`` is the number of range partitions (default: spark.sql.shuffle.partitions).

    Defined cases: rows with a null id, entity or time on either side take no part; a left id repeated with
    all its fields gives one row; an empty side gives an empty result; other columns, also of the same name
    on both sides, are ignored.
    """
    require_columns(left, left_id, entity, at)
    require_columns(right, right_id, entity, at)
    spark = left.sparkSession
    count = count or partitions(spark)

    def side(df: DataFrame, row_id: str) -> DataFrame:
        return df.select(F.col(entity).alias("entity"), F.col(at).cast("long").alias("at"),
                         F.col(row_id).cast("long").alias("id")).where("entity is not null and at is not null and id is not null")

    # written twice, before and after the scan: ranging samples its input first, which would otherwise compute both
    # sides twice, and edges and rows must come from one and the same ranging
    both = cut_lineage(
        side(right, right_id).groupBy("entity", "at").agg(F.min("id").alias("id")).withColumn("side", F.lit(0))
        .unionByName(side(left, left_id).withColumn("side", F.lit(1))))
    ranged = (
        both.repartitionByRange(count, "entity", "at", "side", "id").sortWithinPartitions("entity", "at", "side", "id")
        .select(F.spark_partition_id().alias("pid"), "entity", "at", "side", "id")
    )
    scanned = cut_lineage(ranged.mapInPandas(_scan(HELD), _SCANNED))
    rows = scanned.where("edge = 0")
    ends = scanned.where("edge = 3").select(F.col("pid").alias("_pid"), F.col("stretch").alias("_stretch"), F.struct("entity", "at", "id").alias("ended_by"))
    if ends.isEmpty():
        rows = rows.withColumn("ended_by", F.lit(None).cast(dict(ends.dtypes)["ended_by"]))
    else:  # only rows of stretches that were too long to wait for are shuffled
        early = rows.where("stretch is not null").join(ends, (F.col("pid") == F.col("_pid")) & (F.col("stretch") == F.col("_stretch")), "left")
        rows = rows.where("stretch is null").withColumn("ended_by", F.lit(None).cast(dict(ends.dtypes)["ended_by"])).unionByName(early.drop("_pid", "_stretch"))
    rows = rows.join(F.broadcast(_carried(scanned.where("edge in (1, 2)"), count)), "pid", "left")
    rows = rows.withColumn("carried_after", F.coalesce("ended_by", "carried_after"))
    over_edge = lambda side, c: F.when(F.col(f"open_{side}") & (F.col(f"carried_{side}.entity") == F.col("entity")),
                                       F.col(f"carried_{side}.{c}"))
    before_at, after_at = F.coalesce("before_at", over_edge("before", "at")), F.coalesce("after_at", over_edge("after", "at"))
    near = rows.select(
        "id", (before_at - F.col("at")).alias("b"), (after_at - F.col("at")).alias("a"),
        F.coalesce("before_id", over_edge("before", "id")).alias("bid"), F.coalesce("after_id", over_edge("after", "id")).alias("aid"))
    earlier = F.col("b").isNotNull() & (F.col("a").isNull() | (-F.col("b") <= F.col("a")))
    return near.select(
        F.col("id").alias(left_id), F.when(earlier, F.col("bid")).otherwise(F.col("aid")).alias(right_id),
        F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("gap")
    ).where(F.abs("gap") <= tolerance)
