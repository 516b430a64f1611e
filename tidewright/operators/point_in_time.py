"""Attributes as they were known at the time of an event.

Validity intervals are cut into dyadic nodes of the time line.  A node of level ``l`` covers
``2**l`` ticks; a point lies in exactly one node of each level, an interval is the disjoint
union of at most two nodes of each level.  So "the interval holds the point" becomes an equi-join
on (key, node), whatever the length of a tick.  Nodes are numbered as in a heap: the root is 1, the
halves of node i are 2i and 2i + 1, hence the nodes around a leaf are its right shifts.

Scale: every row of a node covers the whole node, hence only the row of highest precedence of
each (key, node) is kept, by an aggregation that combines before its shuffle.  Events ask only the
levels on which some attribute node lies.  The nodes that many events ask, of whatever level, are found
by a frequent-items sketch over all events; each is repeated in proportion to its load and its events
are dealt over the copies, so neither a key with a third of all events nor a crowded tick fills a task.
The range of ticks, the levels and the loaded nodes are small aggregates (one row; at most twice as many
rows as there are partitions) and are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewright.operators.heavy_keys import fair_share, frequent
from tidewright.runtime import require_columns

#: Ticks of events span less than two to this power.
DEEPEST = 60
#: The coarsest nodes lie so many levels below the root: an interval lists at most 16 of them, and every event is
#: spared as many asks.
BELOW_ROOT = 4


def _right(c: Column, bits: Column) -> Column:
    return F.call_function("shiftright", c, bits.cast("int"))


def _power(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))


def bits(c: Column) -> Column:
    """Binary digits of a number that isn't negative; 1 for 0."""
    return F.length(F.bin(c))


def enclosing_node(place: Column, top: Column, level: Column) -> Column:
    """The node of the level that holds the place, a number in [0, 2**top)."""
    return _right(_power(top) + place, level)


def interval_nodes(start: Column, end: Column, top: Column) -> Column:
    """The disjoint nodes whose union is [start, end), both in [0, 2**top]; empty where start >= end."""
    coarsest = F.greatest(top.cast("int") - BELOW_ROOT, F.lit(0))

    def of_level(level: Column) -> Column:
        low, high = _right(start + _power(level) - 1, level), _right(end, level)
        first, odd = _power(top - level), lambda c: c.bitwiseAND(1) == 1
        ends = F.array_compact(F.array(F.when(odd(low), first + low), F.when(odd(high), first + high - 1)))
        return F.when(low >= high, F.array().cast("array<bigint>")).when(level < coarsest, ends).otherwise(F.sequence(first + low, first + high - 1))

    return F.flatten(F.transform(F.sequence(F.lit(0), coarsest), of_level))


def match_as_of(
    events: DataFrame,
    attributes: DataFrame,
    *,
    key: str,
    event_id: str,
    event_tick: str,
    start_tick: str,
    end_tick: str | None = None,
    precedence: Sequence[str],
    values: Sequence[str] = (),
    share: float | None = None,
) -> DataFrame:
    """One row (event_id, precedence and value columns) for each event that has a valid attribute row.

    A row is valid for an event of its key when ``start_tick <= event_tick < end_tick`` (half-open; no
    or null end: for ever).  Of several the one with the largest precedence columns, compared in order,
    wins; rows alike in all of them are ordered by the value columns.  Ticks are whole numbers of any unit,
    microseconds too; those of the events may span less than 2**60.  A node asked by more than ``share`` of
    all asks (default: half of a partition's part) is repeated; the result doesn't depend on it.

    Defined cases: an event with a null id, key or tick and an attribute row with a null key or start
    match nothing; null precedence ranks lowest; an interval that ends before it starts is empty;
    events repeated with their id give one row; an empty table on either side gives an empty result.
    Other columns of either table, also of the same name, take no part.
    """
    require_columns(events, key, event_id, event_tick)
    require_columns(attributes, key, start_tick, *([end_tick] if end_tick else []), *precedence, *values)
    share = share or fair_share(events.sparkSession)
    points = events.select(
        F.col(event_id).alias("_id"), F.col(key).alias("_key"), F.col(event_tick).cast("long").alias("_tick")
    ).where("_id is not null and _key is not null and _tick is not null")
    grid = points.agg(F.min("_tick").alias("_first"), F.max("_tick").alias("_last")).where("_first is not null").withColumn(
        "_top", bits(F.col("_last") - F.col("_first"))).withColumn(
        "_top", F.when(F.col("_top") <= DEEPEST, F.col("_top")).otherwise(F.raise_error(F.lit(f"ticks span more than 2**{DEEPEST}"))))

    kept = list(dict.fromkeys([*precedence, *values]))
    after = F.col("_last") + 1
    within = lambda c: F.least(F.greatest(F.col(c).cast("long"), F.col("_first")), after) - F.col("_first")
    end = _power(F.col("_top"))
    if end_tick:
        end = F.when(F.col(end_tick).cast("long") <= F.col("_last"), within(end_tick)).otherwise(end)
    nodes = (
        attributes.where(F.col(key).isNotNull() & F.col(start_tick).isNotNull()).join(F.broadcast(grid))
        .where(F.col(start_tick).cast("long") <= F.col("_last"))
        .select(F.col(key).alias("_key"), F.struct(*kept).alias("_row"), "_top",
                F.explode(interval_nodes(within(start_tick), end, F.col("_top"))).alias("_node"))
    )
    levels = nodes.agg(F.collect_set((F.col("_top") + 1 - bits(F.col("_node"))).cast("int")).alias("_levels"))
    asked = points.join(F.broadcast(grid)).join(F.broadcast(levels)).select(
        "_id", "_key", (F.col("_tick") - F.col("_first")).alias("_place"), "_top", F.explode("_levels").alias("_level")).select(
        "_id", "_key", enclosing_node(F.col("_place"), F.col("_top"), F.col("_level")).alias("_node"))
    spot = F.xxhash64("_key", "_node").alias("_spot")
    loaded = F.broadcast(frequent(asked.select(spot), "_spot", share).select("_spot", F.ceil(F.col("part") / share).cast("int").alias("_copies")))

    best = nodes.groupBy("_key", "_node").agg(F.max("_row").alias("_row")).withColumn("_spot", spot).join(loaded, "_spot", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies") - 1, F.lit(0)))))
    keys = asked.withColumn("_spot", spot).join(loaded, "_spot", "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_copies")).cast("int"), F.lit(0)))
    return (
        keys.select("_id", "_key", "_node", "_salt").join(best.select("_key", "_node", "_salt", "_row"), ["_key", "_node", "_salt"])
        .groupBy("_id").agg(F.max("_row").alias("_row"))
        .select(F.col("_id").alias(event_id), *[F.col("_row")[c].alias(c) for c in kept])
    )


def with_attributes_as_of(events: DataFrame, attributes: DataFrame, *, prefix: str = "asof_", event_id: str,
                          **how) -> DataFrame:
    """All events with the attributes of ``match_as_of`` in columns named with the prefix, null without a match."""
    found = match_as_of(events, attributes, event_id=event_id, **how)
    found = found.select(F.col(event_id).alias("_asof_id"),
                         *[F.col(c).alias(prefix + c) for c in found.columns if c != event_id])
    return events.join(found, F.col(event_id) == F.col("_asof_id"), "left").drop("_asof_id")
