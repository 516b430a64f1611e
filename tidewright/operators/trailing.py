"""Totals over trailing days by event-contribution deltas.

An amount on day d counts from d to d + span - 1: it adds at d and subtracts at d + span.  The running
sum of these deltas is the trailing total, and it changes only on days that have a delta.  So quiet
days need no row until someone asks for them: a total is a run of days.

Scale: amounts are first summed to one row for each (key, day), combining before the shuffle, so a key
has at most as many rows as the calendar has days, however many events it has; the running sum is then
over a bounded group.  Amounts are summed as decimals, so what is added is subtracted exactly and no
rounding drifts along a key's history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewright.functions.safe import finite
from tidewright.functions.ticks import day_of, iso_day
from tidewright.runtime import require_columns

#: Digits behind the point that amounts keep; amounts and totals hold below 1e23 (38 digits in all).
SCALE = 15


def latest_version(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each combination of keys: the values of the row with the largest ``order`` columns.

    Null order columns rank lowest; rows alike in all of them are ordered by the values.  It is an
    aggregation, so nothing is sorted by key and hot keys combine before the shuffle.
    """
    require_columns(df, *keys, *order, *values)
    last = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                          *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.v{i}").alias(c) for i, c in enumerate(values)])


def trailing_runs(df: DataFrame, key: str, day: str, spans: Mapping[int, str]) -> DataFrame:
    """Runs of days over which a trailing total holds: (key, span_days, from_day, to_day, total, n).

    ``spans`` maps a number of days to the column totalled over it.  Days are counts since 1970-01-01 and
    a run is [from_day, to_day).  Runs without any amount in their window (n = 0) are left out.

    Defined cases: null, NaN and infinite amounts count as no row, as do rows with a null key or day;
    several rows of a day add up; a day column may be a date; an empty table gives no run.  Amounts are
    rounded to 15 digits behind the point.  A finite amount or a total of 1e23 or more in size fails the run, as
    dropping it would leave the totals wrong.
    """
    require_columns(df, key, day, *spans.values())
    dated = F.col(day) if dict(df.dtypes)[day] in ("bigint", "int") else day_of(F.col(day))

    def amount(c: str) -> Column:
        kept, known = F.col(c).try_cast(f"decimal(38,{SCALE})"), finite(F.col(c).try_cast("double"))
        said = F.concat(F.lit(f"amount of 1e23 or more in column {c}: "), F.col(c).cast("string"))
        return F.when(kept.isNull() & known.isNotNull(), F.raise_error(said)).otherwise(kept)

    entry: list[Column] = [
        F.struct(F.lit(span).cast("long").alias("span_days"), amount(c).alias("a")) for span, c in spans.items()
    ]
    deltas = (
        df.select(F.col(key).alias("_k"), dated.alias("_d"), F.explode(F.array(*entry)).alias("e"))
        .where("_k is not null and _d is not null and e.a is not null")
        .groupBy("_k", "_d", "e.span_days").agg(F.sum("e.a").alias("a"), F.count(F.lit(1)).alias("n"))
        .select("_k", "span_days", F.explode(F.array(
            F.struct(F.col("_d").alias("d"), F.col("a"), F.col("n")),
            F.struct((F.col("_d") + F.col("span_days")).alias("d"), (-F.col("a")).alias("a"), (-F.col("n")).alias("n")),
        )).alias("x"))
        .select("_k", "span_days", "x.*")
    )
    by = Window.partitionBy("_k", "span_days")
    so_far = by.orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    runs = deltas.select(
        "_k", "span_days", "d",
        F.sum("a").over(so_far).alias("total"), F.sum("n").over(so_far).alias("n"),
        F.lead("d").over(by.orderBy("d")).alias("to_day"),
    )
    return runs.where("n > 0 and to_day > d").select(
        F.col("_k").alias(key), "span_days", F.col("d").alias("from_day"), "to_day",
        F.col("total").cast("double").alias("total"), "n"
    )


def each_day(runs: DataFrame) -> DataFrame:
    """The runs with one row for each of their days, as yyyy-MM-dd in ``on_day``; at most a span's days a run."""
    rest = [c for c in runs.columns if c not in ("from_day", "to_day")]
    return runs.select(*rest, F.explode(F.sequence("from_day", F.col("to_day") - 1)).alias("_day")).select(
        *rest, iso_day(F.col("_day")).alias("on_day")
    )
