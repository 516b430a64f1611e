"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.plans.registry import Catalogue
from tidewright.streaming.rollups import run_available, stream_table, windowed

catalogue = Catalogue()


@catalogue.add("stream_event_windows", """select time_bucket(interval '6 hours', ts) as "from", time_bucket(interval '6 hours', ts) + interval '6 hours' as until, event_type,
count(*) as n, cast(round(sum(value), 4) as double) as total from events group by all""")
def stream_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    stream = stream_table(spark, folder, "events")
    out = run_available(windowed(stream, "ts", "6 hours", ["event_type"], {"n": F.count(F.lit(1)), "total": F.sum("value")}, "40 days"), ["from", "until", "event_type"])
    return out.withColumn("total", F.round("total", 4))
