"""Windowed rollups over a stream of files, and running one over all that is there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewright.runtime import shared_folder


def stream_table(spark: SparkSession, folder: str, name: str, files: int = 64) -> DataFrame:
    """A stream over the files of a table, so many a micro-batch."""
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")


def windowed(stream: DataFrame, at: str, size: str, keys: list[str], totals: dict[str, Column], late: str = "1 day") -> DataFrame:
    """Totals by tumbling window and keys: (from, until, keys, totals); state older than ``late`` is dropped.

    Times without a zone are taken in the session's zone, as watermarks need instants, and given back without one.
    """
    local = dict(stream.dtypes)[at] == "timestamp_ntz"
    stream = stream.withColumn(at, F.col(at).cast("timestamp"))
    bound = lambda c: F.col(f"window.{c}").cast("timestamp_ntz") if local else F.col(f"window.{c}")
    grouped = stream.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(*[c.alias(n) for n, c in totals.items()])
    return grouped.select(bound("start").alias("from"), bound("end").alias("until"), *keys, *totals)


def run_available(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """Run over all files that are there, then give the last state of each row of the rollup, told by its keys.

    Each micro-batch adds only the rows it changed; the state of windows older than the watermark is dropped, and their
    rows stay as they were written last.
    """
    spark = rollup.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda df, n: df.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    schema = ", ".join(f"`{c}` {t}" for c, t in rollup.dtypes) + ", _batch bigint"
    spark.createDataFrame([], schema).write.parquet(f"{base}/out/none")  # a stream without a row has a result too
    query = (rollup.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    rest = [c for c in rollup.columns if c not in keys]
    changed = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
