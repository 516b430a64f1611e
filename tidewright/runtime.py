"""Session-level helpers shared by operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.errors import MissingColumnsError


def require_columns(df: DataFrame, *names: str) -> None:
    """Fail before any job runs when a named column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing columns {missing}; present: {df.columns}")


def with_known(df: DataFrame, column: str) -> DataFrame:
    """The rows whose column isn't null, for a column that is dear to compute.

    A plain filter would be pushed below the projections that make the column, which computes it twice and
    inlines every step of it; a generator is no such filter.
    """
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.array_compact(F.array(column))).alias(column)).select(*df.columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every machine of the cluster must reach.

    Where the session names none, a local master gets a fresh temporary folder and a cluster a ValueError.  Spark
    removes what is written there by ``cut_lineage`` once it isn't needed, if the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
        known = sc.getCheckpointDir()
    return known


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs no recomputation and no sampled
    or range-partitioned step is ever run twice with another outcome."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
